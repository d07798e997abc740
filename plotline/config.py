"""Fixed values and parameter bundles.

Everything in the "fixed values" blocks must equal the values of the
listing notebook this library re-implements, otherwise results differ.
They are kept here, in natural order, as plain literals.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Sanity ranges for raw listings
# ---------------------------------------------------------------------------
PRICE_MIN = 10_000
PRICE_MAX = 50_000_000
SQFT_MIN = 100
SQFT_MAX = 30_000
BEDS_MAX = 20
BATHS_MAX = 20
ACRE_LOT_MAX = 1_000

ACRE_TO_SQFT = 43_560
DAYS_PER_YEAR = 365.25
EARLIEST_SALE_DATE = "1900-01-01"

VALID_STATUSES = ("for_sale", "sold", "ready_to_build")

SOLD_MIN_QUALITY = 0.6
ACTIVE_MIN_QUALITY = 0.5
ALL_MIN_QUALITY = 0.5

# ---------------------------------------------------------------------------
# State -> gross rental yield (default for unlisted states)
# ---------------------------------------------------------------------------
STATE_GROSS_YIELD = {
    "California": 0.040, "New York": 0.045, "Hawaii": 0.035,
    "Massachusetts": 0.042, "Washington": 0.043, "New Jersey": 0.048,
    "Connecticut": 0.050, "Florida": 0.058, "Texas": 0.060,
    "Arizona": 0.055, "Colorado": 0.050, "Nevada": 0.057,
    "Georgia": 0.062, "North Carolina": 0.062, "Tennessee": 0.063,
    "South Carolina": 0.065, "Illinois": 0.068, "Ohio": 0.078,
    "Michigan": 0.072, "Wisconsin": 0.072, "Indiana": 0.076,
    "Missouri": 0.074, "Minnesota": 0.066,
}
DEFAULT_GROSS_YIELD = 0.065

# ---------------------------------------------------------------------------
# State -> market tier (unlisted states are "other")
# ---------------------------------------------------------------------------
STATE_TIER = {
    "California": "coastal_premium", "New York": "coastal_premium",
    "Hawaii": "coastal_premium", "Massachusetts": "coastal_premium",
    "Washington": "coastal_premium", "New Jersey": "coastal_premium",
    "Connecticut": "coastal_premium", "Maryland": "coastal_premium",
    "Oregon": "coastal_premium", "Florida": "sun_belt", "Texas": "sun_belt",
    "Arizona": "sun_belt", "Colorado": "sun_belt", "Nevada": "sun_belt",
    "Georgia": "sun_belt", "North Carolina": "sun_belt", "Tennessee": "sun_belt",
    "South Carolina": "sun_belt", "Utah": "sun_belt", "Idaho": "sun_belt",
    "Montana": "sun_belt", "Illinois": "midwest", "Ohio": "midwest",
    "Michigan": "midwest", "Wisconsin": "midwest", "Indiana": "midwest",
    "Missouri": "midwest", "Minnesota": "midwest", "Iowa": "midwest",
    "Kansas": "midwest", "Nebraska": "midwest", "Oklahoma": "midwest",
    "Arkansas": "midwest", "Mississippi": "midwest", "Alabama": "midwest",
    "Kentucky": "midwest", "Louisiana": "midwest", "West Virginia": "midwest",
    "Pennsylvania": "midwest", "Virginia": "midwest", "Delaware": "midwest",
    "Rhode Island": "midwest", "New Hampshire": "midwest", "Maine": "midwest",
    "South Dakota": "midwest", "North Dakota": "midwest", "New Mexico": "midwest",
}
DEFAULT_TIER = "other"

# ---------------------------------------------------------------------------
# Operating / exit assumptions per tier
# columns: tax_rate, insurance_rate, mgmt_fee_pct, maintenance_pct,
#          vacancy_rate, annual_pg, exit_cap_rate
# ---------------------------------------------------------------------------
TIER_ASSUMPTION_COLUMNS = (
    "tax_rate", "insurance_rate", "mgmt_fee_pct", "maintenance_pct",
    "vacancy_rate", "annual_pg", "exit_cap_rate",
)
TIER_ASSUMPTIONS = {
    "coastal_premium": (0.009, 0.004, 0.08, 0.008, 0.05, 0.055, 0.040),
    "sun_belt":        (0.013, 0.007, 0.08, 0.010, 0.07, 0.048, 0.050),
    "midwest":         (0.015, 0.005, 0.09, 0.012, 0.08, 0.035, 0.065),
    "other":           (0.012, 0.005, 0.09, 0.010, 0.08, 0.035, 0.060),
}

# ---------------------------------------------------------------------------
# Forecast appreciation rates, keyed as in the notebook.
# The tier label is "coastal_premium", so with these keys coastal states fall
# back to the default rate (kept on purpose for parity; pass your own dict to
# change it).
# ---------------------------------------------------------------------------
FORECAST_TIER_RATES = {"coastal": 0.055, "sun_belt": 0.060, "midwest": 0.032, "other": 0.038}
FORECAST_DEFAULT_RATE = 0.038
FORECAST_HORIZON = 12
FORECAST_MAX_HORIZON = 1200  # months that one record of a request can ask for: it becomes as many rows
FORECAST_MIN_GROUP = 3
INTERVAL_PCT = 0.10

# ---------------------------------------------------------------------------
# Model gates, thresholds, blends
# ---------------------------------------------------------------------------
AVM_MAX_MAPE = 0.12
LEAD_MIN_AUC = 0.68
FORECAST_MAX_MAPE = 0.15
LEAD_COOL_MAX = 0.35
LEAD_WARM_MAX = 0.65
HINDSIGHT_APPRECIATION = 1.04
RENT_MODEL_WEIGHT = 0.70
RENT_YIELD_WEIGHT = 0.30
RENT_TRAIN_MIN = 200
RENT_TRAIN_MAX = 10_000
MIN_TRAIN_ROWS = 20
AVM_TEST_STATES = ("California", "Texas", "Ohio", "Montana", "New York")

# ---------------------------------------------------------------------------
# Feature lists
# ---------------------------------------------------------------------------
AVM_NUMERIC = [
    "bed", "bath", "house_size", "acre_lot", "lot_sqft", "bath_bed_ratio", "lot_to_living_ratio",
    "zip_median_price", "zip_median_ppsqft", "zip_sold_count", "zip_active_count",
    "zip_gross_yield", "zip_est_rent", "zip_ptr_ratio", "zip_avg_hold_years", "absorption_proxy",
    "census_median_income", "census_median_home_value", "census_median_gross_rent",
    "census_unemployment_rate", "census_poverty_rate", "census_vacancy_rate",
    "census_owner_occ_rate", "census_college_pct", "affordability_ratio",
]
AVM_CATEGORICAL = ["state", "zip_code", "property_type", "state_tier", "sqft_bucket"]
AVM_BINARY = [
    "sqft_micro", "sqft_small", "sqft_medium", "sqft_large", "sqft_xlarge",
    "tier_coastal", "tier_sun_belt", "tier_midwest",
    "is_multi_family", "is_condo", "is_rural", "has_census_data", "has_prior_sale",
]
LEAD_NUMERIC = [
    "years_since_last_sale", "unrealized_gain_pct", "unrealized_gain_est",
    "approx_purchase_price", "price", "zip_current_median", "zip_gross_yield",
    "census_median_income", "census_unemployment_rate", "census_vacancy_rate",
    "census_owner_occ_rate", "census_poverty_rate", "census_median_home_value",
    "bed", "bath", "house_size", "acre_lot",
]
LEAD_BINARY = [
    "hold_0_2", "hold_2_5", "hold_5_10", "hold_10_plus", "long_hold", "very_long_hold",
    "high_unrealized_gain", "in_sellers_market", "large_lot", "small_unit",
    "high_vacancy_area", "high_unemployment_area",
    "tier_coastal", "tier_sun_belt", "tier_midwest", "is_condo", "is_rural", "is_multi_family",
]
LEAD_CAT = ["state", "property_type", "state_tier"]
RENT_COLS = [
    "bed", "bath", "house_size", "census_median_gross_rent",
    "census_median_income", "census_median_home_value",
    "zip_est_rent", "zip_median_price",
]
ADDRESS_KEYS = ["street", "city", "state", "zip_code"]

# Feature columns that contain the target (kept as columns, left out of the
# default feature lists; see README "Leaky features").
AVM_LEAKY = ["affordability_ratio"]
RENT_LEAKY = ["census_median_gross_rent"]

# ---------------------------------------------------------------------------
# Census variables (ACS 5-year) and their output names
# ---------------------------------------------------------------------------
CENSUS_VARIABLES = [
    "B19013_001E", "B01003_001E", "B25077_001E", "B25064_001E", "B17001_002E",
    "B23025_005E", "B23025_002E", "B25002_003E", "B25001_001E", "B25003_002E",
    "B25003_001E", "B15003_022E", "B15003_001E",
]
CENSUS_ZIP_FIELD = "zip code tabulation area"
CENSUS_COUNT_COLUMNS = {
    "census_median_income": "B19013_001E",
    "census_population": "B01003_001E",
    "census_median_home_value": "B25077_001E",
    "census_median_gross_rent": "B25064_001E",
}
# output rate -> (numerator variable, denominator variable)
CENSUS_RATE_COLUMNS = {
    "census_unemployment_rate": ("B23025_005E", "B23025_002E"),
    "census_poverty_rate": ("B17001_002E", "B01003_001E"),
    "census_vacancy_rate": ("B25002_003E", "B25001_001E"),
    "census_owner_occ_rate": ("B25003_002E", "B25003_001E"),
    "census_college_pct": ("B15003_022E", "B15003_001E"),
}
CENSUS_COLUMNS = list(CENSUS_COUNT_COLUMNS) + list(CENSUS_RATE_COLUMNS)

# Request routing (fixed model type names).
REQUEST_MODEL_TYPES = ("avm", "lead_scoring", "price_forecast")


# ---------------------------------------------------------------------------
# Parameter bundles (defaults are the notebook's)
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Financing:
    down_payment_pct: float = 0.25
    interest_rate: float = 0.065
    loan_term_years: int = 30
    closing_cost_pct: float = 0.025


@dataclass(frozen=True)
class Operating:
    capex_pct: float = 0.05
    hoa_monthly: float = 0.0


@dataclass(frozen=True)
class Hold:
    hold_years: int = 5
    annual_pg: float = 0.04
    annual_rg: float = 0.03
    exit_cap_rate: float = 0.055
    selling_cost_pct: float = 0.06
    discount_rate: float = 0.08


# The listings adapter's fixed "today" (FIXTURES.md §2).
ADAPTER_AS_OF = _dt.date(2002, 1, 1)

"""Registered queries: key -> (Spark plan builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotline import oracle as O
from plotline.operators.market import MARKET_COLUMNS
from plotline.plans import common as P

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(key: str, sql: str | None):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


_DOUBLE_MARKET = {"median_sold_price", "median_price_per_sqft", "avg_hold_years", "zip_median_income",
                  "zip_unemployment", "zip_vacancy_rate", "zip_owner_occ_rate", "median_list_price", "gross_yield",
                  "estimated_monthly_rent", "price_to_rent_ratio", "months_of_supply"}


# Double-typed columns across the layers (rounded in the oracle SQL).
DOUBLES = {
    "price", "bed", "bath", "acre_lot", "house_size", "price_per_sqft", "bath_bed_ratio", "lot_sqft",
    "lot_to_living_ratio", "years_since_last_sale", "quality_score", "census_unemployment_rate",
    "census_poverty_rate", "census_vacancy_rate", "census_owner_occ_rate", "census_college_pct",
    "zip_median_price", "zip_median_ppsqft", "zip_gross_yield", "zip_est_rent", "zip_ptr_ratio",
    "zip_avg_hold_years", "price_vs_zip_median", "affordability_ratio", "absorption_proxy",
    "zip_current_median", "zip_vacancy_rate", "zip_unemployment", "approx_purchase_price",
    "unrealized_gain_est", "unrealized_gain_pct", "median_price", "annual_rate", "forecast_price",
    "forecast_price_low", "forecast_price_high", "last_actual", "purchase_price", "total_cash_in",
    "monthly_payment", "monthly_rent", "gross_yield", "cap_rate", "cash_on_cash_yr1", "dscr_yr1", "noi_yr1",
    "cash_flow_yr1", "exit_value", "irr", "npv", "avm_estimate", "est_rent", "est_monthly_rent",
    "est_annual_rent", "log_price", "price_back", "estimate", "low", "high", "score", "value",
    "rent_", "price_", "annual_opex", "loan_amount", "noi", "cash_flow", "balance", "state_gross_yield",
    "tax_rate", "insurance_rate", "mgmt_fee_pct", "maintenance_pct", "vacancy_rate", "annual_pg", "exit_cap_rate",
} | _DOUBLE_MARKET


def sel(cols, doubles=None, src: str = "") -> str:
    doubles = DOUBLES if doubles is None else doubles
    pre = f"{src}." if src else ""
    return ", ".join(f"{O.r(pre + c)} AS {c}" if c in doubles else f"{pre}{c}" for c in cols)


@register("market_snapshot", O.with_base(f"SELECT {sel(MARKET_COLUMNS, _DOUBLE_MARKET)} FROM market"))
def q_market_snapshot(spark, sf):
    """G-3 (flagship): one aggregation over the silver listings, broadcast yield dim."""
    from plotline.config import ADAPTER_AS_OF
    from plotline.operators.market import market_snapshot
    return P.rounded(market_snapshot(P.silver_df(spark, sf), ADAPTER_AS_OF))


# Load the other query modules (they register themselves on import).
from plotline.plans import queries_etl  # noqa: E402,F401
from plotline.plans import queries_analytics  # noqa: E402,F401
from plotline.plans import queries_prep  # noqa: E402,F401
from plotline.plans import queries_models  # noqa: E402,F401
from plotline.plans import queries_requests  # noqa: E402,F401

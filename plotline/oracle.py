"""DuckDB SQL for the correctness check.

Each registered query has an SQL twin run by DuckDB over the same parquet
tables. The layers (adapter -> bronze -> silver -> market -> features) are
common table expressions built here once from the same fixed values the
Spark operators use; a query's SQL is ``with_base(select)``.
"""

from __future__ import annotations

from plotline import config as C
from plotline.sources.listings import ADAPTER_STATES

AS_OF = f"DATE '{C.ADAPTER_AS_OF.isoformat()}'"
SCALE = 4  # doubles are compared rounded to this many decimals


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else d(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def d(v) -> str:
    """A DOUBLE literal (a bare 0.25 is a DECIMAL in DuckDB)."""
    return f"CAST({float(v)!r} AS DOUBLE)"


def initcap(e: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({e}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def r(e: str, scale: int = SCALE) -> str:
    p = float(10 ** scale)
    return f"(floor(CAST({e} AS DOUBLE) * {p} + 0.5) / {p})"


def exact_avg(e: str, scale: int = 4) -> str:
    return f"(CAST(sum(CAST({e} AS DECIMAL(38, {scale}))) AS DOUBLE) / count({e}))"


STATES_LIST = "[" + ", ".join(q(s.upper()) for s in ADAPTER_STATES) + "]"
TIER_DIM = values(list(C.STATE_TIER.items()), ["state", "state_tier"])
YIELD_DIM = values(list(C.STATE_GROSS_YIELD.items()), ["state", "gross_yield"])
ASSUMPTION_DIM = values([(k, *v) for k, v in C.TIER_ASSUMPTIONS.items()], ["state_tier", *C.TIER_ASSUMPTION_COLUMNS])
RATE_DIM = values(list(C.FORECAST_TIER_RATES.items()), ["state_tier", "annual_rate"])

ADAPTER = f"""
adapter AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS brokered_by,
    CASE WHEN l_returnflag = 'A' THEN ' For_Sale ' WHEN l_returnflag = 'R' THEN 'SOLD'
         WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'ready_to_build' ELSE 'pending' END AS status,
    CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_extendedprice * 10 AS DOUBLE) END AS price,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(p_size % 7 AS DOUBLE) END AS bed,
    CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS bath,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_discount * 60 AS DOUBLE) END AS acre_lot,
    CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE CAST(l_partkey % 150 AS VARCHAR) || ' Main St' END AS street,
    CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE lower(n_name) END AS city,
    {STATES_LIST}[c_nationkey + 1] AS state,
    CAST(600 + c_nationkey * 400 + o_custkey % 4 AS VARCHAR) || '.0' AS zip_code,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_quantity * 80 AS DOUBLE) END AS house_size,
    CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 29 = 0 THEN '2023-02-30'
         WHEN l_suppkey % 37 = 0 THEN '3019-04-02'
         ELSE CAST({AS_OF} - CAST((l_orderkey * 37 + l_partkey * 11) % 7300 AS INTEGER) AS VARCHAR) END AS prev_sold_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def _idpart(c: str, dbl: bool) -> str:
    v = f"CAST(CAST(floor({c} * 10000.0 + 0.5) AS BIGINT) AS VARCHAR)" if dbl else c
    return f"coalesce({v}, '\\N')"


_ID = "md5(concat_ws(chr(1), " + ", ".join(
    _idpart(c, c in ("price", "bed", "bath", "acre_lot", "house_size"))
    for c in ["brokered_by", "status", "price", "bed", "bath", "acre_lot", "street", "city", "state",
              "zip_code", "house_size", "prev_sold_date"]) + "))"

_PARSED_DATE = "CAST(try_strptime(prev_sold_date, '%Y-%m-%d') AS DATE)"
BRONZE = f"""
bronze AS (
  SELECT {_ID} AS listing_id, brokered_by, lower(trim(status)) AS status, price, bed, bath, acre_lot, street,
    {initcap('trim(city)')} AS city, {initcap('trim(state)')} AS state,
    lpad(regexp_replace(zip_code, '\\.0$', ''), 5, '0') AS zip_code, house_size,
    CASE WHEN {_PARSED_DATE} BETWEEN DATE '{C.EARLIEST_SALE_DATE}' AND {AS_OF} THEN {_PARSED_DATE} END AS prev_sold_date
  FROM adapter)"""


def _census_int(v: str) -> str:
    return f"coalesce(TRY_CAST({v} AS BIGINT), 0)"


def _census_rate(n: str, d: str) -> str:
    num, den = _census_int(n), f"greatest({_census_int(d)}, 1)"
    return f"CAST(floor(({num} * 20000 + {den}) / (2.0 * {den})) / 10000.0 AS DOUBLE)"


CENSUS = f"""
census_raw AS (
  SELECT DISTINCT CAST(600 + c_nationkey * 400 + c_custkey % 4 AS BIGINT) AS z FROM customer),
census_vals AS (
  SELECT lpad(CAST(z AS VARCHAR), 5, '0') AS zip_code,
    CASE WHEN z % 7 = 0 THEN NULL WHEN z % 11 = 0 THEN 'x' ELSE CAST(30000 + (z * 37) % 90000 AS VARCHAR) END AS B19013_001E,
    CAST(1000 + z % 9000 AS VARCHAR) AS B01003_001E,
    CAST(100000 + (z * 53) % 900000 AS VARCHAR) AS B25077_001E,
    CAST(150 + z % 3000 AS VARCHAR) AS B25064_001E,
    CAST(z % 700 AS VARCHAR) AS B17001_002E,
    CAST(z % 300 AS VARCHAR) AS B23025_005E,
    CASE WHEN z % 9 = 0 THEN '0' ELSE CAST(500 + z % 4000 AS VARCHAR) END AS B23025_002E,
    CAST(z % 200 AS VARCHAR) AS B25002_003E,
    CAST(800 + z % 1500 AS VARCHAR) AS B25001_001E,
    CAST(z % 900 AS VARCHAR) AS B25003_002E,
    CAST(900 + z % 300 AS VARCHAR) AS B25003_001E,
    CAST(z % 600 AS VARCHAR) AS B15003_022E,
    CAST(700 + z % 2000 AS VARCHAR) AS B15003_001E
  FROM census_raw WHERE z % 13 <> 0),
census AS (
  SELECT zip_code,
    {', '.join(f'{_census_int(v)} AS {name}' for name, v in C.CENSUS_COUNT_COLUMNS.items())},
    {', '.join(f'{_census_rate(n, d)} AS {name}' for name, (n, d) in C.CENSUS_RATE_COLUMNS.items())}
  FROM census_vals)"""

PROPERTY_TYPE = """CASE WHEN house_size IS NULL AND bed IS NULL THEN 'LAND' WHEN bed >= 5 THEN 'MULTI_FAMILY'
         WHEN house_size < 1200 AND (acre_lot IS NULL OR acre_lot < 0.05) THEN 'CONDO'
         WHEN acre_lot >= 5 THEN 'RURAL_RESIDENTIAL' ELSE 'SFR' END"""
SQFT_BUCKET = """CASE WHEN house_size < 800 THEN 'micro' WHEN house_size < 1400 THEN 'small'
         WHEN house_size < 2200 THEN 'medium' WHEN house_size < 3500 THEN 'large'
         WHEN house_size IS NOT NULL THEN 'xlarge' END"""
PRICE_TIER = """CASE WHEN price < 150000 THEN 'entry' WHEN price < 350000 THEN 'mid' WHEN price < 700000 THEN 'upper_mid'
         WHEN price < 1500000 THEN 'luxury' ELSE 'ultra_luxury' END"""
QUALITY = ("(CAST(price IS NOT NULL AS INTEGER) + CAST(bed IS NOT NULL AS INTEGER) + CAST(bath IS NOT NULL AS INTEGER)"
           " + CAST(house_size IS NOT NULL AS INTEGER) + CAST(city IS NOT NULL AS INTEGER)"
           " + CAST(zip_code IS NOT NULL AS INTEGER)) / 6.0")
SANITY = f"""price BETWEEN {C.PRICE_MIN} AND {C.PRICE_MAX}
    AND (house_size IS NULL OR house_size BETWEEN {C.SQFT_MIN} AND {C.SQFT_MAX})
    AND (bed IS NULL OR bed <= {C.BEDS_MAX}) AND (bath IS NULL OR bath <= {C.BATHS_MAX})
    AND (acre_lot IS NULL OR acre_lot <= {C.ACRE_LOT_MAX})
    AND status IN ('for_sale', 'sold', 'ready_to_build') AND state IS NOT NULL AND zip_code IS NOT NULL"""
DERIVED = f"""
    CASE WHEN house_size > 0 THEN price / house_size END AS price_per_sqft,
    {PROPERTY_TYPE} AS property_type,
    CASE WHEN bed > 0 THEN bath / bed END AS bath_bed_ratio,
    acre_lot * {C.ACRE_TO_SQFT} AS lot_sqft,
    CASE WHEN house_size > 0 THEN acre_lot * {C.ACRE_TO_SQFT} / house_size END AS lot_to_living_ratio,
    CASE WHEN prev_sold_date IS NOT NULL
         THEN round(CAST(date_diff('day', prev_sold_date, {AS_OF}) AS DOUBLE) / 365.25, 2) END AS years_since_last_sale,
    CAST(prev_sold_date IS NOT NULL AS INTEGER) AS has_prior_sale,
    {SQFT_BUCKET} AS sqft_bucket,
    {PRICE_TIER} AS price_tier,
    {QUALITY} AS quality_score"""

SILVER = f"""
valid AS (SELECT *, {DERIVED} FROM bronze WHERE {SANITY}),
silver AS (
  SELECT v.*,
    coalesce(t.state_tier, 'other') AS state_tier,
    {', '.join('c.' + c for c in C.CENSUS_COLUMNS)}
  FROM valid v LEFT JOIN {TIER_DIM} t ON v.state = t.state LEFT JOIN census c ON v.zip_code = c.zip_code),
sold AS (SELECT * FROM silver WHERE status = 'sold' AND quality_score >= 0.6 AND house_size IS NOT NULL),
active AS (SELECT * FROM silver WHERE status = 'for_sale' AND quality_score >= 0.5),
all_listings AS (SELECT * FROM silver WHERE quality_score >= 0.5)"""

MARKET = f"""
sold_agg AS (
  SELECT state, zip_code, property_type, state_tier, count(*) AS sold_count,
    quantile_disc(price, 0.5) AS median_sold_price, quantile_disc(price_per_sqft, 0.5) AS median_price_per_sqft,
    {exact_avg('years_since_last_sale')} AS avg_hold_years, {exact_avg('census_median_income')} AS zip_median_income,
    {exact_avg('census_unemployment_rate')} AS zip_unemployment, {exact_avg('census_vacancy_rate')} AS zip_vacancy_rate,
    {exact_avg('census_owner_occ_rate')} AS zip_owner_occ_rate
  FROM sold GROUP BY state, zip_code, property_type, state_tier),
active_agg AS (
  SELECT state, zip_code, property_type, count(*) AS active_listing_count,
    quantile_disc(price, 0.5) AS median_list_price
  FROM active GROUP BY state, zip_code, property_type),
market_base AS (
  SELECT s.*, a.active_listing_count, a.median_list_price,
    coalesce(y.gross_yield, CAST({C.DEFAULT_GROSS_YIELD} AS DOUBLE)) AS gross_yield
  FROM sold_agg s LEFT JOIN active_agg a USING (state, zip_code, property_type)
  LEFT JOIN {YIELD_DIM} y ON s.state = y.state),
market AS (
  SELECT *, median_sold_price * gross_yield / 12 AS estimated_monthly_rent,
    CASE WHEN median_sold_price * gross_yield / 12 > 0
         THEN median_sold_price / (median_sold_price * gross_yield / 12 * 12) END AS price_to_rent_ratio,
    CASE WHEN sold_count > 0 THEN active_listing_count / (sold_count / 12.0) END AS months_of_supply,
    {AS_OF} AS snapshot_date
  FROM market_base)"""

BASE = [ADAPTER, BRONZE, CENSUS, SILVER, MARKET]


def with_base(select: str, *extra: str) -> str:
    ctes = ",".join(BASE + list(extra))
    return f"WITH {ctes}\n{select}"

FEATURES = f"""
zip_ctx AS (
  SELECT state, zip_code, median_sold_price AS zip_median_price, median_price_per_sqft AS zip_median_ppsqft,
    sold_count AS zip_sold_count, active_listing_count AS zip_active_count, gross_yield AS zip_gross_yield,
    estimated_monthly_rent AS zip_est_rent, price_to_rent_ratio AS zip_ptr_ratio, avg_hold_years AS zip_avg_hold_years
  FROM market WHERE property_type = 'SFR'),
prop AS (
  SELECT s.*, z.zip_median_price, z.zip_median_ppsqft, z.zip_sold_count, z.zip_active_count, z.zip_gross_yield,
    z.zip_est_rent, z.zip_ptr_ratio, z.zip_avg_hold_years,
    CASE WHEN z.zip_median_price > 0 THEN s.price / z.zip_median_price END AS price_vs_zip_median,
    CASE WHEN s.census_median_income > 0 THEN s.price / (s.census_median_income * 4) END AS affordability_ratio,
    CASE WHEN z.zip_active_count > 0 THEN z.zip_sold_count / z.zip_active_count END AS absorption_proxy,
    CAST(s.state_tier = 'coastal_premium' AS INTEGER) AS tier_coastal,
    CAST(s.state_tier = 'sun_belt' AS INTEGER) AS tier_sun_belt,
    CAST(s.state_tier = 'midwest' AS INTEGER) AS tier_midwest,
    CAST(s.property_type = 'MULTI_FAMILY' AS INTEGER) AS is_multi_family,
    CAST(s.property_type = 'CONDO' AS INTEGER) AS is_condo,
    CAST(s.property_type = 'RURAL_RESIDENTIAL' AS INTEGER) AS is_rural,
    CAST(s.census_median_income IS NOT NULL AS INTEGER) AS has_census_data,
    CAST(s.sqft_bucket = 'micro' AS INTEGER) AS sqft_micro,
    CAST(s.sqft_bucket = 'small' AS INTEGER) AS sqft_small,
    CAST(s.sqft_bucket = 'medium' AS INTEGER) AS sqft_medium,
    CAST(s.sqft_bucket = 'large' AS INTEGER) AS sqft_large,
    CAST(s.sqft_bucket = 'xlarge' AS INTEGER) AS sqft_xlarge
  FROM sold s LEFT JOIN zip_ctx z ON s.state = z.state AND s.zip_code = z.zip_code),
lead_ctx AS (
  SELECT state, zip_code, median_sold_price AS zip_current_median, gross_yield AS zip_gross_yield,
    zip_vacancy_rate, zip_unemployment
  FROM market WHERE property_type = 'SFR'),
lead0 AS (
  SELECT a.*, c.zip_current_median, c.zip_gross_yield, c.zip_vacancy_rate, c.zip_unemployment,
    CASE WHEN a.years_since_last_sale IS NOT NULL AND a.price > 0
         THEN a.price / pow({C.HINDSIGHT_APPRECIATION}, a.years_since_last_sale) END AS approx_purchase_price
  FROM all_listings a LEFT JOIN lead_ctx c ON a.state = c.state AND a.zip_code = c.zip_code
  WHERE a.has_prior_sale = 1),
lead1 AS (
  SELECT *, price - approx_purchase_price AS unrealized_gain_est,
    CASE WHEN approx_purchase_price > 0 THEN (price - approx_purchase_price) / approx_purchase_price END
      AS unrealized_gain_pct
  FROM lead0),
lead AS (
  SELECT *,
    CAST(years_since_last_sale < 2 AS INTEGER) AS hold_0_2,
    CAST(years_since_last_sale BETWEEN 2 AND 5 AS INTEGER) AS hold_2_5,
    CAST(years_since_last_sale BETWEEN 5 AND 10 AS INTEGER) AS hold_5_10,
    CAST(years_since_last_sale > 10 AS INTEGER) AS hold_10_plus,
    CAST(years_since_last_sale > 7 AS INTEGER) AS long_hold,
    CAST(years_since_last_sale > 15 AS INTEGER) AS very_long_hold,
    CAST(unrealized_gain_pct > 0.30 AS INTEGER) AS high_unrealized_gain,
    CAST(zip_gross_yield > {C.DEFAULT_GROSS_YIELD} AS INTEGER) AS in_sellers_market,
    CAST(acre_lot >= 1.0 AS INTEGER) AS large_lot,
    CAST(house_size < 1200 AS INTEGER) AS small_unit,
    CAST(census_vacancy_rate > 0.10 AS INTEGER) AS high_vacancy_area,
    CAST(census_unemployment_rate > 0.07 AS INTEGER) AS high_unemployment_area,
    CAST(state_tier = 'coastal_premium' AS INTEGER) AS tier_coastal,
    CAST(state_tier = 'sun_belt' AS INTEGER) AS tier_sun_belt,
    CAST(state_tier = 'midwest' AS INTEGER) AS tier_midwest,
    CAST(property_type = 'CONDO' AS INTEGER) AS is_condo,
    CAST(property_type = 'RURAL_RESIDENTIAL' AS INTEGER) AS is_rural,
    CAST(property_type = 'MULTI_FAMILY' AS INTEGER) AS is_multi_family
  FROM lead1),
sold_addr AS (SELECT DISTINCT concat_ws('|', street, city, state) AS a FROM sold),
active_addr AS (SELECT DISTINCT concat_ws('|', street, city, state) AS a FROM active),
relisted AS (SELECT a FROM sold_addr INTERSECT SELECT a FROM active_addr),
lead_labeled AS (
  SELECT l.*, CASE WHEN r.a IS NOT NULL THEN 1 ELSE 0 END AS relisted,
    CAST((r.a IS NOT NULL) OR coalesce(l.very_long_hold, 0) = 1
         OR (coalesce(l.long_hold, 0) = 1 AND coalesce(l.in_sellers_market, 0) = 1) AS INTEGER) AS motivated_seller
  FROM lead l LEFT JOIN relisted r
    ON concat_ws('|', coalesce(l.street, ''), coalesce(l.city, ''), coalesce(l.state, '')) = r.a)"""

FORECAST = f"""
baseline AS (
  SELECT state, property_type, state_tier, median(price) AS median_price, count(price) AS count
  FROM active WHERE price IS NOT NULL AND property_type IS NOT NULL AND state IS NOT NULL
  GROUP BY state, property_type, state_tier HAVING count(price) >= {C.FORECAST_MIN_GROUP}),
fc_seg AS (
  SELECT b.*, coalesce(r.annual_rate, {C.FORECAST_DEFAULT_RATE}) AS annual_rate
  FROM baseline b LEFT JOIN {RATE_DIM} r ON b.state_tier = r.state_tier),
fc_k AS (SELECT *, unnest(range(1, {C.FORECAST_HORIZON} + 1)) AS k FROM fc_seg),
forecast AS (
  SELECT CAST(date_trunc('month', {AS_OF}) + to_months(CAST(k AS INTEGER)) AS DATE) AS forecast_month,
    median_price * pow(1 + (pow(1 + annual_rate, 1.0 / 12) - 1), k) AS forecast_price,
    median_price * pow(1 + (pow(1 + annual_rate, 1.0 / 12) - 1), k) * (1 - {C.INTERVAL_PCT}) AS forecast_price_low,
    median_price * pow(1 + (pow(1 + annual_rate, 1.0 / 12) - 1), k) * (1 + {C.INTERVAL_PCT}) AS forecast_price_high,
    state, property_type, median_price AS last_actual
  FROM fc_k)"""

BASE.extend([FEATURES, FORECAST])


# ------------------------------------------------------------- investment maths
def _npv(cfs: str, rate: str) -> str:
    return (f"list_reduce(list_transform({cfs}, lambda c, i: c / pow(1 + ({rate}), i - 1)), "
            f"lambda a, x: a + x, CAST(0.0 AS DOUBLE))")


def _npv_nested(cfs: str, rate: str) -> str:
    return (f"list_reduce(list_reverse({cfs}), lambda a, c: a * (1.0 / (1 + ({rate}))) + c, CAST(0.0 AS DOUBLE))")


def _irr(cfs: str, low: float = -1 + 1e-9, high: float = 1e6, steps: int = 60) -> str:
    width = high - low
    s_low = f"sign({_npv_nested(cfs, d(low))})"
    mid = f"(lo + {d(width)} / pow(CAST(2.0 AS DOUBLE), CAST(k AS DOUBLE)))"
    step = f"CASE WHEN sign({_npv_nested(cfs, mid)}) = {s_low} THEN {mid} ELSE lo END"
    root = f"list_reduce(range(1, {steps} + 1), lambda lo, k: {step}, {d(low)})"
    return (f"CASE WHEN {s_low} * sign({_npv_nested(cfs, d(high))}) < 0 "
            f"THEN {root} + {d(width / 2 ** (steps + 1))} END")


def invest_ctes(src: str, fin=None, ops=None, hold=None, prefix: str = "inv") -> list[str]:
    """Mirror of operators.invest.investment_frame over CTE ``src`` (columns:
    the estimate ``avm_estimate``, ``est_monthly_rent``, state, state_tier)."""
    fin, ops, hold = fin or C.Financing(), ops or C.Operating(), hold or C.Hold()
    H = hold.hold_years
    r = f"({d(fin.interest_rate)} / 12)"
    n = f"({d(fin.loan_term_years)} * 12)"
    g = f"pow(1 + {r}, {n})"
    pay = (f"CASE WHEN {r} = 0 THEN loan_amount / {n} "
           f"ELSE loan_amount * ({r} * {g}) / ({g} - 1) END")
    bal = (f"CASE WHEN {r} = 0 THEN loan_amount * (1 - ({H} * 12) / {n}) "
           f"ELSE loan_amount * ({g} - pow(1 + {r}, {H} * 12)) / ({g} - 1) END")

    def noi(y: str) -> str:
        return (f"(monthly_rent * pow(1 + {d(hold.annual_rg)}, {y} - 1) * 12 * (1 - vacancy_rate) - annual_opex)")

    known = ", ".join(q(k) for k in C.TIER_ASSUMPTIONS)
    p = prefix
    last = f"(exit_value * (1 - {d(hold.selling_cost_pct)}) - balance_exit)"
    cf_t = f"({noi('t')} - monthly_payment * 12)"
    return [
        f"""{p}_y AS (
  SELECT s.*, coalesce(y.gross_yield, {d(C.DEFAULT_GROSS_YIELD)}) AS state_gross_yield,
    TRY_CAST(s.avm_estimate AS DOUBLE) AS price_
  FROM {src} s LEFT JOIN {YIELD_DIM} y ON s.state = y.state)""",
        f"""{p}_r AS (
  SELECT *, CASE WHEN est_monthly_rent IS NOT NULL AND est_monthly_rent > 0 THEN est_monthly_rent
                 ELSE price_ * state_gross_yield / 12 END AS rent_
  FROM {p}_y)""",
        f"""{p}_t AS (
  SELECT x.* EXCLUDE (state_tier), coalesce(x.state_tier, 'other') AS state_tier,
    a.tax_rate, a.insurance_rate, a.mgmt_fee_pct, a.maintenance_pct, a.vacancy_rate, a.annual_pg, a.exit_cap_rate
  FROM {p}_r x LEFT JOIN {ASSUMPTION_DIM} a
    ON a.state_tier = CASE WHEN coalesce(x.state_tier, 'other') IN ({known}) THEN coalesce(x.state_tier, 'other')
                           ELSE 'other' END
  WHERE x.price_ > 0 AND x.rent_ > 0)""",
        f"""{p}_1 AS (
  SELECT *, price_ AS purchase_price, rent_ AS monthly_rent,
    price_ * (1 - {d(fin.down_payment_pct)}) AS loan_amount,
    price_ * ({d(fin.down_payment_pct)} + {d(fin.closing_cost_pct)}) AS total_cash_in
  FROM {p}_t)""",
        f"""{p}_2 AS (
  SELECT *, {pay} AS monthly_payment,
    monthly_rent * (1 - vacancy_rate) * 12 * (mgmt_fee_pct + {d(ops.capex_pct)})
      + purchase_price * (tax_rate + insurance_rate + maintenance_pct) + {d(ops.hoa_monthly)} * 12 AS annual_opex
  FROM {p}_1)""",
        f"""{p}_3 AS (
  SELECT *, {noi('1')} AS noi_yr1, {noi(str(H))} AS noi_exit, {bal} AS balance_exit FROM {p}_2)""",
        f"""{p}_4 AS (
  SELECT *, noi_yr1 - monthly_payment * 12 AS cash_flow_yr1,
    (purchase_price * pow(1 + annual_pg, {H}) + noi_exit / exit_cap_rate) / 2 AS exit_value
  FROM {p}_3)""",
        f"""{p}_5 AS (
  SELECT *, list_transform(range(0, {H} + 1), lambda t: CASE WHEN t = 0 THEN -total_cash_in
      ELSE {cf_t} + CASE WHEN t = {H} THEN {last} ELSE CAST(0.0 AS DOUBLE) END END) AS cash_flows
  FROM {p}_4)""",
        f"""{p} AS (
  SELECT *, monthly_rent * 12 / purchase_price AS gross_yield,
    noi_yr1 / purchase_price AS cap_rate,
    CASE WHEN total_cash_in > 0 THEN cash_flow_yr1 / total_cash_in END AS cash_on_cash_yr1,
    CASE WHEN monthly_payment > 0 THEN noi_yr1 / (monthly_payment * 12) END AS dscr_yr1,
    {_irr('cash_flows')} AS irr,
    {_npv('cash_flows', d(hold.discount_rate))} AS npv,
    CAST({H} AS BIGINT) AS hold_years
  FROM {p}_5)""",
    ]


RENT_AND_INVEST = [
    f"""rent_est AS (
  SELECT a.*, coalesce(y.gross_yield, {d(C.DEFAULT_GROSS_YIELD)}) AS gross_yield, z.zip_est_rent,
    greatest({d(C.RENT_MODEL_WEIGHT)} * greatest(coalesce(z.zip_est_rent, CAST(0.0 AS DOUBLE)), CAST(0.0 AS DOUBLE))
      + {d(C.RENT_YIELD_WEIGHT)} * (a.price * coalesce(y.gross_yield, {d(C.DEFAULT_GROSS_YIELD)}) / 12),
      CAST(0.0 AS DOUBLE)) AS est_monthly_rent
  FROM active a LEFT JOIN zip_ctx z ON a.state = z.state AND a.zip_code = z.zip_code
  LEFT JOIN {YIELD_DIM} y ON a.state = y.state)""",
    """rent_addr AS (
  SELECT street, city, state, zip_code,
    quantile_disc(est_monthly_rent, 0.5) AS est_monthly_rent
  FROM rent_est GROUP BY street, city, state, zip_code)""",
    """tier_addr AS (
  SELECT street, city, state, zip_code, max(state_tier) AS state_tier FROM active
  GROUP BY street, city, state, zip_code)""",
    """inv_src AS (
  SELECT listing_id, street, city, state, zip_code, price AS avm_estimate, est_monthly_rent, state_tier
  FROM rent_est)""",
    """inv_join AS (
  SELECT a.listing_id, a.street, a.city, a.state, a.zip_code, a.price AS avm_estimate,
    r.est_monthly_rent, t.state_tier
  FROM active a
  LEFT JOIN rent_addr r ON a.street IS NOT DISTINCT FROM r.street AND a.city IS NOT DISTINCT FROM r.city
    AND a.state IS NOT DISTINCT FROM r.state AND a.zip_code IS NOT DISTINCT FROM r.zip_code
  LEFT JOIN tier_addr t ON a.street IS NOT DISTINCT FROM t.street AND a.city IS NOT DISTINCT FROM t.city
    AND a.state IS NOT DISTINCT FROM t.state AND a.zip_code IS NOT DISTINCT FROM t.zip_code)""",
] + invest_ctes("inv_src")

BASE.extend(RENT_AND_INVEST)


def monte_carlo_select(n_draws: int, src: str = "inv", hold=None, ops=None,
                       quantiles=(0.1, 0.5, 0.9), spread=None) -> str:
    """Mirror of operators.invest.monte_carlo over ``src``."""
    from plotline.operators.invest import MC_SPREAD
    hold, ops, spread = hold or C.Hold(), ops or C.Operating(), spread or MC_SPREAD
    H = hold.hold_years

    def u(tag: str) -> str:
        return (f"(CAST(('0x' || substr(md5(concat_ws('|', CAST(listing_id AS VARCHAR), CAST(i AS VARCHAR), "
                f"'{tag}')), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))")

    rg = f"({d(hold.annual_rg)} + (2 * {u('rg')} - 1) * {d(spread['annual_rg'])})"
    pg = f"(annual_pg + (2 * {u('pg')} - 1) * {d(spread['annual_pg'])})"
    vs = d(spread["vacancy_scale"])
    vac = f"(vacancy_rate * (1 - {vs} + 2 * {vs} * {u('vac')}))"
    opex = (f"(monthly_rent * (1 - {vac}) * 12 * (mgmt_fee_pct + {d(ops.capex_pct)}) + purchase_price * "
            f"(tax_rate + insurance_rate + maintenance_pct) + {d(ops.hoa_monthly)} * 12)")

    def noi(y: str) -> str:
        return f"(monthly_rent * pow(1 + {rg}, {y} - 1) * 12 * (1 - {vac}) - {opex})"

    exit_v = f"((purchase_price * pow(1 + {pg}, {H}) + {noi(str(H))} / exit_cap_rate) / 2)"
    last = f"({exit_v} * (1 - {d(hold.selling_cost_pct)}) - balance_exit)"
    term = (f"(CASE WHEN t = 0 THEN -total_cash_in ELSE {noi('t')} - monthly_payment * 12 + "
            f"CASE WHEN t = {H} THEN {last} ELSE CAST(0.0 AS DOUBLE) END END) / pow(1 + {d(hold.discount_rate)}, t)")
    npv = f"list_reduce(list_transform(range(0, {H} + 1), lambda t: {term}), lambda a, x: a + x, CAST(0.0 AS DOUBLE))"
    npvs = f"list_sort(list_transform(range(1, {n_draws} + 1), lambda i: {npv}))"
    cols = []
    for q in quantiles:
        idx = max(1, -(-int(round(q * n_draws * 1e6)) // 10 ** 6))
        cols.append(f"{r(f'npvs[{idx}]')} AS npv_p{int(round(q * 100))}")
    cols.append(f"{r(f'len(list_filter(npvs, lambda x: x > 0)) / {d(n_draws)}')} AS prob_npv_positive")
    return f"SELECT listing_id, {', '.join(cols)} FROM (SELECT listing_id, {npvs} AS npvs FROM {src}) t"

"""Registered queries: market pieces, forecast, investment maths."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import config as C
from plotline import oracle as O
from plotline.operators import forecast as FC
from plotline.operators import invest as IV
from plotline.operators import market as MK
from plotline.operators import silver as SV
from plotline.plans import common as P
from plotline.plans.catalog import register, sel

SOLD_AGG = ["state", "zip_code", "property_type", "state_tier", "sold_count", "median_sold_price",
            "median_price_per_sqft", "avg_hold_years", "zip_median_income", "zip_unemployment",
            "zip_vacancy_rate", "zip_owner_occ_rate"]


@register("market_sold_agg", O.with_base(f"SELECT {sel(SOLD_AGG)} FROM sold_agg"))
def q_market_sold_agg(spark, sf):
    """G-1."""
    return P.rounded(MK.market_sold_agg(P.sold_df(spark, sf)))


@register("market_active_agg", O.with_base(
    f"SELECT {sel(['state', 'zip_code', 'property_type', 'active_listing_count', 'median_list_price'])} "
    "FROM active_agg"))
def q_market_active_agg(spark, sf):
    """G-2."""
    return P.rounded(MK.market_active_agg(P.active_df(spark, sf)))


@register("join_sold_active", O.with_base(
    f"SELECT {sel(['state', 'zip_code', 'property_type', 'sold_count', 'active_listing_count', 'median_list_price'])}"
    " FROM sold_agg s LEFT JOIN active_agg a USING (state, zip_code, property_type)"))
def q_join_sold_active(spark, sf):
    """J-3: the two aggregates joined on the three segment keys (both sides are
    hash-partitioned on those keys, so the join adds no exchange)."""
    s = P.silver_df(spark, sf)
    sold = MK.market_sold_agg(SV.sold_listings(s))
    act = MK.market_active_agg(SV.active_listings(s))
    return P.rounded(sold.join(act, MK.SEGMENT, "left")
                     .select(*MK.SEGMENT, "sold_count", "active_listing_count", "median_list_price"))


def market_projection(key, cols):
    @register(key, O.with_base(f"SELECT {sel(['state', 'zip_code', 'property_type', *cols])} FROM market"))
    def fn(spark, sf):
        return P.rounded(P.market_df(spark, sf).select("state", "zip_code", "property_type", *cols))
    return fn


market_projection("join_yield_dim", ["gross_yield"])
market_projection("estimated_rent", ["estimated_monthly_rent"])
market_projection("price_to_rent", ["price_to_rent_ratio"])
market_projection("months_of_supply", ["months_of_supply"])


@register("approx_median", O.with_base(
    f"SELECT state, {O.r('quantile_disc(price, 0.5)')} AS median_price FROM active GROUP BY state"))
def q_approx_median(spark, sf):
    """G-5: approximate median (an actual element) per state."""
    return P.rounded(P.active_df(spark, sf).groupBy("state")
                     .agg(F.percentile_approx("price", 0.5).alias("median_price")))


# ------------------------------------------------------------------ forecast
@register("baseline_medians", O.with_base(
    f"SELECT {sel(['state', 'property_type', 'state_tier', 'median_price', 'count'])} FROM baseline"))
def q_baseline_medians(spark, sf):
    """G-4 + P-11 + P-14."""
    return P.rounded(FC.baseline_medians(P.active_df(spark, sf)))


@register("having_min_count", O.with_base("SELECT state, property_type, count FROM baseline"))
def q_having_min_count(spark, sf):
    """P-14: only segments with at least 3 priced listings."""
    return FC.baseline_medians(P.active_df(spark, sf)).select("state", "property_type", "count")


@register("forecast_baseline", O.with_base(
    f"SELECT {sel(['state', 'property_type', 'state_tier', 'median_price', 'annual_rate'])} FROM fc_seg"))
def q_forecast_baseline(spark, sf):
    """F-1."""
    return P.rounded(FC.forecast_baseline(FC.baseline_medians(P.active_df(spark, sf)))
                     .select("state", "property_type", "state_tier", "median_price", "annual_rate"))


FC_COLS = ["forecast_month", "forecast_price", "forecast_price_low", "forecast_price_high", "state",
           "property_type", "last_actual"]


@register("forecast_path", O.with_base(f"SELECT {sel(FC_COLS)} FROM forecast"))
def q_forecast_path(spark, sf):
    """F-2."""
    seg = FC.forecast_baseline(FC.baseline_medians(P.active_df(spark, sf)))
    return P.rounded(FC.forecast_path(seg, C.FORECAST_HORIZON, C.ADAPTER_AS_OF))


@register("forecast_all", O.with_base(f"SELECT {sel(FC_COLS)} FROM forecast"))
def q_forecast_all(spark, sf):
    """F-3 / C-6: all segments, 12 months."""
    return P.rounded(FC.price_forecasts(P.active_df(spark, sf), C.ADAPTER_AS_OF))


# ---------------------------------------------------------------- investment
@register("rent_blend", O.with_base(
    f"SELECT {sel(['listing_id', 'est_monthly_rent'])}, {O.r('est_monthly_rent * 12')} AS est_annual_rent "
    "FROM rent_est"))
def q_rent_blend(spark, sf):
    """P-41."""
    return P.rounded(P.rent_estimates_df(spark, sf).select("listing_id", "est_monthly_rent", "est_annual_rent"))


@register("join_rent_left", O.with_base(f"SELECT {sel(['listing_id', 'est_monthly_rent'])} FROM inv_join"))
def q_join_rent_left(spark, sf):
    """J-7."""
    return P.rounded(P.invest_join_df(spark, sf).select("listing_id", "est_monthly_rent"))


@register("join_active_left", O.with_base("SELECT listing_id, state_tier FROM inv_join"))
def q_join_active_left(spark, sf):
    """J-8."""
    return P.invest_join_df(spark, sf).select("listing_id", "state_tier")


def invest_projection(key, cols, doc):
    @register(key, O.with_base(f"SELECT {sel(['listing_id', *cols])} FROM inv"))
    def fn(spark, sf):
        return P.rounded(P.invest_frame_df(spark, sf).select("listing_id", *cols))
    fn.__doc__ = doc
    return fn


invest_projection("rent_fallback", ["rent_"], "F-17")
invest_projection("filter_positive_inputs", ["price_", "rent_"], "P-13")
invest_projection("dict_lookup_join", ["state_gross_yield", "state_tier", *C.TIER_ASSUMPTION_COLUMNS], "J-10")
invest_projection("loan_terms", ["loan_amount", "total_cash_in"], "F-4")
invest_projection("monthly_payment", ["monthly_payment"], "F-5")
invest_projection("annual_opex", ["annual_opex"], "F-6")
invest_projection("exit_value", ["exit_value"], "F-10")
invest_projection("yield_ratios", ["gross_yield", "cap_rate", "cash_on_cash_yr1", "dscr_yr1"], "F-11")
invest_projection("npv", ["npv"], "F-12")
invest_projection("irr", ["irr"], "F-13")
invest_projection("investment_summary", IV.SUMMARY_COLUMNS, "F-14")


@register("investment_scores", O.with_base(
    f"SELECT {sel(['listing_id', *IV.SUMMARY_COLUMNS, *C.ADDRESS_KEYS])}, {O.r('price_')} AS avm_estimate, "
    f"{O.r('rent_')} AS est_rent, state_tier FROM inv"))
def q_investment_scores(spark, sf):
    """F-15 / C-9."""
    df = IV.investment_scores(P.invest_source_df(spark, sf), keep=("listing_id", *C.ADDRESS_KEYS))
    return P.rounded(df)


_SCHED = (f"SELECT listing_id, y AS year, "
          f"monthly_rent * pow(1 + {O.d(C.Hold().annual_rg)}, y - 1) * 12 * (1 - vacancy_rate) - annual_opex AS noi, "
          f"monthly_rent * pow(1 + {O.d(C.Hold().annual_rg)}, y - 1) * 12 * (1 - vacancy_rate) - annual_opex "
          f"- monthly_payment * 12 AS cash_flow, "
          f"loan_amount * (pow(1 + {O.d(C.Financing().interest_rate)} / 12, {O.d(C.Financing().loan_term_years)} * 12)"
          f" - pow(1 + {O.d(C.Financing().interest_rate)} / 12, y * 12)) / "
          f"(pow(1 + {O.d(C.Financing().interest_rate)} / 12, {O.d(C.Financing().loan_term_years)} * 12) - 1)"
          f" AS balance FROM (SELECT *, unnest(range(1, {C.Hold().hold_years} + 1)) AS y FROM inv)")


def schedule_projection(key, col_name, doc):
    @register(key, O.with_base(
        f"SELECT listing_id, CAST(year AS INTEGER) AS year, {O.r(col_name)} AS {col_name} FROM ({_SCHED}) t"))
    def fn(spark, sf):
        return P.rounded(IV.cash_flow_schedule(P.invest_frame_df(spark, sf)).select("listing_id", "year", col_name))
    fn.__doc__ = doc
    return fn


schedule_projection("noi_by_year", "noi", "F-7")
schedule_projection("cash_flow_by_year", "cash_flow", "F-8")
schedule_projection("loan_balance", "balance", "F-9")


_FALLBACK_SRC = ("fb_src AS (SELECT listing_id, state, state_tier, price AS avm_estimate, "
                 "CAST(NULL AS DOUBLE) AS est_monthly_rent FROM active)")
_WRITTEN_SRC = ("wr_src AS (SELECT i.listing_id, i.state, a.state_tier, i.avm_estimate, i.est_monthly_rent FROM inv_join i "
                "JOIN (SELECT DISTINCT listing_id, state_tier FROM active) a USING (listing_id))")


def _branch(name: str, frame: str) -> str:
    return f"SELECT listing_id, '{name}' AS rent_table, {O.r('rent_')} AS rent_, {O.r('irr')} AS irr FROM {frame}"


@register("table_exists_fallback", O.with_base(
    f"{_branch('absent', 'fb')} UNION ALL {_branch('written', 'wr')}",
    _FALLBACK_SRC, *O.invest_ctes("fb_src", prefix="fb"), _WRITTEN_SRC, *O.invest_ctes("wr_src", prefix="wr")))
def q_table_exists_fallback(spark, sf):
    """S-10: the rent table's rent (by address) when the table exists, else a
    null rent (then F-17 falls back to the yield rent). Both branches run."""
    from plotline.session import scratch_path
    base = scratch_path(spark, f"gold/{P.sf_key(spark, sf)}")
    P.rent_estimates_df(spark, sf).write.mode("overwrite").parquet(f"{base}/rent_estimates")
    est = P.active_df(spark, sf).select("listing_id", *C.ADDRESS_KEYS, "state_tier", F.col("price").alias("avm_estimate"))
    out = None
    for name, table in (("absent", "rent_estimates_never_written"), ("written", "rent_estimates")):
        df = IV.investment_frame(IV.with_rent_table(est, f"{base}/{table}"))
        df = df.select("listing_id", F.lit(name).alias("rent_table"), "rent_", "irr")
        out = df if out is None else out.unionByName(df)
    return P.rounded(out)


MC_DRAWS = 100


@register("investment_monte_carlo", O.with_base(O.monte_carlo_select(MC_DRAWS)))
def q_investment_monte_carlo(spark, sf):
    """F-16: NPV distribution over 100 repeatable scenarios per listing."""
    mc = IV.monte_carlo(P.invest_frame_df(spark, sf), MC_DRAWS)
    return P.rounded(mc.select("listing_id", "npv_p10", "npv_p50", "npv_p90", "prob_npv_positive"))


@register("forecast", O.with_base(f"SELECT {sel(FC_COLS)} FROM forecast"))
def q_forecast(spark, sf):
    """C-6: the table that the batch run's forecast stage writes (baselines >= 3 listings, tier rates, 12 months)."""
    from plotline.plans.queries_models import batch
    return P.rounded(batch(spark, sf, "forecasts").read("price_forecasts").drop("generated_at"))


@register("investment", O.with_base(
    f"SELECT {sel(['listing_id', *IV.SUMMARY_COLUMNS, *C.ADDRESS_KEYS])}, {O.r('price_')} AS avm_estimate, "
    f"{O.r('rent_')} AS est_rent, state_tier FROM inv"))
def q_investment(spark, sf):
    """C-9: the investment run over the estimate, rent and tier tables."""
    return q_investment_scores(spark, sf)


_RENT_TRAIN = "census_median_gross_rent BETWEEN 200 AND 10000 AND quality_score >= 0.6"


@register("min_rows_guard", O.with_base(
    f"SELECT listing_id, census_median_gross_rent FROM prop WHERE {_RENT_TRAIN} "
    f"AND (SELECT count(*) FROM prop WHERE {_RENT_TRAIN}) >= {C.MIN_TRAIN_ROWS}"))
def q_min_rows_guard(spark, sf):
    """P-15: the rent training rows, or none when fewer than 20 exist (the
    check reads at most 20 rows)."""
    df = P.prop_df(spark, sf).filter(F.col("census_median_gross_rent").between(200, 10_000)
                                     & (F.col("quality_score") >= 0.6)).select("listing_id", "census_median_gross_rent")
    return df if df.limit(C.MIN_TRAIN_ROWS).count() >= C.MIN_TRAIN_ROWS else df.limit(0)

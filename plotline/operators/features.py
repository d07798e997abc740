"""Gold feature tables: property (valuation) features and lead features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import config as C
from plotline.functions.columns import address_key_keep_null, address_key_skip_null, flag, guarded_ratio

ZIP_CONTEXT = {
    "zip_median_price": "median_sold_price",
    "zip_median_ppsqft": "median_price_per_sqft",
    "zip_sold_count": "sold_count",
    "zip_active_count": "active_listing_count",
    "zip_gross_yield": "gross_yield",
    "zip_est_rent": "estimated_monthly_rent",
    "zip_ptr_ratio": "price_to_rent_ratio",
    "zip_avg_hold_years": "avg_hold_years",
}
LEAD_CONTEXT = {
    "zip_current_median": "median_sold_price",
    "zip_gross_yield": "gross_yield",
    "zip_vacancy_rate": "zip_vacancy_rate",
    "zip_unemployment": "zip_unemployment",
}
CONTEXT_KEYS = ("state", "zip_code")


def zip_context(market: DataFrame, mapping: dict[str, str] = ZIP_CONTEXT,
                keys: Sequence[str] = CONTEXT_KEYS, property_type: str = "SFR") -> DataFrame:
    """P-44: the SFR rows of the market snapshot, projected and renamed."""
    return (market.filter(F.col("property_type") == property_type)
            .select(*keys, *[F.col(src).alias(dst) for dst, src in mapping.items()]))


def join_context(df: DataFrame, ctx: DataFrame, keys: Sequence[str] = CONTEXT_KEYS) -> DataFrame:
    """J-5 / J-6: left join to a zip context.

    The default keys are (state, zip_code), the grain of the snapshot, so a
    listing matches at most one context row. Pass keys=("zip_code",) for the
    zip-only join (a zip present in two states then matches twice). The
    planner broadcasts the context if its measured size allows.
    """
    return df.join(ctx, list(keys), "left")


def indicator_columns() -> dict[str, Column]:
    """P-29 indicators (null comparisons stay null)."""
    tier, ptype, bucket = F.col("state_tier"), F.col("property_type"), F.col("sqft_bucket")
    return {
        "tier_coastal": flag(tier == "coastal_premium"),
        "tier_sun_belt": flag(tier == "sun_belt"),
        "tier_midwest": flag(tier == "midwest"),
        "is_multi_family": flag(ptype == "MULTI_FAMILY"),
        "is_condo": flag(ptype == "CONDO"),
        "is_rural": flag(ptype == "RURAL_RESIDENTIAL"),
        "has_census_data": flag(F.col("census_median_income").isNotNull()),
        "sqft_micro": flag(bucket == "micro"),
        "sqft_small": flag(bucket == "small"),
        "sqft_medium": flag(bucket == "medium"),
        "sqft_large": flag(bucket == "large"),
        "sqft_xlarge": flag(bucket == "xlarge"),
    }


def context_ratios() -> dict[str, Column]:
    """P-30."""
    return {
        "price_vs_zip_median": guarded_ratio("price", "zip_median_price"),
        "affordability_ratio": F.when(F.col("census_median_income") > 0,
                                      F.col("price") / (F.col("census_median_income") * 4)).cast("double"),
        "absorption_proxy": guarded_ratio("zip_sold_count", "zip_active_count"),
    }


def property_features(sold: DataFrame, market: DataFrame, keys: Sequence[str] = CONTEXT_KEYS,
                      feature_ts: bool = True) -> DataFrame:
    """C-3: sold listings + zip context + ratios + indicators (+ feature_ts)."""
    df = join_context(sold, zip_context(market, ZIP_CONTEXT, keys), keys)
    df = df.withColumns(context_ratios()).withColumns(indicator_columns())
    return df.withColumn("feature_ts", F.current_timestamp()) if feature_ts else df


def hindsight_columns(appreciation: float = C.HINDSIGHT_APPRECIATION) -> dict[str, Column]:
    """P-31: purchase price estimated back at a fixed yearly appreciation."""
    yrs, price = F.col("years_since_last_sale"), F.col("price")
    approx = F.when(yrs.isNotNull() & (price > 0), price / F.pow(F.lit(appreciation), yrs)).cast("double")
    gain = (price - approx).cast("double")
    return {
        "approx_purchase_price": approx,
        "unrealized_gain_est": gain,
        "unrealized_gain_pct": F.when(approx > 0, gain / approx).cast("double"),
    }


def hold_buckets(years: str = "years_since_last_sale") -> dict[str, Column]:
    """P-25, batch variant: inclusive, overlapping edges (5 is in both 2-5 and 5-10)."""
    y = F.col(years)
    return {
        "hold_0_2": flag(y < 2),
        "hold_2_5": flag(y.between(2, 5)),
        "hold_5_10": flag(y.between(5, 10)),
        "hold_10_plus": flag(y > 10),
        "long_hold": flag(y > 7),
        "very_long_hold": flag(y > 15),
    }


def hold_buckets_request(years: str | Column = "years_since_last_sale") -> dict[str, Column]:
    """P-26, request variant: half-open edges, long_hold >= 10, very_long >= 15;
    a missing, blank or non-numeric value counts as 0 years."""
    y = years if isinstance(years, Column) else F.col(years)
    v = F.coalesce(F.trim(y.cast("string")).try_cast("double"), F.lit(0.0))
    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "hold_0_2": one(v < 2),
        "hold_2_5": one((v >= 2) & (v < 5)),
        "hold_5_10": one((v >= 5) & (v < 10)),
        "hold_10_plus": one(v >= 10),
        "long_hold": one(v >= 10),
        "very_long_hold": one(v >= 15),
    }


def lead_indicators(default_yield: float = C.DEFAULT_GROSS_YIELD) -> dict[str, Column]:
    """P-32."""
    tier, ptype = F.col("state_tier"), F.col("property_type")
    return {
        "high_unrealized_gain": flag(F.col("unrealized_gain_pct") > 0.30),
        "in_sellers_market": flag(F.col("zip_gross_yield") > F.lit(default_yield)),
        "large_lot": flag(F.col("acre_lot") >= 1.0),
        "small_unit": flag(F.col("house_size") < 1200),
        "high_vacancy_area": flag(F.col("census_vacancy_rate") > 0.10),
        "high_unemployment_area": flag(F.col("census_unemployment_rate") > 0.07),
        "tier_coastal": flag(tier == "coastal_premium"),
        "tier_sun_belt": flag(tier == "sun_belt"),
        "tier_midwest": flag(tier == "midwest"),
        "is_condo": flag(ptype == "CONDO"),
        "is_rural": flag(ptype == "RURAL_RESIDENTIAL"),
        "is_multi_family": flag(ptype == "MULTI_FAMILY"),
    }


def lead_features(all_df: DataFrame, market: DataFrame, keys: Sequence[str] = CONTEXT_KEYS,
                  feature_ts: bool = True) -> DataFrame:
    """C-4: listings with a prior sale + SFR context + hindsight gain + flags."""
    df = all_df.filter(F.col("has_prior_sale") == 1)
    df = join_context(df, zip_context(market, LEAD_CONTEXT, keys), keys)
    df = df.withColumns(hindsight_columns())
    df = df.withColumns({**hold_buckets(), **lead_indicators()})
    return df.withColumn("feature_ts", F.current_timestamp()) if feature_ts else df


# ------------------------------------------------------- address / relisting
def address_set(df: DataFrame, cols: Sequence[str] = ("street", "city", "state")) -> DataFrame:
    """S-13 / G-9: distinct skip-null address keys (column ``a``)."""
    return df.select(address_key_skip_null(*cols).alias("a")).distinct()


def relisted_addresses(sold: DataFrame, active: DataFrame) -> DataFrame:
    """T-1: addresses both sold and for sale (distinct, null-safe)."""
    return address_set(sold).intersect(address_set(active))


def flag_relisted(df: DataFrame, relisted: DataFrame, cols: Sequence[str] = ("street", "city", "state"),
                  out: str = "relisted") -> DataFrame:
    """J-9: 1 when the keep-null address of the row is in the relisted set.

    The relisted set is distinct, so the left join never multiplies rows;
    AQE broadcasts it if it is small and splits a skewed address partition
    otherwise."""
    r = relisted.select(F.col("a").alias("_addr"), F.lit(1).alias(out))
    keyed = df.withColumn("_addr", address_key_keep_null(*cols))
    return keyed.join(r, "_addr", "left").withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_addr")


def motivated_label(relisted: str = "relisted") -> Column:
    """M-10: relisted OR very long hold OR (long hold AND sellers market); a
    missing flag counts as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return (z(relisted) | z("very_long_hold") | (z("long_hold") & z("in_sellers_market"))).cast("int")


def with_motivated_label(lead: DataFrame, sold: DataFrame, active: DataFrame) -> DataFrame:
    df = flag_relisted(lead, relisted_addresses(sold, active))
    return df.withColumn("motivated_seller", motivated_label())

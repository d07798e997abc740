"""Silver: sanity filters, derived columns, tier join, census, splits."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import config as C
from plotline.functions import columns as X
from plotline.functions.dims import join_literal_dim, tier_dim
from plotline.sources.census import join_census


# ----------------------------------------------------------------- filters
def price_in_range(lo: float = C.PRICE_MIN, hi: float = C.PRICE_MAX, c: str = "price") -> Column:
    """P-1: inclusive range; null fails."""
    return F.col(c).between(lo, hi)


def null_or_range(c: str, lo: float | None, hi: float) -> Column:
    """P-2: null passes, otherwise inside the (inclusive) range / under the maximum."""
    v = F.col(c)
    return v.isNull() | (v.between(lo, hi) if lo is not None else v <= hi)


def sanity_predicate() -> Column:
    """P-1..P-4 as one predicate (pushed to the scan where the source allows)."""
    return (price_in_range()
            & null_or_range("house_size", C.SQFT_MIN, C.SQFT_MAX)
            & null_or_range("bed", None, C.BEDS_MAX)
            & null_or_range("bath", None, C.BATHS_MAX)
            & null_or_range("acre_lot", None, C.ACRE_LOT_MAX)
            & F.col("status").isin(*C.VALID_STATUSES)
            & F.col("state").isNotNull() & F.col("zip_code").isNotNull())


def filter_valid(df: DataFrame) -> DataFrame:
    return df.filter(sanity_predicate())


# ---------------------------------------------------------- derived columns
def derived_columns(as_of: _dt.date) -> dict[str, Column]:
    """P-20..P-24 and P-27 (lot_to_living_ratio is written on lot_sqft's expression
    so the whole dict can go into one projection)."""
    lot_sqft = (F.col("acre_lot") * C.ACRE_TO_SQFT).cast("double")
    return {
        "price_per_sqft": X.guarded_ratio("price", "house_size"),
        "property_type": X.property_type(),
        "bath_bed_ratio": X.guarded_ratio("bath", "bed"),
        "lot_sqft": lot_sqft,
        "lot_to_living_ratio": X.guarded_ratio(lot_sqft, "house_size"),
        "years_since_last_sale": X.years_since("prev_sold_date", as_of),
        "has_prior_sale": F.col("prev_sold_date").isNotNull().cast("int"),
        "sqft_bucket": X.sqft_bucket(),
        "price_tier": X.price_tier(),
        "quality_score": X.quality_score(),
    }


def add_state_tier(df: DataFrame, spark: SparkSession | None = None, mapping: dict | None = None) -> DataFrame:
    """J-1 + P-42: left join to the literal tier dim (broadcast), default 'other'."""
    spark = spark or df.sparkSession
    out = join_literal_dim(df, tier_dim(spark, mapping), "state", "left")
    return out.withColumn("state_tier", F.coalesce(F.col("state_tier"), F.lit(C.DEFAULT_TIER)))


def silver(bronze_df: DataFrame, census: DataFrame | None, as_of: _dt.date) -> DataFrame:
    """C-2 listing table (before the quality splits)."""
    df = filter_valid(bronze_df).withColumns(derived_columns(as_of))
    df = add_state_tier(df)
    return join_census(df, census)


# ------------------------------------------------------------------ splits
def is_sold(min_quality: float = C.SOLD_MIN_QUALITY) -> Column:
    return ((F.col("status") == "sold") & (F.col("quality_score") >= min_quality)
            & F.col("house_size").isNotNull())


def is_active(min_quality: float = C.ACTIVE_MIN_QUALITY) -> Column:
    return (F.col("status") == "for_sale") & (F.col("quality_score") >= min_quality)


def sold_listings(df: DataFrame) -> DataFrame:
    """P-5."""
    return df.filter(is_sold())


def active_listings(df: DataFrame) -> DataFrame:
    """P-6."""
    return df.filter(is_active())


def all_listings(df: DataFrame, min_quality: float = C.ALL_MIN_QUALITY) -> DataFrame:
    """P-7."""
    return df.filter(F.col("quality_score") >= min_quality)

"""Market snapshot: per (state, zip, property type) sold/active aggregates."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline import config as C
from plotline.functions.columns import exact_avg, guarded_ratio
from plotline.functions.dims import join_literal_dim, yield_dim
from plotline.operators.silver import is_active, is_sold

SEGMENT = ["state", "zip_code", "property_type"]

SOLD_AVGS = {
    "avg_hold_years": "years_since_last_sale",
    "zip_median_income": "census_median_income",
    "zip_unemployment": "census_unemployment_rate",
    "zip_vacancy_rate": "census_vacancy_rate",
    "zip_owner_occ_rate": "census_owner_occ_rate",
}


def market_sold_agg(sold: DataFrame) -> DataFrame:
    """G-1 on its own: per state, zip, type, tier over sold listings."""
    return (sold.groupBy(*SEGMENT, "state_tier")
            .agg(F.count(F.lit(1)).alias("sold_count"),
                 F.percentile_approx("price", 0.5).alias("median_sold_price"),
                 F.percentile_approx("price_per_sqft", 0.5).alias("median_price_per_sqft"),
                 *[exact_avg(src).alias(name) for name, src in SOLD_AVGS.items()]))


def market_active_agg(active: DataFrame) -> DataFrame:
    """G-2 on its own: per state, zip, type over active listings."""
    return (active.groupBy(*SEGMENT)
            .agg(F.count(F.lit(1)).alias("active_listing_count"),
                 F.percentile_approx("price", 0.5).alias("median_list_price")))


def market_segments(listings: DataFrame) -> DataFrame:
    """G-1 and G-2 in one aggregation over the silver listings.

    The sold and active sets are disjoint filters of the same rows, so one
    groupBy with conditional aggregates replaces two aggregations and the
    left join between them (one shuffle instead of three). The state tier is
    a function of the state, so it is carried with max() instead of being a
    grouping key. Groups without sold rows are dropped, as the left join from
    the sold side would drop them; active columns are null when the group has
    no active rows.
    """
    sold, active = is_sold(), is_active()
    on_sold = lambda c: F.when(sold, F.col(c))
    agg = (listings.filter(sold | active)
           .groupBy(*SEGMENT)
           .agg(F.count_if(sold).alias("sold_count"),
                F.max(on_sold("state_tier")).alias("state_tier"),
                F.percentile_approx(on_sold("price"), 0.5).alias("median_sold_price"),
                F.percentile_approx(on_sold("price_per_sqft"), 0.5).alias("median_price_per_sqft"),
                *[exact_avg(on_sold(src)).alias(name) for name, src in SOLD_AVGS.items()],
                F.count_if(active).alias("_active"),
                F.percentile_approx(F.when(active, F.col("price")), 0.5).alias("median_list_price"))
           .filter(F.col("sold_count") > 0))
    return agg.withColumn("active_listing_count",
                          F.when(F.col("_active") > 0, F.col("_active"))).drop("_active")


def market_ratios(seg: DataFrame, as_of: _dt.date, yields: dict | None = None) -> DataFrame:
    """J-4 + P-35..P-37: yield default, rent, price-to-rent, months of supply."""
    df = join_literal_dim(seg, yield_dim(seg.sparkSession, yields), "state", "left")
    rent = (F.col("median_sold_price") * F.col("gross_yield") / 12).cast("double")
    df = df.withColumn("gross_yield", F.coalesce(F.col("gross_yield"), F.lit(C.DEFAULT_GROSS_YIELD)))
    df = df.withColumn("estimated_monthly_rent", rent)
    return df.withColumns({
        "price_to_rent_ratio": guarded_ratio("median_sold_price", F.col("estimated_monthly_rent") * 12),
        "months_of_supply": guarded_ratio("active_listing_count", F.col("sold_count") / 12.0),
        "snapshot_date": F.lit(as_of),
    })


MARKET_COLUMNS = [
    "state", "zip_code", "property_type", "state_tier", "sold_count", "median_sold_price",
    "median_price_per_sqft", "avg_hold_years", "zip_median_income", "zip_unemployment",
    "zip_vacancy_rate", "zip_owner_occ_rate", "active_listing_count", "median_list_price",
    "gross_yield", "estimated_monthly_rent", "price_to_rent_ratio", "months_of_supply", "snapshot_date",
]


def market_snapshot(listings: DataFrame, as_of: _dt.date, yields: dict | None = None) -> DataFrame:
    """G-3: the market snapshot table from the silver listings."""
    return market_ratios(market_segments(listings), as_of, yields).select(*MARKET_COLUMNS)

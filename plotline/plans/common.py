"""Shared plan pieces for the registered queries: load, clean, enrich."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.config import ADAPTER_AS_OF
from plotline.operators.clean import bronze
from plotline.operators.market import market_snapshot
from plotline.operators.quality import _exists
from plotline.operators.silver import active_listings, all_listings, silver, sold_listings  # noqa: F401
from plotline.sources.census import census_fixture_documents, parse_census
from plotline.session import scratch_path
from plotline.sources.listings import adapter_listings

SCALE = 4


def round_half_up(c, scale: int = SCALE):
    """floor(x * 10^s + 0.5) / 10^s on the binary value (same result in any
    IEEE engine, unlike rounding through a decimal rendering)."""
    p = float(10 ** scale)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.floor(c * p + 0.5) / p)


def rounded(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """Round every double column (the oracle compares rounded doubles)."""
    return df.select(*[round_half_up(F.col(f.name), scale).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def sf_key(spark: SparkSession, sf: str) -> str:
    """A name for the input folder and the state of its files."""
    stamp = ""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/lineitem.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        stamp = str(fs.getFileStatus(path).getModificationTime())
    return hashlib.md5(f"{sf}|{stamp}".encode()).hexdigest()[:12]


def layer(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A shared layer (bronze, silver, market): written once as Parquet under
    the shared folder and read back, so queries over it read only the columns
    and row groups they need and do not recompute what came before. It is
    keyed by application, folder and the state of the folder's files."""
    path = _layer_path(spark, sf, name)
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _layer_path(spark: SparkSession, sf: str, name: str) -> str:
    return scratch_path(spark, f"layers/{sf_key(spark, sf)}/{name}")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return adapter_listings(spark, sf)


def _bronze(spark: SparkSession, sf: str) -> DataFrame:
    return bronze(raw(spark, sf), ADAPTER_AS_OF, source_file=sf, lineage=False)


def bronze_df(spark: SparkSession, sf: str, lineage: bool = False) -> DataFrame:
    if lineage:
        return bronze(raw(spark, sf), ADAPTER_AS_OF, source_file=sf, lineage=True)
    return layer(spark, sf, "bronze", lambda: _bronze(spark, sf))


def census_df(spark: SparkSession, sf: str) -> DataFrame:
    return parse_census(census_fixture_documents(spark, sf))


def silver_df(spark: SparkSession, sf: str) -> DataFrame:
    """Silver from the bronze layer if a query before has written it, else straight from the listings: a query that reads
    silver alone writes no second copy of them."""
    def build():
        written = _exists(spark, f"{_layer_path(spark, sf, 'bronze')}/_SUCCESS")
        return silver(bronze_df(spark, sf) if written else _bronze(spark, sf), census_df(spark, sf), ADAPTER_AS_OF)
    return layer(spark, sf, "silver", build)


def sold_df(spark, sf):
    return sold_listings(silver_df(spark, sf))


def active_df(spark, sf):
    return active_listings(silver_df(spark, sf))


def all_df(spark, sf):
    return all_listings(silver_df(spark, sf))


def market_df(spark, sf):
    return layer(spark, sf, "market", lambda: market_snapshot(silver_df(spark, sf), ADAPTER_AS_OF))


def prop_df(spark, sf):
    from plotline.operators.features import property_features
    s = silver_df(spark, sf)
    return property_features(sold_listings(s), market_df(spark, sf), feature_ts=False)


def lead_df(spark, sf):
    from plotline.operators.features import lead_features
    s = silver_df(spark, sf)
    return lead_features(all_listings(s), market_df(spark, sf), feature_ts=False)


def lead_labeled_df(spark, sf):
    from plotline.operators.features import lead_features, with_motivated_label
    s = silver_df(spark, sf)
    lead = lead_features(all_listings(s), market_df(spark, sf), feature_ts=False)
    return with_motivated_label(lead, sold_listings(s), active_listings(s))


def rent_estimates_df(spark, sf):
    """Rent estimates per active listing: the blend of P-41 with the zip's
    comparable rent standing in for a fitted rent model."""
    from plotline.operators.features import join_context, zip_context
    from plotline.operators.invest import rent_blend, with_state_yield
    s = silver_df(spark, sf)
    ctx = zip_context(market_df(spark, sf), {"zip_est_rent": "estimated_monthly_rent"})
    df = with_state_yield(join_context(active_listings(s), ctx))
    return df.withColumns(rent_blend("zip_est_rent"))


def invest_source_df(spark, sf):
    """Active listings (estimate = list price) with the rent estimate and tier
    of the same row: both come from one table, so no join is needed."""
    from plotline.config import ADDRESS_KEYS
    return rent_estimates_df(spark, sf).select("listing_id", *ADDRESS_KEYS, F.col("price").alias("avm_estimate"),
                                               "est_monthly_rent", "state_tier")


def invest_join_df(spark, sf):
    """J-7 + J-8 for estimates, rents and listings that are separate tables:
    the rent and the tier of an address, both collapsed to one row per address
    first, then left-joined null-safe (no fan-out)."""
    from plotline.config import ADDRESS_KEYS
    from plotline.functions.joins import left_join_null_safe, one_per_key
    active = active_df(spark, sf)
    rent = one_per_key(rent_estimates_df(spark, sf), ADDRESS_KEYS,
                       {"est_monthly_rent": F.percentile_approx("est_monthly_rent", 0.5)})
    tier = one_per_key(active, ADDRESS_KEYS, {"state_tier": F.max("state_tier")})
    est = active.select("listing_id", *ADDRESS_KEYS, F.col("price").alias("avm_estimate"))
    return left_join_null_safe(left_join_null_safe(est, rent, ADDRESS_KEYS), tier, ADDRESS_KEYS)


def invest_frame_df(spark, sf):
    from plotline.operators.invest import investment_frame
    return investment_frame(invest_source_df(spark, sf))

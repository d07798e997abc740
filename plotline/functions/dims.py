"""Small literal dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import config as C

def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from driver-side values, built JVM-side (``inline`` of
    literal structs, folded to a local relation): no Python worker is needed
    on the executors to read it."""
    from pyspark.sql import types as T
    st = T._parse_datatype_string(schema)
    if not rows or len(rows) > 1000:  # large bounded tables: a plain local DataFrame
        return spark.createDataFrame(rows, st)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def tier_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """state -> state_tier (47 literal rows)."""
    m = C.STATE_TIER if mapping is None else mapping
    return literal_table(spark, list(m.items()), "state string, state_tier string")


def yield_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """state -> gross_yield (23 literal rows; the default is applied by coalesce)."""
    m = C.STATE_GROSS_YIELD if mapping is None else mapping
    return literal_table(spark, [(k, float(v)) for k, v in m.items()], "state string, gross_yield double")


def tier_assumption_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """state_tier -> 7 operating/exit assumptions (4 literal rows)."""
    m = C.TIER_ASSUMPTIONS if mapping is None else mapping
    cols = ", ".join(f"{c} double" for c in C.TIER_ASSUMPTION_COLUMNS)
    return literal_table(spark, [(k, *map(float, v)) for k, v in m.items()], f"state_tier string, {cols}")


def forecast_rate_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    m = C.FORECAST_TIER_RATES if mapping is None else mapping
    return literal_table(spark, [(k, float(v)) for k, v in m.items()], "state_tier string, annual_rate double")


def join_literal_dim(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join to a dimension built from literals: its size is known, so broadcast."""
    return df.join(F.broadcast(dim), on, how)

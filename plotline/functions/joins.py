"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join where a null key matches a null key (``<=>``), as a pandas
    merge does. Spark still plans it as a hash-partitioned equi-join (the
    keys become (coalesce(k), isnull(k)) pairs); AQE splits a skewed side."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


def one_per_key(df: DataFrame, keys: Sequence[str], aggs: dict) -> DataFrame:
    """Collapse ``df`` to one row per key (partial aggregation, so a hot key
    is combined map-side) so a later left join cannot multiply rows."""
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])

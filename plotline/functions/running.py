"""Distributed order statistics: exact medians, running sums, ranks of distinct values.

Medians are a distributed selection over (group, value, count) rows: the rows are dealt into ranges of (group, value),
ranges are summed up, and only the one or two ranges that hold a group's middle ranks are looked into. No task
sees more than a range of a group, however many values the group has, and nothing is collected. Running
sums cut the rows into ranges of the sort order; only the ranges' totals (one row a range) meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.session import discard, written


def number(col: Column) -> Column:
    """A value as a double; null if it is no number. NaN counts as missing, as pandas fills it; infinities are numbers."""
    v = col.try_cast("double")
    return F.when(~F.isnan(v), v)


def _numbers(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys..., _v): the values that are numbers (null and NaN have no rank)."""
    return df.select(*keys, number(F.col(col)).alias("_v")).where(F.col("_v").isNotNull())


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of the range and the keys of two aliased frames; a null key equals itself."""
    return reduce(lambda a, k: a & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")), keys,
                  F.col(f"{left}._range") == F.col(f"{right}._range"))


def group_medians(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Exact interpolated median of ``col`` per group: (keys..., median, n). A null key is a group of its own.

    The medians are written (one row a group); a group without a number has no row.
    """
    keys = list(keys)
    counts = _numbers(df, keys, col).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counts.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "median-ranges")
    totals = ranged.groupBy("_range", *keys).agg(F.sum("_n").alias("_t"))  # a group has one row a range that it reaches
    group = Window.partitionBy(*keys)
    before = F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t")
    placed = totals.select("_range", *keys, "_t", before.alias("_before"), F.sum("_t").over(group).alias("n"))
    # places of the middle values, from 0: one if n is odd, else two
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = (high >= F.col("_before")) & (low < F.col("_before") + F.col("_t"))
    picked = placed.filter(holds).select("_range", *keys, "_before", "n", low.alias("_low"), high.alias("_high"))
    inside = ranged.alias("r").join(picked.alias("p"), _same("r", "p", keys)) \
        .select(*[F.col(f"r.{k}").alias(k) for k in keys], "r._range", "_v", "_n", "_before", "n", "_low", "_high")
    upto = F.col("_before") + F.sum("_n").over(
        Window.partitionBy("_range", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = inside.withColumn("_upto", upto)
    at = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)
    found = walked.groupBy(*keys).agg(F.max(F.when(at(F.col("_low")), F.col("_v"))).alias("_a"),
                                      F.max(F.when(at(F.col("_high")), F.col("_v"))).alias("_b"), F.max("n").alias("n"))
    # equal middles are taken as they are: their mean could be rounded, or infinite minus infinite
    middle = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * 0.5)
    medians = written(found.select(*keys, middle.alias("median"), "n"), "medians")
    discard(ranged)
    return medians


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact interpolated median of each column, selected together; a column without numbers has None."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), number(F.col(c)).alias("v")) for c in cols])).alias("x")).select("x.c", "x.v")
    medians = group_medians(stacked, ["c"], "v")
    found = {r.c: r.median for r in medians.collect()}  # one row a column
    discard(medians)
    return {c: found.get(c) for c in cols}


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``cum_<v>``: the sum of v over the rows ordered at or before this one (``order_col`` is unique).

    The rows are written once, dealt into ranges of ``order_col``. A range's running sum is a window over that
    range; the totals of the ranges before it are added.
    """
    order = F.desc(order_col) if descending else F.asc(order_col)
    ranged = written(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in value_cols])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}") for v in value_cols])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), "_range")  # one row for each range
    return (out.withColumns({f"cum_{v}": F.sum(v).over(inside) + F.col(f"_off_{v}") for v in value_cols})
            .drop("_range", *[f"_off_{v}" for v in value_cols]))


def distinct_ranks(df: DataFrame, col: str) -> DataFrame:
    """(_v, _code): the distinct values of ``col`` as strings with their place 0..n-1 in sorted order."""
    values = df.select(F.col(col).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    ranked = running_totals(values.withColumn("one", F.lit(1)), "_v", ["one"])
    return ranked.select("_v", (F.col("cum_one") - 1).cast("int").alias("_code"))

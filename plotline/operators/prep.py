"""Model preparation as DataFrame operators: imputation, scaling, encoding,
splits and group folds. Only fitted parameters (medians, means, vocabularies,
fold maps) are computed eagerly; the transforms stay lazy column expressions."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.running import column_medians, distinct_ranks, number


# ---------------------------------------------------------------- imputation
def fit_median_fill(df: DataFrame, numeric: Sequence[str]) -> dict[str, float | None]:
    """G-6: exact (interpolated) median of each numeric column; a column that
    is entirely null has median None."""
    return column_medians(df, list(numeric))


def impute(df: DataFrame, numeric: Sequence[str] = (), binary: Sequence[str] = (),
           categorical: Sequence[str] = (), numeric_fill: dict | float = 0.0,
           unknown: str = "unknown") -> DataFrame:
    """M-1 / M-2: numeric -> fill value (per column dict or one constant; a
    non-numeric value is coerced to null first, and NaN is missing; infinities
    are numbers and stay), binary -> 0, category -> 'unknown'. A column whose
    fill is None (all null) is filled with 0."""
    cols = {}
    for c in numeric:
        fill = numeric_fill.get(c) if isinstance(numeric_fill, dict) else numeric_fill
        cols[c] = F.coalesce(number(F.col(c)), F.lit(float(fill) if fill is not None else 0.0))
    for c in binary:
        whole = F.col(c).try_cast("int")
        if dict(df.dtypes)[c] in ("double", "float"):
            whole = F.when(~F.isnan(c), whole)  # NaN would become 0 silently on one engine and an error on another
        cols[c] = F.coalesce(whole, F.lit(0))
    for c in categorical:
        cols[c] = F.coalesce(F.col(c).cast("string"), F.lit(unknown))
    return df.withColumns(cols)


def impute_train(df: DataFrame, numeric, binary=(), categorical=()) -> tuple[DataFrame, dict]:
    """M-1: median fill fitted on ``df`` and applied to it."""
    med = fit_median_fill(df, numeric)
    return impute(df, numeric, binary, categorical, med), med


def add_missing_columns(df: DataFrame, numeric=(), binary=(), categorical=(), unknown: str = "unknown") -> DataFrame:
    """P-45: add absent feature columns with typed defaults (0.0 / 0 / 'unknown')."""
    have = set(df.columns)
    add = {c: F.lit(0.0) for c in numeric if c not in have}
    add.update({c: F.lit(0) for c in binary if c not in have})
    add.update({c: F.lit(unknown) for c in categorical if c not in have})
    return df.withColumns(add) if add else df


# ------------------------------------------------------------------- scaling
def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M-3: mean and population standard deviation per column (one job; a
    zero or undefined deviation becomes 1). Only finite values count: one NaN or
    infinity in a column would leave no mean for its other rows."""
    finite = {c: F.when(F.abs(number(F.col(c))) < F.lit(float("inf")), number(F.col(c))) for c in cols}
    r = df.select(*[F.avg(v).alias(f"m_{c}") for c, v in finite.items()],
                  *[F.stddev_pop(v).alias(f"s_{c}") for c, v in finite.items()]).first()
    out = {}
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        out[c] = (m if m is not None else 0.0, s if (s is not None and s > 0 and not math.isnan(s)) else 1.0)
    return out


def standard_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


# ------------------------------------------------------------------ encoding
def fit_vocabulary(df: DataFrame, col: str) -> DataFrame:
    """M-4: sorted distinct values -> code 0..n-1."""
    return distinct_ranks(df, col)


def ordinal_encode(df: DataFrame, col: str, vocab: DataFrame, out: str | None = None) -> DataFrame:
    """Map through the vocabulary (the planner broadcasts it if it is small); unseen values -> -1."""
    out = out or f"{col}_code"
    j = df.join(vocab, F.col(col).cast("string") == F.col("_v"), "left")
    return j.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1))).drop("_v", "_code")


# -------------------------------------------------------------------- splits
def split_hash(key: Column, seed: int) -> Column:
    """md5 of key and seed: a repeatable pseudo-random order (lowercase hex,
    so string order equals numeric order)."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def exact_split(df: DataFrame, key: str, test_size: float, seed: int = 42, label: str | None = None,
                out: str = "is_test", bucket_hex: int = 4) -> DataFrame:
    """M-6 / M-7: mark exactly ceil(test_size * n) rows (per label value when
    ``label`` is given) as test, taking the first rows in md5(key, seed) order.

    Rows are counted per label and hash prefix (16^bucket_hex prefixes); the
    running sum over a label's prefixes finds the prefix where the cut falls.
    Rows before it are test, rows after it train, and only that prefix's rows
    are ranked by a window. Counts, cuts and ranks stay in tables. (Rows with
    the same key share a hash and land in one prefix.)
    """
    lab = F.col(label) if label else F.lit(0)
    d = df.withColumns({"_h": split_hash(F.col(key), seed), "_lab": lab}).withColumn("_p", F.substring("_h", 1, bucket_hex))
    counts = d.groupBy("_lab", "_p").agg(F.count(F.lit(1)).alias("_n"))
    in_label = Window.partitionBy("_lab")
    upto = F.sum("_n").over(in_label.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = (counts.select("_lab", "_p", "_n", upto.alias("_upto"), F.ceil(F.lit(test_size) * F.sum("_n").over(in_label)).alias("_need"))
            .filter((F.col("_need") > 0) & (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
            .select(F.col("_lab").alias("_l"), F.col("_p").alias("_cut"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_rem")))
    # one row a class: without the hint the planner may deal all rows by class, a class's rows to one task
    d = d.join(F.broadcast(cuts), F.col("_lab").eqNullSafe(F.col("_l")), "left")
    in_cut = F.coalesce(F.col("_p") == F.col("_cut"), F.lit(False))
    w = Window.partitionBy("_lab").orderBy("_h", key)
    # rank only the cut's rows; union (not join) them back, so repeated keys never multiply
    ranked = d.filter(in_cut).withColumn("_in", F.row_number().over(w) <= F.col("_rem"))
    rest = d.filter(~in_cut).withColumn("_in", F.coalesce(F.col("_p") < F.col("_cut"), F.lit(False)))
    return ranked.unionByName(rest).withColumn(out, F.col("_in").cast("int")) \
        .drop("_h", "_lab", "_l", "_p", "_cut", "_rem", "_in")


# --------------------------------------------------------------- group folds
def group_kfold_map(df: DataFrame, group: str, n_folds: int = 3) -> DataFrame:
    """M-8: assign whole groups to folds, largest group first to the fold
    with the fewest rows (ties: lower fold); no group is split.

    The rule is sequential, so one task streams over one row per group and
    holds the fold loads only; the (group, fold) map stays a table."""
    gtype = df.schema[group].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load, seen = [(0, i) for i in range(n_folds)], 0
        for pdf in batches:
            folds = []
            for n in pdf["_n"]:
                rows, i = heapq.heappop(load)
                heapq.heappush(load, (rows + int(n), i))
                folds.append(i)
            seen += len(folds)
            yield pd.DataFrame({group: pdf[group], "fold": pd.Series(folds, dtype="int32")})
        if seen < n_folds:
            raise ValueError(f"{seen} groups cannot make {n_folds} folds")

    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ordered = counts.repartition(1).sortWithinPartitions(F.desc("_n"), F.col(group).cast("string"))
    return ordered.mapInPandas(assign, f"{group} {gtype}, fold int")


def with_folds(df: DataFrame, group: str, n_folds: int = 3, default_group: str = "unknown") -> DataFrame:
    """M-8 + M-9: fold column by group (a missing group is ``default_group``)."""
    g = df.withColumn(group, F.coalesce(F.col(group), F.lit(default_group)))
    return g.join(group_kfold_map(g, group, n_folds), group, "left")

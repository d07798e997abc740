"""Distributed order statistics against brute force."""

import os
import random
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from plotline.functions.running import column_medians, distinct_ranks, group_medians, running_totals
from plotline.operators import metrics as M
from plotline.operators import prep as PR


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_exact_medians_with_ties_and_nulls(spark):
    rng = random.Random(7)
    rows = [(float(rng.choice([1, 2, 2, 3, 5, 8])), rng.random() if rng.random() > 0.2 else None,
             float(rng.randint(0, 10 ** 6))) for _ in range(5001)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    got = column_medians(df, ["a", "b", "c"])
    for i, c in enumerate("abc"):
        vals = [r[i] for r in rows if r[i] is not None]
        assert got[c] == float(np.median(vals)), c


def test_running_totals_matches_cumsum(spark):
    rows = [(float(i), i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "k double, v long").repartition(5)
    out = running_totals(df, "k", ["v"]).orderBy("k").collect()
    assert [r["cum_v"] for r in out] == list(np.cumsum([r[1] for r in rows]))
    down = running_totals(df, "k", ["v"], descending=True).orderBy("k", ascending=False).collect()
    assert [r["cum_v"] for r in down] == list(np.cumsum([r[1] for r in rows[::-1]]))
    assert running_totals(df.filter("false"), "k", ["v"]).count() == 0


def test_distinct_ranks(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "x string").repartition(4)
    assert sorted(map(tuple, distinct_ranks(df, "x").collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_auc_and_ap_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 20))) for _ in range(400)]  # many ties
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df, "y", "s").first()["auc"] - auc) < 1e-12
    ap = 0.0
    for t in sorted(set(s for _, s in rows), reverse=True):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        ap += sum(1 for y, s in rows if s == t and y == 1) / len(pos) * tp / (tp + fp)
    assert abs(M.average_precision(df, "y", "s").first()["average_precision"] - ap) < 1e-12


def test_exact_split_counts(spark):
    rows = [(f"id{i}", i % 4 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "listing_id string, lab boolean").withColumn("lab", F.col("lab").cast("int"))
    out = PR.exact_split(df, "listing_id", 0.2, 42, label="lab", bucket_hex=2)
    counts = {r["lab"]: (r["t"], r["n"]) for r in
              out.groupBy("lab").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect()}
    for lab, (t, n) in counts.items():
        assert t == -(-2 * n // 10)  # ceil(0.2 n)
    again = PR.exact_split(df.repartition(3), "listing_id", 0.2, 42, label="lab", bucket_hex=2)
    assert sorted(out.collect()) == sorted(again.collect())  # repeatable, layout-independent


def test_group_kfold_never_splits_groups(spark):
    rows = [(f"g{i % 11}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long")
    out = PR.with_folds(df, "g", 3)
    per_group = out.groupBy("g").agg(F.countDistinct("fold").alias("k")).collect()
    assert all(r["k"] == 1 for r in per_group)
    assert out.select("fold").distinct().count() == 3


def test_exact_split_with_few_prefixes_keeps_duplicates(spark):
    rows = [(f"id{i % 900}", i % 3 == 0) for i in range(1000)]  # 100 keys appear twice
    df = spark.createDataFrame(rows, "listing_id string, lab boolean").withColumn("lab", F.col("lab").cast("int"))
    out = PR.exact_split(df, "listing_id", 0.3, 7, label="lab", bucket_hex=1)
    assert out.count() == 1000
    counts = out.groupBy("lab").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect()
    for r in counts:
        assert r["t"] == -(-3 * r["n"] // 10)


def test_group_medians_with_a_null_key_and_nan(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["g0", "g1", "g2", None]), float(rng.choice([1, 2, 3, 3, 9])) if rng.random() < 0.5
             else rng.random() * 1000) for _ in range(4000)]
    df = spark.createDataFrame(rows + [("g0", float("nan")), ("g1", None)], "g string, v double").repartition(6)
    got = {r["g"]: (r["median"], r["n"]) for r in group_medians(df, ["g"], "v").collect()}
    for g in set(x for x, _ in rows):
        vals = [v for x, v in rows if x == g]
        assert got[g] == (float(np.median(vals)), len(vals))


def test_nan_scores_take_no_part(spark):
    rows = [(1, 0.9), (0, 0.1), (1, float("nan")), (0, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert M.roc_auc(df, "y", "s").first()["auc"] == 1.0
    assert M.average_precision(df.repartition(4), "y", "s").first()["average_precision"] == 1.0


def test_medians_of_many_values_over_many_ranges(spark):
    """One column of distinct values, small groups and infinities; several ranges hold one group."""
    rng = random.Random(21)
    rows = [("hot", rng.random()) for _ in range(20_000)] + [(f"g{i % 40}", float(rng.randint(0, 50))) for i in range(500)]
    rows += [("inf", float("inf")), ("inf", float("-inf")), ("inf", 3.0), ("high", float("inf")), ("high", float("inf")), ("one", 4.0), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}):
        got = {r["g"]: (r["median"], r["n"]) for r in group_medians(df, ["g"], "v").collect()}
    values = {}
    for g, v in rows:
        if v == v:
            values.setdefault(g, []).append(v)
    assert got["high"] == (float("inf"), 2)
    assert got == {g: (float(np.median(v)) if g != "high" else float("inf"), len(v)) for g, v in values.items()}
    assert group_medians(df.filter("false"), ["g"], "v").count() == 0


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, 0.0), (nan, 1.0, float("inf")), (3.0, 3.0, 2.0), (None, nan, 4.0)], "a double, b double, c double")
    filled, med = PR.impute_train(df, ["a"], ["b"])
    assert med == {"a": 2.0} and sorted((r.a, r.b) for r in filled.collect()) == [(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 3)]
    assert sorted(r.a for r in PR.impute(df, ["a"]).collect()) == [0.0, 0.0, 1.0, 3.0]
    params = PR.fit_standard_scaler(df, ["a", "b", "c"])
    assert params == {"a": (2.0, 1.0), "b": (2.0, 1.0), "c": (2.0, float(np.std([0.0, 2.0, 4.0])))}


def test_scratch_of_a_scope_is_deleted(spark):
    from plotline.session import scratch_path, scratch_scope, written
    folder = scratch_path(spark, "").removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch_scope(spark):
        assert written(spark.range(3).toDF("x"), "in-scope").count() == 3
        assert PR.fit_median_fill(spark.range(5).toDF("x"), ["x"]) == {"x": 2.0}
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before

"""Boosted fits in one gang-scheduled stage, held against the library's fits and plain sums."""

import threading

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plotline.plans import boosting as BO
from plotline.plans import models as MD

WHOLE = dict(max_depth=4, min_instances=3, subsampling_rate=1.0, feature_subset="all", step_size=0.2)


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(1200).select("id", (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                    (F.col("id") % 2).cast("double").alias("flag"))
    noise = F.rand(3) * 6
    rows = VectorAssembler(inputCols=["a", "b", "flag"], outputCol="features").transform(rows).withColumns(
        {"y": F.col("a") * 2 + F.col("b") * F.col("flag") + noise, "c": (F.col("a") + noise > 20).cast("double"),
         "w": F.when(F.col("b") > 5, 2.5).otherwise(1.0)}).select("features", "y", "c", "w", "id").repartition(3).persist()
    rows.count()
    yield rows
    rows.unpersist()


def scores(model, rows):
    return np.array([r.prediction for r in model.transform(rows.orderBy("id")).collect()])


def margins(model, rows):
    return np.array([r.rawPrediction[1] for r in model.transform(rows.orderBy("id")).collect()])


@pytest.mark.parametrize("tasks", [1, 2])
def test_a_fit_without_draws_is_the_library_s(spark, table, tasks, monkeypatch):
    monkeypatch.setattr(BO, "_ROWS", 100)  # so that few rows make a gang
    params = MD.TreeParams(max_iter=8, **WHOLE)
    for estimator, of in ((params.regressor("y"), scores), (params.classifier("c", weightCol="w"), margins)):
        mine, _ = BO.fit(estimator, table, gang=tasks)
        theirs = estimator.fit(table)
        assert mine.getNumTrees == theirs.getNumTrees == 8 and mine.treeWeights == theirs.treeWeights
        assert np.allclose(of(mine, table), of(theirs, table), rtol=1e-9, atol=1e-9)
        assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-6)


def test_patience_ends_a_fit_with_the_library_s_curve(spark, table, monkeypatch):
    monkeypatch.setattr(BO, "_ROWS", 100)
    rows, held = table.filter("id % 4 > 0"), table.filter("id % 4 = 0")
    params = MD.TreeParams(max_iter=60, **{**WHOLE, "step_size": 0.5})
    for estimator, loss in ((params.regressor("y"), "absolute"), (params.regressor("y"), "squared"), (params.classifier("c", weightCol="w"), None)):
        mine, curve = BO.fit(estimator, rows, held, 4, loss, gang=2)
        whole, theirs = MD.fit_patient(estimator, rows, held, 4, loss)
        best, stopped = MD.best_tree(curve, 4)
        assert stopped and len(curve) == best + 5 < 60  # no tree more than patience asks for
        assert np.allclose(curve, theirs[:len(curve)], rtol=1e-6)
        assert mine.getNumTrees == whole.getNumTrees == best + 1


def test_draws_leave_every_row_and_feature_a_part(spark, table, monkeypatch):
    monkeypatch.setattr(BO, "_ROWS", 100)
    params = MD.TreeParams(max_iter=20, max_depth=3, feature_subset="sqrt", step_size=0.3)
    fits = [BO.fit(params.regressor("y"), table, gang=2)[0] for _ in range(2)]
    assert np.array_equal(scores(fits[0], table), scores(fits[1], table))  # the seed decides
    assert all(v > 0 for v in fits[0].featureImportances.toArray())
    y = np.array([r.y for r in table.orderBy("id").collect()])
    assert np.mean((scores(fits[0], table) - y) ** 2) < 0.2 * np.var(y)


def test_thresholds_are_all_gaps_or_equal_shares(spark):
    edges = lambda v: BO.edges(np.array(v, float), np.ones(len(v)), 64)
    assert edges([1, 1, 2, 4]) == [1.5, 3.0] and edges([]) == edges([7, 7]) == []
    many = edges(range(1025))
    assert len(many) == 63 and np.diff(many).min() >= 15 and np.diff(many).max() <= 17
    assert edges([1.0, float("inf")]) == [1.0]
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.range(300_000).repartition(2).select(F.col("id").cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")))
    a, b = BO.thresholds(rows, 64)
    assert b == [0.5, 1.5, 2.5, 3.5] and len(a) == 63
    assert max(abs(t - 300_000 * (k + 1) / 64) for k, t in enumerate(a)) < 3_000


def test_a_gang_adds_up_the_same_sums(tmp_path):
    got = {}

    def work(rank):
        total = BO._Sums(str(tmp_path), rank, 3)
        got[rank] = [total(np.full((2, 2), 10.0 ** rank * (r + 1))) for r in range(20)]

    threads = [threading.Thread(target=work, args=(r,)) for r in range(3)]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert all(np.array_equal(got[k][r], np.full((2, 2), 111.0 * (r + 1))) for k in range(3) for r in range(20))
    assert len(list(tmp_path.iterdir())) == 3  # of the last round alone


def test_missing_values_go_right_and_few_rows_make_a_leaf(spark):
    rows = VectorAssembler(inputCols=["a"], outputCol="features", handleInvalid="keep").transform(spark.createDataFrame(
        [(1.0, 1.0), (2.0, 1.0), (None, 9.0), (None, 9.0)], "a double, y double"))
    params = MD.TreeParams(max_iter=1, **{**WHOLE, "min_instances": 1})
    model, _ = BO.fit(params.regressor("y"), rows)
    got = {(r.a, r.prediction) for r in model.transform(rows).collect()}
    assert got == {(1.0, 1.0), (2.0, 19 / 3), (None, 19 / 3)}  # the one gap lies between 1 and 2
    model, _ = BO.fit(MD.TreeParams(max_iter=2, **{**WHOLE, "min_instances": 3}).regressor("y"), rows)
    assert {r.prediction for r in model.transform(rows).collect()} == {5.0}

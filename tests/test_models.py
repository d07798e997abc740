"""Model invariants on the smallest scale (tiny trees)."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from plotline import config as C
from plotline.operators import forecast as FC
from plotline.plans import common as P
from plotline.plans import models as MD
from plotline.plans.pipeline import Run

from .conftest import SF_SMALL

TINY = MD.TreeParams(max_iter=5, step_size=0.3, max_depth=3)


def test_lead_scores_are_probabilities_and_the_bundle_round_trips(spark, tmp_path):
    lead = MD.fit_lead(P.lead_labeled_df(spark, SF_SMALL), TINY)
    assert lead is not None and lead.metrics["auc"] is not None
    rows = P.lead_df(spark, SF_SMALL)
    scored = lead.predict(rows, fill="zero")
    r = scored.agg(F.min("lead_score").alias("lo"), F.max("lead_score").alias("hi"),
                   F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= r["lo"] <= r["hi"] <= 1.0 and r["n"] == rows.count()
    bad = scored.filter(~(((F.col("lead_score") <= 0.35) & (F.col("lead_tier") == "cool"))
                          | ((F.col("lead_score") > 0.35) & (F.col("lead_score") <= 0.65) & (F.col("lead_tier") == "warm"))
                          | ((F.col("lead_score") > 0.65) & (F.col("lead_tier") == "hot")))).count()
    assert bad == 0
    lead.save(spark, str(tmp_path / "lead"))  # preparation, trees and calibrator, loaded in a new session
    again = MD.Lead.load(spark.newSession(), str(tmp_path / "lead"))
    pick = lambda m: sorted(m.predict(rows).select("listing_id", "margin", "lead_score").collect())
    assert pick(again) == pick(lead) and again.metrics["auc"] == lead.metrics["auc"]


def test_valuation_interval_gate_and_round_trip(spark, tmp_path):
    from plotline.plans.queries_models import active_features
    model = MD.valuation_run(P.prop_df(spark, SF_SMALL), TINY)
    active = active_features(spark, SF_SMALL)
    est = MD.valuation_scores(model, active)
    r = est.agg(F.min("avm_estimate").alias("lo"),
                F.count_if(~((F.col("avm_low") <= F.col("avm_estimate")) & (F.col("avm_estimate") <= F.col("avm_high"))))
                .alias("bad")).first()
    assert r["lo"] > 0 and r["bad"] == 0
    m = model.metrics
    assert m["n"] > 0 and m["mape"] >= 0 and m["gate"]["passed"] == (m["mape"] <= C.AVM_MAX_MAPE)
    assert all(1 <= t <= 5 for t in m["trees"])
    model.save(spark, str(tmp_path / "avm"))
    again = MD.valuation_scores(MD.Valuation.load(spark, str(tmp_path / "avm")), active)
    assert sorted(again.collect(), key=str) == sorted(est.collect(), key=str)


def test_best_tree_follows_patience():
    assert MD.best_tree([3, 2, 1, 2, 2, 0], 2) == (2, True)  # the better round comes too late
    assert MD.best_tree([3, 2, 1, 2, 2, 0], 3) == (5, False)
    assert MD.best_tree([3, 2, 2, 2], 2) == (1, True)
    assert MD.best_tree([1.0], 5) == (0, False)


def test_a_fit_is_cut_at_the_best_tree_of_its_curve(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), "id")
    noise = F.rand(3) * 6
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).withColumns(
        {"y": F.col("a") * 2 + noise, "c": (F.col("a") + noise > 6).cast("double")}).select("features", "y", "c", "id").repartition(2).persist()
    fit, held = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    params = MD.TreeParams(max_iter=40, step_size=0.5, max_depth=4, min_instances=1, subsampling_rate=1.0)
    for estimator, loss in ((params.regressor("y"), "absolute"), (params.classifier("c"), None)):
        model, curve = MD.fit_patient(estimator, fit, held, 4, loss)
        best, stopped = MD.best_tree(curve, 4)
        assert stopped and model.getNumTrees == best + 1 < len(curve) < 40  # it overfits soon
        whole = estimator.copy().setMaxIter(best + 1).fit(fit)  # the same trees as a fit of that many
        assert model.toDebugString.split("\n")[1:] == whole.toDebugString.split("\n")[1:]
        scores = lambda m: [r.prediction for r in m.transform(held.orderBy("id")).collect()]
        assert scores(model) == scores(whole)
    rows.unpersist()


def test_ridge_has_the_stated_penalty(spark):
    from types import SimpleNamespace

    from plotline.plans import walk as W
    for deviation in (0.4, 3.0):
        y = spark.range(500).select((F.randn(1) * deviation + 12).alias("log_price"))
        oof = y.select("log_price", (F.col("log_price") + F.randn(2) * 0.3).alias("b0"), (F.col("log_price") * 0.9 + F.randn(3) * 0.5).alias("b1")).persist()
        meta = MD.fit_ridge(oof)
        assert all(r.residual < 1e-10 for r in W.ridge_gradient(SimpleNamespace(meta=meta, oof=oof)).collect())
        rows = [(r.b0, r.b1, r.log_price) for r in oof.collect()]
        a = np.array(rows) - np.mean(rows, axis=0)
        plain = np.linalg.solve(a[:, :2].T @ a[:, :2] + MD.RIDGE_ALPHA * np.eye(2), a[:, :2].T @ a[:, 2])
        assert np.allclose(meta.coefficients.toArray(), plain, rtol=1e-9)


def test_ridge_of_equal_labels_is_their_value(spark):
    oof = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, 3.0, 5.0)], "b0 double, b1 double, log_price double")
    meta = MD.fit_ridge(oof)
    assert meta.coefficients.toArray().tolist() == [0.0, 0.0] and meta.intercept == 5.0


def test_walks_agree_and_certificates_hold(spark):
    from plotline.plans import walk as W
    from plotline.plans.queries_models import active_features
    model = MD.valuation_run(P.prop_df(spark, SF_SMALL), TINY)
    assert all(r.residual < 1e-6 for r in W.ridge_gradient(model).collect())
    rows = active_features(spark, SF_SMALL).withColumn("row_no", F.monotonically_increasing_id()).persist()
    mine = dict(W.walked_valuation(model, rows, ["row_no"]).collect())
    theirs = dict(model.predict(rows).select("row_no", "avm_estimate").collect())
    assert mine.keys() == theirs.keys() and all(abs(mine[k] / v - 1) < 1e-9 for k, v in theirs.items())
    lead = MD.fit_lead(P.lead_labeled_df(spark, SF_SMALL), TINY)
    assert {r.equation for r in W.platt_gradient(lead).collect() if r.residual < 1e-6} == {"slope", "intercept"}
    leads = P.lead_df(spark, SF_SMALL).withColumn("row_no", F.monotonically_increasing_id()).persist()
    mine = dict(W.walked_lead(lead, leads, ["row_no"]).collect())
    theirs = dict(lead.predict(leads, fill="zero").select("row_no", "lead_score").collect())
    assert mine.keys() == theirs.keys() and all(abs(mine[k] / v - 1) < 1e-9 for k, v in theirs.items())


def test_too_few_rows_give_no_model(spark):
    few = P.prop_df(spark, SF_SMALL).limit(5)
    assert MD.fit_rent(few, TINY) is None
    assert MD.fit_lead(P.lead_labeled_df(spark, SF_SMALL).limit(5), TINY) is None


def test_whole_run_from_a_csv(spark, tmp_path):
    from plotline.sources.listings import adapter_listings, write_listings_csv
    write_listings_csv(adapter_listings(spark, SF_SMALL), str(tmp_path / "csv"))
    run = Run(spark, str(tmp_path / "out"), C.ADAPTER_AS_OF, csv_path=str(tmp_path / "csv"), trees=TINY,
              test_states=("California", "Texas"), down_payment_pct=0.4, interest_rate=0.05, hold_years=3)
    assert set(run.run_all()) == set(Run.STAGES)
    inv = run.read("investment_scores")
    r = inv.agg(F.min("hold_years").alias("h"), F.max(F.abs(F.col("total_cash_in") / F.col("purchase_price") - 0.425)).alias("d")).first()
    assert r["h"] == 3 and r["d"] < 1e-9
    status = {c["table_name"]: c["status"] for c in run.counts().collect()}
    assert status["avm_estimates"] == status["lead_scores"] == status["investment_scores"] == "ok"
    assert sorted(g["metric"] for g in run.gates) == ["avm_mape", "lead_auc"]
    assert inv.count() == run.read("avm_estimates").count()  # own rows: nothing multiplied or lost
    # the saved bundle answers in another session as the models do
    import json
    from plotline.operators import requests as RQ
    from plotline.plans import versions as VS
    seg = run.active().select("state", "property_type", "bed", "price").na.drop().first().asDict()
    asked = [("v", "avm", json.dumps([seg])), ("l", "lead_scoring", json.dumps([seg])), ("f", "price_forecast", json.dumps([seg]))]
    answer = lambda s, models: {r.request_id: r.result for r in RQ.route(
        s.createDataFrame(asked, "request_id string, model_type string, payload string"), C.ADAPTER_AS_OF, **models).collect()}
    other = spark.newSession()
    got = answer(other, VS.serving(other, run.path("models")).models())
    assert got == answer(spark, {"valuation": run.model("valuation", MD.Valuation), "lead": run.model("lead", MD.Lead),
                                 "baseline": FC.baseline_medians(run.active())})
    assert not any("error" in r for r in got.values())


def test_versions_are_promoted_behind_their_gates(spark, tmp_path):
    from plotline.plans import versions as VS
    root = str(tmp_path / "models")
    save = lambda s, path: s.range(1).write.parquet(path)
    gate = lambda v: MD.gated("mape", v, 0.2, at_most=True)
    assert VS.folder(spark, root, "avm") is None
    assert [VS.save_version(spark, root, "avm", save, gate(v)) for v in (0.1, 0.15)] == [1, 2]
    live = VS.folder(spark, root, "avm")
    assert VS.save_version(spark, root, "avm", save, gate(0.5)) == 3
    assert VS.save_version(spark, root, "combined", save) == 1
    got = {(r.model, r.version): r.state for r in VS.states(VS.log(spark, root)).collect()}
    assert got == {("avm", 1): "archived", ("avm", 2): "production", ("avm", 3): "rejected", ("combined", 1): "production"}
    assert VS.folder(spark, root, "avm") == live != VS.last_folder(spark, root, "avm")
    assert spark.read.parquet(live).count() == 1
    assert sorted(map(tuple, VS.latest(VS.log(spark, root)).collect())) == [("avm", 3), ("combined", 1)]


def test_a_stopped_run_goes_on_and_models_overlap(spark, tmp_path, monkeypatch):
    import threading
    ran, meet = [], threading.Barrier(4, timeout=60)
    work = {"silver": lambda self: ran.append("silver"), "investment": lambda self: ran.append("investment")}
    for name in Run.STAGES:
        def stage(self, name=name):
            if name in ("valuation", "rent", "lead", "forecasts"):
                if self.stopped:
                    raise KeyError("stopped")
                meet.wait()  # passes only if all four run at once
            ran.append(name)
        monkeypatch.setattr(Run, name, work.get(name, stage))
    monkeypatch.setattr(Run, "stopped", True, raising=False)
    run = Run(spark, str(tmp_path / "out"), C.ADAPTER_AS_OF, sf_dir=SF_SMALL)
    try:
        run.run_all()
        raise AssertionError("not stopped")
    except KeyError:
        pass
    first = list(ran)
    assert set(first) <= {"bronze", "census", "silver", "market", "features"} and "silver" in first
    monkeypatch.setattr(Run, "stopped", False, raising=False)
    again = Run(spark, run.out, C.ADAPTER_AS_OF, sf_dir=SF_SMALL, run_id=run.run_id)
    again.run_all()
    assert sorted(ran) == sorted(Run.STAGES)  # nothing ran twice
    assert ran.index("investment") == len(ran) - 1 or ran[-1] in ("lead", "forecasts")


def test_dates_after_the_fixture_reach_the_forecast(spark):
    from plotline.operators import forecast as FC
    fc = FC.price_forecasts(P.active_df(spark, SF_SMALL), dt.date(2024, 5, 9))
    assert fc.agg(F.min("forecast_month")).first()[0] == dt.date(2024, 6, 1)


def test_a_falling_curve_costs_at_most_800_trees(spark, monkeypatch):
    fitted = []

    class Model:
        def __init__(self, n):
            self.n = n

        def evaluateEachIteration(self, rows, loss=None):
            return [1.0 / (i + 1) for i in range(self.n)]

    class Estimator:
        def __init__(self, n=500):
            self.n = n

        def getMaxIter(self):
            return self.n

        def copy(self):
            return self

        def setMaxIter(self, n):
            return Estimator(n)

        def fit(self, rows):
            fitted.append(self.n)
            return Model(self.n)

    monkeypatch.setattr(MD, "cut", lambda spark, model, trees: trees)
    rows = spark.range(1)
    assert MD.fit_patient(Estimator(), rows, rows, 30, "squared")[0] == 500
    assert sum(fitted) <= 800


def test_a_curve_still_falling_goes_to_the_limit(spark, monkeypatch):
    def steps(curve, limit=500, patience=30):
        """The rounds that are fitted for a whole curve, and the trees that are kept."""
        fitted = []

        class Estimator:
            def __init__(self, n=limit):
                self.n = n

            def getMaxIter(self):
                return self.n

            def copy(self):
                return self

            def setMaxIter(self, n):
                return Estimator(n)

            def fit(self, rows):
                fitted.append(self.n)
                return self

            def evaluateEachIteration(self, rows, loss=None):
                return curve[:self.n]

        rows = spark.range(1)
        return fitted, MD.fit_patient(Estimator(), rows, rows, patience, "squared")[0]

    monkeypatch.setattr(MD, "cut", lambda spark, model, trees: trees)
    falling = [1.0 / (i + 1) for i in range(500)]
    assert steps(falling) == ([60, 500], 500)
    early = [abs(i - 50.0) for i in range(500)]
    assert steps(early) == ([60, 240], 51)
    late = [abs(i - 90.0) for i in range(500)]
    assert steps(late) == ([60, 500], 91)
    assert steps([abs(i - 10.0) for i in range(500)]) == ([60], 11)


def test_model_rows_lie_in_every_part(spark):
    x = MD._persist(spark.range(10_000).coalesce(1))
    sizes = x.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    x.unpersist()
    assert len(sizes) == spark.sparkContext.defaultParallelism and min(sizes) > 0

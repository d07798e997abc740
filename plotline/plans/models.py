"""Valuation, rent and lead models on Spark ML.

The notebook fits boosted trees in one process on collected pandas frames;
here every step is a Spark job over the feature tables: preparation is the
fitted operators of ``operators.prep``, the models are ``pyspark.ml`` GBTs (fitted by
``plans.boosting``), and scoring is ``transform`` (no collect). Only fitted parameters reach the driver.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import config as C
from plotline.functions.columns import score_tier
from plotline.operators import metrics as M
from plotline.operators import prep as PR
from plotline.plans import boosting as BO
from plotline.plans.boosting import best_tree
from plotline.session import scratch_path, written

_FITS_AT_ONCE = 4  # fits whose jobs share the cluster
RIDGE_ALPHA = 1.0


@dataclass
class TreeParams:
    """E-11: boosted-tree settings (the notebook's: at most 500 trees, rate
    .05, depth 6, row subsample .8, feature subsample .7). ``patience`` rounds
    without a better validation error end a fit; the ensemble is then cut at
    its best tree (``fit_patient``)."""

    max_iter: int = 500
    step_size: float = 0.05
    max_depth: int = 6
    subsampling_rate: float = 0.8
    feature_subset: str = "0.7"
    max_bins: int = 64
    min_instances: int = 10
    seed: int = 42
    patience: int = 50

    def _set(self, kind, label: str, **kw):
        return kind(labelCol=label, featuresCol="features", maxIter=self.max_iter, stepSize=self.step_size, maxDepth=self.max_depth,
                    subsamplingRate=self.subsampling_rate, featureSubsetStrategy=self.feature_subset, maxBins=self.max_bins,
                    minInstancesPerNode=self.min_instances, seed=self.seed, checkpointInterval=10, **kw)

    def regressor(self, label: str, **kw) -> GBTRegressor:
        return self._set(GBTRegressor, label, **kw)

    def classifier(self, label: str, **kw) -> GBTClassifier:
        return self._set(GBTClassifier, label, **kw)


def bare(spark: SparkSession, model):
    """A linear model without its training summary. The summary holds the session, which cannot travel to tasks once
    the session has observed a metric (``sources.snapshots``)."""
    path = scratch_path(spark, f"bare-{uuid.uuid4().hex}")
    model.write().save(path)
    return type(model).load(path)


def cut(spark: SparkSession, model, trees: int):
    """The ensemble of the first ``trees`` trees of a boosted model."""
    gateway, old = spark.sparkContext._gateway, model._java_obj
    classes = isinstance(model, GBTClassificationModel)
    ml = gateway.jvm.org.apache.spark.ml
    kept = gateway.new_array(ml.regression.DecisionTreeRegressionModel, trees)
    weights = gateway.new_array(gateway.jvm.double, trees)
    for i, (tree, weight) in enumerate(zip(list(old.trees())[:trees], list(old.treeWeights())[:trees])):
        kept[i], weights[i] = tree, weight
    if classes:
        return GBTClassificationModel(ml.classification.GBTClassificationModel(old.uid(), kept, weights, old.numFeatures(), old.numClasses()))
    return GBTRegressionModel(ml.regression.GBTRegressionModel(old.uid(), kept, weights, old.numFeatures()))


def fit_patient(estimator, rows: DataFrame, held: DataFrame, patience: int, loss: str | None = None) -> tuple[object, list[float]]:
    """Fit on ``rows`` with early stopping on ``held``: the model cut at its best tree, and the validation curve.

    A fit knows no patience of its own, so it is run for a growing number of rounds (each four times the one before, up
    to the estimator's limit) until ``patience`` rounds of its staged validation curve bring no better error; a curve whose
    last round is its best goes to the limit at once. As the seed is fixed, the first trees of a longer fit are those of the
    shorter one, so the steps change the cost alone. ``loss`` is the measure of a regression ("squared" or "absolute"); a
    classifier is measured by its log loss.
    """
    limit = estimator.getMaxIter()
    rounds = min(limit, 2 * patience)
    while True:
        model = estimator.copy().setMaxIter(rounds).fit(rows)
        curve = list(model.evaluateEachIteration(held, loss) if loss else model.evaluateEachIteration(held))
        best, stopped = best_tree(curve, patience)
        if stopped or rounds == limit:
            return cut(rows.sparkSession, model, best + 1), curve
        rounds = limit if best == rounds - 1 else min(limit, 4 * rounds)


def boosted(estimator, rows: DataFrame, held: DataFrame | None = None, patience: int | None = None, loss: str | None = None) -> tuple[object, list[float]]:
    """The fitted model and its validation curve (``held`` and ``patience``: early stopping). A fit is one gang-scheduled stage;
    where a gang cannot be had (executors that come and go, a shared folder that tasks cannot open) the library's jobs fit it."""
    if BO.slots(rows.sparkSession):
        return BO.fit(estimator, rows, held, patience, loss)
    return fit_patient(estimator, rows, held, patience, loss) if held is not None else (estimator.fit(rows), [])


@dataclass
class Prep:
    """Fitted preparation: medians, scaler, vocabularies, feature order."""

    numeric: list[str]
    binary: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    vocab: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *[f"{c}_code" for c in self.categorical], *self.binary]

    def fit(self, df: DataFrame) -> "Prep":
        self.medians = PR.fit_median_fill(df, self.numeric)
        filled = PR.impute(df, self.numeric, self.binary, self.categorical, self.medians)
        self.scaler = PR.fit_standard_scaler(filled, self.numeric)
        self.vocab = {c: written(PR.fit_vocabulary(filled, c), f"vocab-{c}") for c in self.categorical}
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        state = {k: getattr(self, k) for k in ("numeric", "binary", "categorical", "medians", "scaler")}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        for c, v in self.vocab.items():
            v.write.mode("overwrite").parquet(f"{path}/vocab/{c}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Prep":
        state = json.loads(spark.read.text(f"{path}/state").first().value)
        state["scaler"] = {c: tuple(v) for c, v in state["scaler"].items()}
        return Prep(**state, vocab={c: spark.read.parquet(f"{path}/vocab/{c}") for c in state["categorical"]})

    def transform(self, df: DataFrame, fill: str = "median") -> DataFrame:
        """M-1/M-2 + M-3 + M-4 + M-5. ``fill='zero'`` is the notebook's scoring fill."""
        df = PR.add_missing_columns(df, self.numeric, self.binary, self.categorical)
        df = PR.impute(df, self.numeric, self.binary, self.categorical, self.medians if fill == "median" else 0.0)
        df = PR.standard_scale(df, self.scaler)
        for c in self.categorical:
            df = PR.ordinal_encode(df, c, self.vocab[c], f"{c}_code")
        assembler = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep")
        return assembler.transform(df)


def _persist(df: DataFrame) -> DataFrame:
    """Rows that every level of every tree reads, dealt evenly: as they come, a small table lies in one task's part."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)


def _at_once(fits: list) -> list:
    """Run independent fits side by side in this session."""
    with ThreadPoolExecutor(_FITS_AT_ONCE) as pool:
        return list(pool.map(lambda f: f(), fits))


def _write_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    spark.createDataFrame([(json.dumps(metrics),)], "m string").coalesce(1).write.mode("overwrite").text(f"{path}/metrics")


def _read_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metrics").first().value)


def gated(name: str, value: float | None, limit: float, at_most: bool) -> dict:
    """E-6 on one fitted metric; passed is None when there is no metric."""
    passed = None if value is None else (value <= limit if at_most else value >= limit)
    return {"metric": name, "value": value, "threshold": limit, "passed": passed}


# ------------------------------------------------------------------ valuation
@dataclass
class Valuation:
    prep: Prep
    base: list
    meta: object
    metrics: dict = field(default_factory=dict)
    oof: DataFrame | None = None  # (b0, b1, log_price): what the ridge was fitted on

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.save(spark, f"{path}/prep")
        if self.oof is not None:
            self.oof.write.mode("overwrite").parquet(f"{path}/oof")
        for i, m in enumerate(self.base):
            m.write().overwrite().save(f"{path}/base{i}")
        self.meta.write().overwrite().save(f"{path}/meta")
        _write_metrics(spark, path, self.metrics)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Valuation":
        return Valuation(Prep.load(spark, f"{path}/prep"), [GBTRegressionModel.load(f"{path}/base{i}") for i in range(2)],
                         LinearRegressionModel.load(f"{path}/meta"), _read_metrics(spark, path), spark.read.parquet(f"{path}/oof"))

    def predict(self, df: DataFrame, pct: float = C.INTERVAL_PCT, fill: str = "median") -> DataFrame:
        """E-2: stacked estimate, expm1 back to price, +-pct interval."""
        x = self.prep.transform(df, fill)
        for i, m in enumerate(self.base):
            x = m.transform(x).withColumnRenamed("prediction", f"_b{i}")
        x = VectorAssembler(inputCols=[f"_b{i}" for i in range(len(self.base))], outputCol="_meta").transform(x)
        x = self.meta.transform(x.drop("features").withColumnRenamed("_meta", "features"))
        est = F.expm1(F.col("prediction"))
        return (x.withColumns({"avm_estimate": est, "avm_low": est * (1 - pct), "avm_high": est * (1 + pct)})
                .drop("features", "prediction", *[f"_b{i}" for i in range(len(self.base))]))


def _base_models(params: TreeParams) -> list[tuple[GBTRegressor, int, str]]:
    """Two differently set boosted regressors (the notebook stacks two libraries), with the patience (30 and 50 rounds
    at the notebook's settings) and the validation measure of each."""
    other = TreeParams(**{**params.__dict__, "max_depth": max(2, params.max_depth - 1), "feature_subset": "sqrt",
                          "seed": params.seed + 1})
    return [(params.regressor("log_price"), max(1, round(0.6 * params.patience)), "absolute"),
            (other.regressor("log_price"), params.patience, "squared")]


def fit_ridge(oof: DataFrame) -> LinearRegressionModel:
    """The ridge (alpha ``RIDGE_ALPHA``) of log_price on b0 and b1: min sum (w x + b - y)^2 + alpha |w|^2.

    The library averages the squares and divides its penalty by the label's (population) deviation, so regParam is
    alpha * deviation / rows; equal labels have no deviation and give weights of zero.
    """
    n, deviation = oof.agg(F.count(F.lit(1)), F.stddev_pop("log_price")).first()
    meta_in = VectorAssembler(inputCols=["b0", "b1"], outputCol="_m").transform(oof)
    return LinearRegression(featuresCol="_m", labelCol="log_price", regParam=RIDGE_ALPHA * (deviation or 0.0) / max(n, 1),
                            elasticNetParam=0.0, standardization=False, solver="normal").fit(meta_in)


def fit_valuation(train: DataFrame, params: TreeParams = TreeParams(), n_folds: int = 3,
                  group: str = "state", include_leaky: bool = False) -> Valuation:
    """E-1: out-of-fold predictions of two GBTs over group folds (no state in
    two folds), a ridge (alpha 1) on top, then the base models refit on all rows with
    the mean number of trees that their folds kept."""
    numeric = [c for c in C.AVM_NUMERIC if include_leaky or c not in C.AVM_LEAKY]
    prep = Prep(numeric, list(C.AVM_BINARY), list(C.AVM_CATEGORICAL))
    df = train.withColumn("log_price", F.log1p("price"))
    prep.fit(df)
    x = _persist(PR.with_folds(prep.transform(df), group, n_folds).select("features", "log_price", "fold"))
    try:
        x.count()  # fills the cache before the fits run side by side
        models = _base_models(params)
        fitted = _at_once([lambda k=k, e=e, p=p, m=m: boosted(e, x.filter(F.col("fold") != k), x.filter(F.col("fold") == k), p, m)
                           for k in range(n_folds) for e, p, m in models])
        oof = None
        for k in range(n_folds):
            preds = x.filter(F.col("fold") == k).select("features", "log_price")
            for i, (m, _) in enumerate(fitted[2 * k:2 * k + 2]):
                preds = m.transform(preds).withColumnRenamed("prediction", f"b{i}")
            oof = preds if oof is None else oof.unionByName(preds)
        oof = written(oof.select("b0", "b1", "log_price"), "valuation-oof")
        meta = fit_ridge(oof)
        meta = bare(x.sparkSession, meta).setFeaturesCol("features")
        kept = [[m.getNumTrees for m, _ in fitted[i::2]] for i in range(2)]
        trees = [max(1, round(sum(ks) / len(ks))) for ks in kept]
        base = _at_once([lambda e=e, t=t: boosted(e.copy().setMaxIter(t), x)[0] for (e, _, _), t in zip(models, trees)])
    finally:
        x.unpersist()
    limits = {"max_trees": params.max_iter, "rate": params.step_size, "depth": params.max_depth}
    return Valuation(prep, base, meta, {"limits": limits, "fold_trees": kept, "trees": trees,
                                        "fold_curves": [[c for _, c in fitted[i::2]] for i in range(2)]}, oof)


def valuation_training(prop: DataFrame) -> DataFrame:
    """P-8."""
    return prop.filter(F.col("price").between(C.PRICE_MIN, C.PRICE_MAX) & (F.col("quality_score") >= 0.6)
                       & (F.col("property_type") != "LAND"))


def valuation_run(prop: DataFrame, params: TreeParams = TreeParams(), test_states=C.AVM_TEST_STATES) -> Valuation:
    """C-5: P-8 filter, hold out test states (P-16), fit (E-1), evaluate (E-3) and gate (E-6)."""
    df = written(valuation_training(prop), "valuation-training")
    model = fit_valuation(df.filter(~F.col("state").isin(*test_states)), params)
    scored = model.predict(df.filter(F.col("state").isin(*test_states)))
    found = M.regression_metrics(scored, "price", "avm_estimate").first().asDict()
    model.metrics |= found | {"gate": gated("avm_mape", found["mape"], C.AVM_MAX_MAPE, at_most=True)}
    return model


def valuation_scores(model: Valuation, active: DataFrame) -> DataFrame:
    """E-2: estimate and interval for every active listing."""
    return model.predict(active).select(*C.ADDRESS_KEYS, "listing_id", "property_type", "price", "avm_estimate", "avm_low", "avm_high")


# ----------------------------------------------------------------------- rent
@dataclass
class Rent:
    prep: Prep
    model: object
    metrics: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.save(spark, f"{path}/prep")
        self.model.write().overwrite().save(f"{path}/model")
        _write_metrics(spark, path, self.metrics)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Rent":
        return Rent(Prep.load(spark, f"{path}/prep"), GBTRegressionModel.load(f"{path}/model"), _read_metrics(spark, path))

    def predict(self, active: DataFrame, yields_col: str = "gross_yield") -> DataFrame:
        """E-7 scoring + P-41 blend."""
        from plotline.operators.invest import rent_blend, with_state_yield
        x = self.model.transform(self.prep.transform(active, fill="zero")).withColumnRenamed("prediction", "_model")
        x = with_state_yield(x.drop("features")) if yields_col not in x.columns else x
        return x.withColumns(rent_blend("_model", "price", yields_col)).drop("_model")


def fit_rent(prop: DataFrame, params: TreeParams = TreeParams(max_depth=5, patience=30), include_leaky: bool = False,
             min_rows: int = C.MIN_TRAIN_ROWS) -> Rent | None:
    """E-7: GBT on census rent (P-9 filter, 0 fill, 85/15 split with early
    stopping). None under ``min_rows`` rows (P-15)."""
    df = written(prop.filter(F.col("census_median_gross_rent").between(C.RENT_TRAIN_MIN, C.RENT_TRAIN_MAX)
                             & (F.col("quality_score") >= 0.6)), "rent-training")
    if df.limit(min_rows).count() < min_rows:
        return None
    cols = [c for c in C.RENT_COLS if include_leaky or c not in C.RENT_LEAKY]
    prep = Prep(cols, [], [])
    prep.medians = {c: 0.0 for c in cols}
    prep.scaler = {}
    df = PR.exact_split(df.withColumn("rent_label", F.col("census_median_gross_rent").cast("double")),
                        "listing_id", 0.15, 42, out="_is_val")
    x = _persist(prep.transform(df, fill="zero").select("features", "rent_label", (F.col("_is_val") == 1).alias("_val")))
    try:
        model, curve = boosted(params.regressor("rent_label"), x.filter("not _val"), x.filter("_val"), params.patience, "squared")
        metrics = M.regression_metrics(model.transform(x.filter("_val")), "rent_label", "prediction").first().asDict()
    finally:
        x.unpersist()
    limits = {"max_trees": params.max_iter, "rate": params.step_size, "depth": params.max_depth}
    return Rent(prep, model, metrics | {"limits": limits, "trees": [model.getNumTrees], "curve": curve})


# ----------------------------------------------------------------------- lead
@dataclass
class Lead:
    prep: Prep
    model: object
    calibrator: object
    metrics: dict = field(default_factory=dict)
    calibration: DataFrame | None = None  # (raw, motivated_seller): what the calibrator was fitted on

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.save(spark, f"{path}/prep")
        if self.calibration is not None:
            self.calibration.write.mode("overwrite").parquet(f"{path}/calibration")
        self.model.write().overwrite().save(f"{path}/model")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        _write_metrics(spark, path, self.metrics)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Lead":
        return Lead(Prep.load(spark, f"{path}/prep"), GBTClassificationModel.load(f"{path}/model"),
                    LogisticRegressionModel.load(f"{path}/calibrator").setFeaturesCol("features"), _read_metrics(spark, path),
                    spark.read.parquet(f"{path}/calibration"))

    def predict(self, df: DataFrame, fill: str = "median") -> DataFrame:
        """E-9 + E-10: the raw margin, the calibrated probability and its tier. The calibrator's input is the raw
        probability: the notebook's classifier has no decision function, so its calibrator sees probabilities."""
        x = self.model.transform(self.prep.transform(df, fill))
        x = x.withColumns({"_margin": vector_to_array("rawPrediction")[1], "_raw": vector_to_array("probability")[1]})
        x = VectorAssembler(inputCols=["_raw"], outputCol="_cal").transform(
            x.drop("features", "prediction", "probability", "rawPrediction"))
        x = self.calibrator.transform(x.withColumnRenamed("_cal", "features"))
        x = x.withColumn("lead_score", vector_to_array("probability")[1])
        return (x.withColumn("lead_tier", score_tier("lead_score"))
                .drop("features", "prediction", "probability", "rawPrediction", "_raw").withColumnRenamed("_margin", "margin"))


def platt_rows(df: DataFrame, label: str) -> DataFrame:
    """E-9: smoothed targets t+ = (N+ + 1)/(N+ + 2), t- = 1/(N- + 2), written as
    two weighted rows per example (label 1 with weight t, label 0 with 1 - t)."""
    counts = df.agg(F.sum(F.col(label)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    n_pos, n_neg = counts["p"] or 0, counts["n"] - (counts["p"] or 0)
    t_pos, t_neg = (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0)
    t = F.when(F.col(label) == 1, F.lit(t_pos)).otherwise(F.lit(t_neg))
    one = df.withColumns({"_y": F.lit(1.0), "_w": t})
    zero = df.withColumns({"_y": F.lit(0.0), "_w": 1 - t})
    return one.unionByName(zero)


def fit_lead(labeled: DataFrame, params: TreeParams = TreeParams(max_iter=400),
             min_rows: int = C.MIN_TRAIN_ROWS) -> Lead | None:
    """C-8: stratified 20% test, 15% validation (M-7); weighted GBT classifier
    (G-7) with early stopping (E-8); Platt calibration on validation (E-9);
    AUC and AP on test (E-4, E-5). None under ``min_rows`` rows."""
    df = written(labeled.na.drop(subset=["years_since_last_sale"]), "lead-training")
    if df.limit(min_rows).count() < min_rows:
        return None
    df = written(PR.exact_split(df, "listing_id", 0.2, 42, label="motivated_seller", out="_is_test"), "lead-split")
    train_all = df.filter("_is_test = 0")
    test = df.filter("_is_test = 1")
    train_all = written(PR.exact_split(train_all, "listing_id", 0.15, 42, label="motivated_seller", out="_is_val"),
                        "lead-train")
    fit_part = train_all.filter("_is_val = 0")
    prep = Prep(list(C.LEAD_NUMERIC), list(C.LEAD_BINARY), list(C.LEAD_CAT)).fit(fit_part)
    w = M.class_weight(fit_part, "motivated_seller").first()["pos_weight"]
    x = _persist(prep.transform(train_all).select(
        "features", "motivated_seller", (F.col("_is_val") == 1).alias("_val"), F.col("motivated_seller").cast("double").alias("_label"),
        F.when(F.col("motivated_seller") == 1, F.lit(float(w))).otherwise(F.lit(1.0)).alias("_wt")))
    try:
        model, curve = boosted(params.classifier("_label", weightCol="_wt"), x.filter("not _val"), x.filter("_val"), params.patience)
        raw = written(model.transform(x.filter("_val")).select(vector_to_array("probability")[1].alias("raw"), "motivated_seller"), "calibration")
        cal_in = VectorAssembler(inputCols=["raw"], outputCol="_cal").transform(platt_rows(raw, "motivated_seller"))
        cal = LogisticRegression(featuresCol="_cal", labelCol="_y", weightCol="_w", regParam=0.0, tol=1e-12, maxIter=1000).fit(cal_in)
        cal = bare(raw.sparkSession, cal).setFeaturesCol("features")
        lead = Lead(prep, model, cal, {}, raw)
        scored = lead.predict(test)
        auc = M.roc_auc(scored, "motivated_seller", "lead_score").first()["auc"]
        ap = M.average_precision(scored, "motivated_seller", "lead_score").first()["average_precision"]
    finally:
        x.unpersist()
    limits = {"max_trees": params.max_iter, "rate": params.step_size, "depth": params.max_depth}
    lead.metrics = {"auc": auc, "average_precision": ap, "pos_weight": float(w), "limits": limits, "trees": [model.getNumTrees],
                    "curve": curve, "gate": gated("lead_auc", auc, C.LEAD_MIN_AUC, at_most=False)}
    return lead

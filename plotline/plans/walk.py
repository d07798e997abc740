"""Fitted models as tables: ensembles walked level by level with joins, fits certified by their optimality conditions.

A saved ensemble is a node table; scoring with it is a chain of equi-joins on (tree, node), with none of the library's
scoring code. The same holds for the linear parts: a ridge or a calibrator is right if the gradient of what it minimises
is zero, and a gradient is one aggregation.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline import config as C
from plotline.plans import models as MD
from plotline.session import scratch_path, written

_NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, weight double"


def node_table(spark: SparkSession, model) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value, weight) of a boosted model; a leaf has left = -1.

    At most trees * (2^(depth + 1) - 1) rows, which the settings bound.
    """
    path = scratch_path(spark, f"nodes-{uuid.uuid4().hex}")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    return nodes.join(weights, "tree").select(
        F.col("tree").cast("int").alias("tree"), F.col("id").cast("int").alias("node"), F.col("split.featureIndex").cast("int").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").cast("int").alias("left"),
        F.col("rightChild").cast("int").alias("right"), F.col("prediction").alias("value"), "weight")


def walk(rows: DataFrame, nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(rid, score) of ``rows`` (rid, x array): the weighted sum of the leaves that the rows reach.

    Each row starts at the root of every tree and takes ``depth`` steps; NaN goes right, as no threshold is above it.
    """
    steps = F.broadcast(nodes.select("tree", "node", "feature", "threshold", "left", "right"))  # bounded by the settings
    leaves = F.broadcast(nodes.select("tree", "node", (F.col("value") * F.col("weight")).alias("part")))
    at = rows.select("rid", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        value = F.get("x", F.col("feature"))
        ahead = F.when(F.col("left") < 0, F.col("node")).when(value <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(steps, ["tree", "node"]).select("rid", "x", "tree", ahead.alias("node"))
    return at.join(leaves, ["tree", "node"]).groupBy("rid").agg(F.sum("part").alias("score"))


def _rows(x: DataFrame, *keep: str) -> DataFrame:
    """(rid, x, keep...) of assembled rows, written so that a row keeps its number."""
    return written(x.select(F.monotonically_increasing_id().alias("rid"), vector_to_array("features").alias("x"), *keep), "walk-rows")


def _scored(rows: DataFrame, model, name: str, keep: list[str]) -> DataFrame:
    scores = walk(rows, node_table(rows.sparkSession, model), model.getNumTrees, max(t.depth for t in model.trees))
    return rows.select("rid", *keep).join(scores.withColumnRenamed("score", name), "rid")


def walked_valuation(model: MD.Valuation, df: DataFrame, keep: list[str], fill: str = "median") -> DataFrame:
    """E-2 by node tables: (keep..., estimate)."""
    rows = _rows(model.prep.transform(df, fill), *keep)
    both = _scored(rows, model.base[0], "b0", keep).join(_scored(rows, model.base[1], "b1", []), "rid")
    (w0, w1), b = model.meta.coefficients.toArray().tolist(), model.meta.intercept
    return both.select(*keep, F.expm1(F.col("b0") * w0 + F.col("b1") * w1 + b).alias("estimate"))


def walked_rent(model: MD.Rent, df: DataFrame, keep: list[str]) -> DataFrame:
    """E-7 by a node table: (keep..., monthly), blended with the yield as P-41 says. ``df`` has price and gross_yield."""
    scored = _scored(_rows(model.prep.transform(df, "zero"), *keep, "price", "gross_yield"), model.model, "fitted", [*keep, "price", "gross_yield"])
    monthly = C.RENT_MODEL_WEIGHT * F.greatest("fitted", F.lit(0.0)) + C.RENT_YIELD_WEIGHT * F.col("price") * F.col("gross_yield") / 12
    return scored.select(*keep, monthly.alias("monthly"))


def _sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def walked_lead(model: MD.Lead, df: DataFrame, keep: list[str], fill: str = "zero") -> DataFrame:
    """E-9 + E-10 by a node table: (keep..., score). The raw probability of a margin m is the logistic of 2 m."""
    scored = _scored(_rows(model.prep.transform(df, fill), *keep), model.model, "margin", keep)
    (a,), b = model.calibrator.coefficients.toArray().tolist(), model.calibrator.intercept
    return scored.select(*keep, _sigmoid(_sigmoid(2 * F.col("margin")) * a + b).alias("score"))


def ridge_gradient(model: MD.Valuation) -> DataFrame:
    """(equation, residual): the normal equations of the ridge on the out-of-fold predictions, at its coefficients.

    For min sum (w x + b - y)^2 + alpha |w|^2 they are sum (w x + b - y) x_j + alpha w_j = 0 and sum (w x + b - y) = 0;
    each is divided by the sum of the absolute values of its terms.
    """
    (w0, w1), b = model.meta.coefficients.toArray().tolist(), model.meta.intercept
    error = F.col("b0") * w0 + F.col("b1") * w1 + b - F.col("log_price")
    sums = model.oof.agg(*[F.sum(error * x).alias(n) for n, x in (("b0", F.col("b0")), ("b1", F.col("b1")), ("intercept", F.lit(1.0)))],
                         *[F.sum(F.abs(error * x)).alias(f"s_{n}") for n, x in (("b0", F.col("b0")), ("b1", F.col("b1")), ("intercept", F.lit(1.0)))])
    shrink = {"b0": MD.RIDGE_ALPHA * w0, "b1": MD.RIDGE_ALPHA * w1, "intercept": 0.0}
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("equation"), (F.abs(F.col(n) + v) / (F.col(f"s_{n}") + abs(v))).alias("residual"))
                                           for n, v in shrink.items()])).alias("e")).select("e.*")


def platt_gradient(model: MD.Lead) -> DataFrame:
    """(equation, residual): the gradient of the calibrator's log loss on its rows with Platt's targets, at its coefficients."""
    (a,), b = model.calibrator.coefficients.toArray().tolist(), model.calibrator.intercept
    rows = MD.platt_rows(model.calibration, "motivated_seller")
    error = F.col("_w") * (_sigmoid(F.col("raw") * a + b) - F.col("_y"))
    terms = {"slope": error * F.col("raw"), "intercept": error}
    sums = rows.agg(*[(F.abs(F.sum(t)) / F.sum(F.abs(t))).alias(n) for n, t in terms.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("equation"), F.col(n).alias("residual")) for n in terms])).alias("e")).select("e.*")

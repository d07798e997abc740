"""Evaluation metrics and gates as aggregations (no collected predictions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.running import running_totals

EPS = 2.220446049250313e-16  # float64 machine epsilon (MAPE denominator floor)


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """E-3: MAPE (|y - p| / max(|y|, eps)), MAE and R^2 = 1 - SSE / (n var_pop(y)).

    var_pop is merged with a numerically stable update, so no second pass
    over the data is needed for the mean."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    ok = df.filter(y.isNotNull() & p.isNotNull())
    g = ok.groupBy(*by) if by else ok.groupBy()
    out = g.agg(F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"),
                F.avg(F.abs(y - p)).alias("mae"),
                F.sum((y - p) * (y - p)).alias("_sse"),
                (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
                F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
    return out.withColumn("r2", r2).drop("_sse", "_sst")


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score (a partial aggregate);
    a null or NaN score cannot be ranked and takes no part."""
    return (df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
                 F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg")))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """E-4: area under the ROC curve with tied scores counted half
    (= the rank-sum statistic with average ranks). null for one class."""
    sc = running_totals(score_counts(df, label, score), "score", ["neg"])
    agg = sc.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * 0.5)).alias("_u"),
                 F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                             F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """E-5: sum over distinct thresholds (descending) of (R_n - R_{n-1}) * P_n."""
    sc = running_totals(score_counts(df, label, score), "score", ["pos", "neg"], descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    agg = sc.agg(F.sum(F.col("pos") * prec).alias("_s"), F.sum("pos").alias("_p"))
    return agg.select(F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("average_precision"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """G-7: negatives / max(positives, 1)."""
    return df.agg((F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
                   / F.greatest(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(1))).alias("pos_weight"))


def positive_rate(df: DataFrame, label: str) -> DataFrame:
    """G-8: mean of a 0/1 label."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("pos_rate"))


def quality_gate(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """E-6: metrics (metric, value) joined to gates (metric, threshold,
    direction 'le'|'ge'|'lt'|'gt') -> passed (null when the metric is missing)."""
    j = gates.join(metrics, "metric", "left")
    v, t, d = F.col("value"), F.col("threshold"), F.col("direction")
    passed = (F.when(v.isNull(), F.lit(None))
              .when(d == "le", v <= t).when(d == "ge", v >= t)
              .when(d == "lt", v < t).when(d == "gt", v > t))
    return j.withColumn("passed", passed)

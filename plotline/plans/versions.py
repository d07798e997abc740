"""Saved models: an append-only version log, promotion behind quality gates, and one bundle that serving loads.

Every save is a new folder and a record in the log; nothing is overwritten. Which version is live is not stored but
folded from the log: the latest version whose gate did not fail is in production, earlier ones are archived, and a
version that failed its gate is rejected and leaves the one before it live.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.plans import models as MD
from plotline.sources import snapshots as SN

LOG_SCHEMA = "model string, version int, metric string, value double, threshold double, passed boolean, folder string"


def save_version(spark: SparkSession, root: str, model: str, save: Callable[[SparkSession, str], None], gate: dict | None = None) -> int:
    """Save a model as its next version under ``root`` and log it with its gate (metric, value, threshold, passed); a
    gate of None, or without a value, does not hold a version back."""
    folder = f"{root}/{model}/{uuid.uuid4().hex}"
    save(spark, folder)
    version = max((c["row"]["version"] for c in SN.commits(spark, f"{root}/_log") if c["row"]["model"] == model), default=0) + 1
    gate = gate or {}
    SN.note(spark, f"{root}/_log", {"row": {"model": model, "version": version, "folder": folder,
                                            **{k: gate.get(k) for k in ("metric", "value", "threshold", "passed")}}})
    return version


def log(spark: SparkSession, root: str) -> DataFrame:
    """The version log: one row for every saved version."""
    names = [f.split(" ")[0] for f in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(c["row"][k] for k in names) for c in SN.commits(spark, f"{root}/_log")], LOG_SCHEMA)


def latest(versions: DataFrame) -> DataFrame:
    """T-4: (model, version) of the last version of every model; a maximum, so a model's versions are combined before they meet."""
    return versions.groupBy("model").agg(F.max("version").alias("version"))


def states(versions: DataFrame) -> DataFrame:
    """E-6 + T-4: (model, version, state) with state production, archived or rejected."""
    good = F.coalesce(F.col("passed"), F.lit(True))
    live = F.max(F.when(good, F.col("version"))).over(Window.partitionBy("model"))
    return versions.select("model", "version", F.when(~good, "rejected").when(F.col("version") == live, "production")
                           .otherwise("archived").alias("state"))


def folder(spark: SparkSession, root: str, model: str) -> str | None:
    """Where the version in production lies; None if there is none."""
    rows = log(spark, root)
    found = rows.join(states(rows).filter("state = 'production'"), ["model", "version"]).filter(F.col("model") == model).first()
    return found.folder if found else None


def last_folder(spark: SparkSession, root: str, model: str) -> str | None:
    """Where the last saved version lies, whatever its gate said."""
    found = [c["row"] for c in SN.commits(spark, f"{root}/_log") if c["row"]["model"] == model]
    return max(found, key=lambda r: r["version"])["folder"] if found else None


@dataclass
class Bundle:
    """All that answers requests: the valuation and lead models with their preparation and feature lists, and the forecast
    baselines. A model that could not be fitted is None; its requests are answered by an error."""

    valuation: MD.Valuation | None
    lead: MD.Lead | None
    baseline: DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        for name in ("valuation", "lead"):
            if getattr(self, name) is not None:
                getattr(self, name).save(spark, f"{path}/{name}")
        self.baseline.write.parquet(f"{path}/baseline")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Bundle":
        from plotline.operators.quality import _exists
        kinds = {"valuation": MD.Valuation, "lead": MD.Lead}
        found = {n: k.load(spark, f"{path}/{n}") if _exists(spark, f"{path}/{n}") else None for n, k in kinds.items()}
        return Bundle(**found, baseline=spark.read.parquet(f"{path}/baseline"))

    def models(self) -> dict:
        """The keyword arguments of ``requests.route`` and of the stream."""
        return {"valuation": self.valuation, "lead": self.lead, "baseline": self.baseline}


def serving(spark: SparkSession, root: str) -> Bundle:
    """The bundle in production under ``root``."""
    path = folder(spark, root, "combined")
    if path is None:
        raise FileNotFoundError(f"{root} has no bundle in production")
    return Bundle.load(spark, path)

"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings a job relies on; everything else is left to the cluster defaults.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # approximate medians over many thousands of segments a task; the default falls back to sorting after 128 keys
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.session.timeZone": "UTC",
    "spark.scheduler.mode": "FAIR",  # stages that run side by side share the cores
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "plotline",
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("PLOTLINE_DRIVER_MEMORY", "8g"))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset (tests); a scratch folder is made for it then. On a cluster a missing
    setting is an error, since a folder of one machine would lose the tables.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="plotline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder, of this application only."""
    return f"{ensure_checkpoint_dir(spark)}/plotline-{spark.sparkContext.applicationId}/{name}"


#: Folders written inside the innermost ``scratch_scope``.
_SCOPE: ContextVar[list[str] | None] = ContextVar("plotline_scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: columns are pruned and filters pushed
    down in what reads it, and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's scratch tables, wherever the shared folder lies."""
    if not path.startswith(scratch_path(spark, "")):
        raise ValueError(f"{path} is no scratch folder of this application")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and no later step reads."""
    spark = df.sparkSession
    mine = scratch_path(spark, "").split("://")[-1].removeprefix("file:")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = folder.find(mine)
        if at >= 0:
            delete_folder(spark, scratch_path(spark, folder[at + len(mine):]))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end: for callers that have written their results."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            delete_folder(spark, path)

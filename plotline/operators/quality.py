"""Data-quality helpers: duplicate keys, presence of a folder. (Guarded, counted writes: ``sources.snapshots``.)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K-8: keys that occur more than once, with their row count (null keys
    group together)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def write_by(df: DataFrame, path: str, key: str) -> None:
    """S-8: overwrite a plain table partitioned by ``key`` (``sources.snapshots.replace_by`` replaces one in one step).
    Rows are placed by the key first, so files follow the data's size and not the number of tasks; adaptive
    execution splits a large key and merges small ones."""
    df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(path)

"""Request serving as a Structured Streaming job.

The notebook's app answers requests one HTTP call at a time and keeps every good answer in a cache that outlives
the call. Here request files landing in a folder are a stream source. A request that can be answered passes a keyed
state (K-5 across micro-batches): the state of its key says whether an earlier micro-batch has answered it. Keys
that are new are scored, each once, by the batch plan; the others take the answer that is stored. State and progress
lie in the checkpoint folder, so both outlive a restart. Errors are not kept: a request with an unknown type, a
broken payload or a model that is not loaded is judged anew each time.

Each micro-batch's answers are written to their own ``batch_id=<n>`` folder with overwrite. A batch that is replayed
after a failure starts from the state before it, so it scores the same keys and replaces its own output.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plotline.operators import requests as RQ
from plotline.session import scratch_scope, written

REQUEST_FILE_SCHEMA = "request_id string, model_type string, payload string"
_KEYED = "request_id string, model_type string, payload string, _key string"


def request_stream(spark: SparkSession, landing: str, max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.format("json").schema(REQUEST_FILE_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(landing))


def with_seen(requests: DataFrame, known: list[str], keep_for: _dt.timedelta | None = None) -> DataFrame:
    """The rows of a stream of requests with _key, answerable, and seen: whether an earlier micro-batch has answered the key.

    The state is one mark a key. By default it is kept for good, as the app's cache is; with ``keep_for`` a key
    that was not asked for that long is forgotten and scored anew. The rows of a key pass as they come, a batch of
    them at a time, so a hot key needs no memory of its own. A request that no model answers leaves no mark.
    """
    wait = None if keep_for is None else int(keep_for.total_seconds() * 1000)

    def mark(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, good = state.exists, bool(key[1])
        for rows in frames:
            yield rows.assign(answerable=good, seen=seen and good)
        if good and not seen:
            state.update((True,))
        if good and wait is not None:
            state.setTimeoutDuration(wait)

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    parsed = RQ.parse_payload(requests)  # once for the key and the judgement
    rows = parsed.select("request_id", "model_type", "payload", RQ.request_key(F.col("records")).alias("_key"),
                         RQ.fault(known).isNull().alias("_good"))
    return rows.groupBy("_key", "_good").applyInPandasWithState(
        mark, f"{_KEYED}, _good boolean, answerable boolean, seen boolean", "answered boolean", "append", timeout).drop("_good")


def serve(spark: SparkSession, landing: str, out: str, checkpoint: str, as_of: _dt.date, available_now: bool = True,
          max_files_per_trigger: int = 100, keep_for: _dt.timedelta | None = None, **models):
    """Start the routing stream; with ``available_now`` it processes what has landed and stops (a scheduled batch);
    otherwise it keeps running. Answers: request_id, model_type, _key, answered_by (the request whose scoring gave the
    answer), result, good (no error), answered_at."""
    out = out.rstrip("/")

    def answer(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            rows = written(batch, "micro-batch")  # the state is passed once
            old = _stored(spark, out, batch_id)
            keys = rows.select("request_id", "model_type", "_key", "answerable")
            if old is None:
                found = rows.limit(0).select("_key", F.lit("").alias("answered_by"), F.lit("").alias("result"))
            else:
                asked = rows.filter("seen").select("_key").distinct()
                found = written(old.join(asked, "_key", "left_semi").select("_key", "answered_by", "result"), "answers-found")
            # a key that was seen but whose answer is gone (the folder was cleared) is scored again
            new = rows.join(found.select("_key"), "_key", "left_anti")
            unique = new.groupBy("_key").agg(F.min("request_id").alias("answered_by"), F.min("model_type").alias("model_type"),
                                             F.min("payload").alias("payload"))
            unique = written(unique, "requests-new")
            routed = RQ.route(unique.select(F.col("_key").alias("request_id"), "model_type", "payload"), as_of, **models)
            fresh = routed.select(F.col("request_id").alias("_key"), "result").join(unique.select("_key", "answered_by"), "_key")
            answers = fresh.select("_key", "answered_by", "result").unionByName(found)
            # written per batch; a hot key's rows are split by skew handling, as the other side has one row a key
            (keys.join(answers, "_key")
             .select("request_id", "model_type", "_key", "answered_by", "result", F.col("answerable").alias("good"),
                     F.current_timestamp().alias("answered_at"))
             .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    stream = with_seen(request_stream(spark, landing, max_files_per_trigger), RQ.known_types(**models), keep_for)
    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _stored(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """One row (_key, answered_by, result) for every key that a batch before ``before`` has answered without error."""
    if before == 0:
        return None
    answers = spark.read.parquet(out).filter((F.col("batch_id") < before) & F.col("good") & (F.col("request_id") == F.col("answered_by")))
    return (answers.groupBy("_key").agg(F.min(F.struct("batch_id", "answered_by", "result")).alias("a"))
            .select("_key", "a.answered_by", "a.result"))

"""K-5 across micro-batches: answers outlive a batch and a restart."""

import json
import os
import uuid

from pyspark.sql import functions as F

from plotline.config import ADAPTER_AS_OF as AS_OF
from plotline.operators import requests as RQ
from plotline.session import scratch_path
from plotline.streaming.requests_stream import serve

FIELDS = "request_id string, model_type string, payload string"
BASE = [("X", "SFR", "other", 100.0, 5), ("Y", "SFR", "other", 200.0, 5)]


def ask(spark, folder, rows):
    spark.createDataFrame(rows, FIELDS).write.mode("append").json(f"{folder}/landing")


def test_a_repeated_request_is_not_scored_again(spark, monkeypatch):
    base = spark.createDataFrame(BASE, "state string, property_type string, state_tier string, median_price double, count long")
    folder = scratch_path(spark, f"cache-{uuid.uuid4().hex}")
    local = scratch_path(spark, "").removeprefix("file://").removeprefix("file:")
    scored = []
    route = RQ.route

    def counted(requests, *args, **models):
        scored.append(sorted(json.dumps(json.loads(r.payload), sort_keys=True) if r.payload.endswith("]") else r.payload for r in requests.collect()))
        return route(requests, *args, **models)

    monkeypatch.setattr(RQ, "route", counted)

    def run(**models):
        serve(spark, f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", AS_OF, max_files_per_trigger=1000, **models).awaitTermination()

    x, y = ({"state": s, "property_type": "SFR", "horizon": 2} for s in "XY")
    ask(spark, folder, [("b", "price_forecast", json.dumps([x])), ("a", " price_forecast", json.dumps([dict(reversed(x.items()))])),
                        ("broken", "price_forecast", "[{"), ("lead", "lead_scoring", "[]")])
    run(baseline=base)
    left = set(os.listdir(local))
    ask(spark, folder, [("c", "price_forecast", json.dumps([x])), ("d", "price_forecast", json.dumps([y])), ("e", "price_forecast", json.dumps([y])),
                        ("broken2", "price_forecast", "[{")])
    run(baseline=base)  # a new query: the state comes back from the checkpoint
    ask(spark, folder, [("f", "price_forecast", json.dumps([y])), ("a2", "price_forecast", json.dumps([x]))])
    run(baseline=base)
    assert set(os.listdir(local)) == left  # micro-batches leave no scratch tables
    texts = [json.dumps([r], sort_keys=True) for r in (x, y)]
    assert [[t for t in some if t in texts] for some in scored] == [[texts[0]], [texts[1]], []]
    assert ["[{" in some for some in scored] == [True, True, False]  # errors are judged anew
    rows = {r.request_id: r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert {k: r.answered_by for k, r in rows.items()} == {"a": "a", "b": "a", "broken": "broken", "lead": "lead", "c": "a", "d": "d", "e": "d",
                                                         "broken2": "broken2", "f": "d", "a2": "a"}
    assert {k: r.batch_id for k, r in rows.items() if k in ("a", "c", "f")} == {"a": 0, "c": 1, "f": 2}
    assert rows["c"].result == rows["a"].result == rows["a2"].result and len(json.loads(rows["f"].result)) == 2
    assert "error" in json.loads(rows["broken2"].result) and not rows["lead"].good


def test_a_lost_answer_is_scored_again_and_a_replayed_batch_replaces_its_own(spark):
    base = spark.createDataFrame(BASE, "state string, property_type string, state_tier string, median_price double, count long")
    folder = scratch_path(spark, f"cache-{uuid.uuid4().hex}")
    x = json.dumps([{"state": "X", "property_type": "SFR"}])

    def run():
        serve(spark, f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", AS_OF, baseline=base).awaitTermination()

    ask(spark, folder, [("a", "price_forecast", x)])
    run()
    ask(spark, folder, [("b", "price_forecast", x)])
    run()
    out = spark.read.parquet(f"{folder}/out")
    assert sorted((r.request_id, r.answered_by, r.batch_id) for r in out.collect()) == [("a", "a", 0), ("b", "a", 1)]
    empty = out.filter("false").drop("batch_id")
    empty.write.mode("overwrite").parquet(f"{folder}/out/batch_id=0")  # the answers of batch 0 are gone
    empty.write.mode("overwrite").parquet(f"{folder}/out/batch_id=1")
    ask(spark, folder, [("c", "price_forecast", x)])
    run()
    got = spark.read.parquet(f"{folder}/out").collect()
    assert [(r.request_id, r.answered_by, r.batch_id, len(json.loads(r.result))) for r in got] == [("c", "c", 2, 12)]


def test_a_key_whose_texts_are_judged_differently_answers_each_request_once(spark):
    base = spark.createDataFrame(BASE, "state string, property_type string, state_tier string, median_price double, count long")
    folder = scratch_path(spark, f"cache-{uuid.uuid4().hex}")
    x = json.dumps({"state": "X", "property_type": "SFR"})
    ask(spark, folder, [("a", "price_forecast", x), ("b", "price_forecast", f"{x} x"), ("c", "price_forecast", f"[{x}]")])
    serve(spark, f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", AS_OF, baseline=base).awaitTermination()
    rows = sorted((r.request_id, r.good) for r in spark.read.parquet(f"{folder}/out").collect())
    assert rows == [("a", True), ("b", False), ("c", True)]


def test_the_key_of_a_parsed_request_is_that_of_its_text(spark):
    texts = ['[{"a":1,"b":2}]', ' {"b":2,"a":1} ', '{"a":1} x', '{"a":1},{"b":2}', "[{", "", " ", None, "[]", "{}", "null", "[null]", '\n[{"a":1}]',
             '\t{"a":1}', '[{"a":1,"a":2}]', '{"a":1,"a":2}', '[{"a":{"z":1}}]', '[{"a":1}] x', '[{"a":null}]']
    rows = spark.createDataFrame([(str(i), "avm", t) for i, t in enumerate(texts)], FIELDS)
    keys = RQ.parse_payload(rows).select("payload", RQ.request_key().alias("plain"), RQ.request_key(F.col("records")).alias("parsed")).collect()
    assert len(keys) == len(texts) and all(r.plain == r.parsed for r in keys)

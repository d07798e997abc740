"""Identical requests: answered once, shuffled once."""

from pyspark.sql import functions as F

from plotline.operators import requests as RQ


def test_identical_requests_are_dealt_by_key_once(spark):
    rows = [("b", "avm", '[{"x":1,"y":2}]'), ("a", " avm", '[{"y":2,"x":1}]'), ("c", "avm", "no json"), ("d", "avm", None)]
    unique, keys = RQ.dedupe_requests(spark.createDataFrame(rows, "request_id string, model_type string, payload string"))
    answered = keys.join(unique.select("_key", F.col("request_id").alias("answered_by")), "_key").select("request_id", "answered_by")
    assert dict(answered.collect()) == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert not keys.schema["_key"].nullable  # a join would filter nulls, and parse every payload once more for that
    plan = answered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "isnotnull" not in plan  # the same exchange on both sides

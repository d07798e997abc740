"""Request routing edge cases (no model needed for these paths)."""

import json

from plotline.operators import requests as RQ
from plotline.operators.forecast import baseline_medians
from plotline.plans import common as P

from plotline import config as C
from plotline.config import ADAPTER_AS_OF as AS_OF

from .conftest import SF_SMALL


def test_unknown_malformed_empty(spark):
    base = baseline_medians(P.active_df(spark, SF_SMALL))
    seg = base.orderBy("state", "property_type").first()
    good = json.dumps([{"state": seg["state"], "property_type": seg["property_type"], "horizon": 2}])
    req = spark.createDataFrame([
        ("r1", " AVM_X ", "[]"),
        ("r2", "price_forecast", '[{"state": '),
        ("r3", "price_forecast", "[]"),
        ("r4", "price_forecast", json.dumps([{"state": "Nowhere", "property_type": "SFR"}])),
        ("r5", " price_forecast ", good),
    ], "request_id string, model_type string, payload string")
    out = {r["request_id"]: r["result"] for r in RQ.route(req, AS_OF, baseline=base).collect()}
    assert json.loads(out["r1"]) == {"error": "Unknown model_type 'AVM_X'. Use: avm, lead_scoring, price_forecast"}
    assert "error" in json.loads(out["r2"])
    assert out["r3"] == "[]" and out["r4"] == "[]"
    recs = json.loads(out["r5"])
    assert len(recs) == 2 and recs[0]["forecast_month"] == "2002-02-01T00:00:00.000"
    assert abs(recs[0]["last_actual"] - seg["median_price"]) < 1e-6


def test_dedupe_answers_identical_requests_once(spark):
    req = spark.createDataFrame([
        ("a", "price_forecast", '[{"state": "X", "property_type": "SFR"}]'),
        ("b", "price_forecast", '[{"property_type": "SFR", "state": "X"}]'),
        ("c", "price_forecast", '[{"state": "Y", "property_type": "SFR"}]'),
    ], "request_id string, model_type string, payload string")
    unique, keys = RQ.dedupe_requests(req)
    assert unique.count() == 2 and keys.count() == 3


FIELDS = "request_id string, model_type string, payload string"


def segment(spark):
    base = baseline_medians(P.active_df(spark, SF_SMALL))
    seg = base.orderBy("state", "property_type").first()
    return base, {"state": seg["state"], "property_type": seg["property_type"]}, seg["median_price"]


def test_one_bad_value_does_not_fail_the_batch(spark):
    base, seg, _ = segment(spark)
    req = spark.createDataFrame([
        ("far", "price_forecast", json.dumps([seg | {"horizon": 1e12}])),
        ("good", "price_forecast", json.dumps([seg | {"horizon": 3}])),
        ("zero", "price_forecast", json.dumps([seg | {"horizon": 0}])),
        ("back", "price_forecast", json.dumps([seg | {"horizon": -2}])),
    ], FIELDS)
    out = {r["request_id"]: json.loads(r["result"]) for r in RQ.route(req, AS_OF, baseline=base).collect()}
    assert len(out["good"]) == 3 and out["zero"] == [] and out["back"] == []
    assert len(out["far"]) == 12  # no int: the default horizon
    far = spark.createDataFrame([("2e9", "price_forecast", json.dumps([seg, seg | {"horizon": 2_000_000_000}])),
                                 ("over", "price_forecast", json.dumps([seg | {"horizon": C.FORECAST_MAX_HORIZON + 1}])),
                                 ("most", "price_forecast", json.dumps([seg | {"horizon": C.FORECAST_MAX_HORIZON}])),
                                 ("nan", "price_forecast", '[{"state": "%s", "property_type": "%s", "horizon": "NaN"}]' % (seg["state"], seg["property_type"])),
                                 ("good", "price_forecast", json.dumps([seg | {"horizon": 3}]))], FIELDS)
    out = {r["request_id"]: json.loads(r["result"]) for r in RQ.route(far, AS_OF, baseline=base).collect()}
    assert out["2e9"] == out["over"] == {"error": f"horizon must be at most {C.FORECAST_MAX_HORIZON} months"}
    assert len(out["most"]) == C.FORECAST_MAX_HORIZON and len(out["good"]) == 3 and len(out["nan"]) == 12
    parsed = RQ.parse_payload(spark.createDataFrame([("f", "avm", '[{"hold_0_2": 1e20, "bed": "x"}, {"hold_0_2": "1"}]')], FIELDS))
    rows = RQ.explode_records(parsed, ["bed"], ["hold_0_2"]).orderBy("pos").collect()
    assert [(r["bed"], r["hold_0_2"]) for r in rows] == [(0.0, 0), (0.0, 1)]


def test_nan_infinity_and_repeated_keys(spark):
    req = spark.createDataFrame([("n", "avm", '[{"bed": "NaN", "bath": "Infinity", "hold_0_2": "NaN"}]'),
                                 ("twice", "avm", '[{"bed": 1, "state": "A", "bed": 2, "bath": 5, "bed": 3}]'),
                                 ("once", "avm", '[{"state": "A", "bath": 5, "bed": 3}]')], FIELDS)
    rows = {r["request_id"]: r for r in RQ.explode_records(RQ.parse_payload(req), ["bed", "bath"], ["hold_0_2"], ["state"]).collect()}
    assert (rows["n"]["bed"], rows["n"]["bath"], rows["n"]["hold_0_2"]) == (0.0, float("inf"), 0)
    assert (rows["twice"]["bed"], rows["twice"]["bath"], rows["twice"]["state"]) == (3.0, 5.0, "A")  # the last value counts
    unique, _ = RQ.dedupe_requests(req)
    assert sorted(r["request_id"] for r in unique.collect()) == ["n", "once"]


def test_equal_request_ids_keep_their_own_records(spark):
    base, seg, _ = segment(spark)
    req = spark.createDataFrame([("same", "price_forecast", json.dumps([seg | {"horizon": 1}])),
                                 ("same", "price_forecast", json.dumps([seg | {"horizon": 2}]))], FIELDS)
    sizes = sorted(len(json.loads(r["result"])) for r in RQ.route(req, AS_OF, baseline=base).collect())
    assert sizes == [1, 2]
    again = sorted(len(json.loads(r["result"])) for r in RQ.route_deduplicated(req.union(req), AS_OF, baseline=base).collect())
    assert again == [1, 1, 2, 2]


def test_odd_types_answer_valid_json(spark):
    base, seg, _ = segment(spark)
    req = spark.createDataFrame([("null", None, "[]"), ("tab", "a\tb\"c\\d\n", "[]"), ("line", "price_forecast\n", json.dumps([seg]))], FIELDS)
    out = {r["request_id"]: json.loads(r["result"]) for r in RQ.route(req, AS_OF, baseline=base).collect()}
    assert out["null"] == {"error": "Unknown model_type 'None'. Use: avm, lead_scoring, price_forecast"}
    assert out["tab"] == {"error": "Unknown model_type 'a\tb\"c\\d'. Use: avm, lead_scoring, price_forecast"}
    assert len(out["line"]) == 12


def test_unpacking_surfaces_errors_alone_and_in_a_list(spark):
    df = spark.createDataFrame([("a", '{"error": "x"}'), ("b", '[{"error": "y"}]'), ("c", "[]"), ("d", '[{"v": 1}, {"v": 2}]')],
                               "request_id string, result string")
    rows = sorted((r["request_id"], r["error"], r["pos"]) for r in RQ.unpack_responses(df).collect() if r["pos"] is None)
    assert rows == [("a", "x", None), ("b", "y", None), ("c", None, None)]
    assert RQ.unpack_responses(df).filter("request_id = 'd'").count() == 2


def test_schema_contract_parses_the_batch_once(spark):
    from plotline.plans.catalog import REGISTRY
    df = REGISTRY["schema_contract"][0](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan  # every reader takes the written records


def test_request_batch_joins_the_listings_once(spark, monkeypatch):
    import uuid

    from plotline.plans import queries_requests as Q
    from plotline.session import scratch_path
    folder, made, raw = scratch_path(spark, f"fresh-{uuid.uuid4().hex}"), [], P.raw
    monkeypatch.setattr(P, "_layer_path", lambda spark, sf, name: f"{folder}/{name}")
    monkeypatch.setattr(P, "raw", lambda spark, sf: made.append(sf) or raw(spark, sf))
    Q.request_batch(spark, SF_SMALL)
    assert made == [SF_SMALL]  # silver comes from the bronze layer that the batch reads as well

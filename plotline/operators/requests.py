"""Batch request routing: (model_type, payload JSON array) rows -> result JSON.

A batch of scoring requests is a DataFrame; each payload is parsed with
``from_json``, its records exploded, scored by the matching model plan, and
the per-request results gathered back (a request is one HTTP payload, so its
record list is bounded). Unknown types and unparsable payloads give a
per-row error object instead of failing the batch.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline import config as C
from plotline.functions.running import number
from plotline.session import written

REQUEST_SCHEMA = T.StructType([T.StructField("model_type", T.StringType(), True),
                               T.StructField("payload", T.StringType(), True)])
RECORDS = "array<map<string,string>>"


def check_schema(requests: DataFrame, contract: T.StructType = REQUEST_SCHEMA) -> DataFrame:
    """K-9: the batch must carry the (model_type string, payload string) columns."""
    have = {f.name: f.dataType for f in requests.schema.fields}
    for f in contract.fields:
        if have.get(f.name) != f.dataType:
            raise ValueError(f"request column {f.name} must be {f.dataType.simpleString()}")
    return requests


def error_object(msg: Column) -> Column:
    """K-3: {"error": "..."}, escaped as JSON, spaced as the notebook writes it."""
    return F.regexp_replace(F.to_json(F.struct(msg.alias("error"))), r'^\{"error":', '{"error": ')


def trimmed_type(mtype: str = "model_type") -> Column:
    """The model type without white space around it; a null type reads "None"."""
    return F.regexp_replace(F.coalesce(F.col(mtype), F.lit("None")), r"(?U)^\s+|\s+$", "")


def unknown_type_error(mtype: Column) -> Column:
    return error_object(F.concat(F.lit("Unknown model_type '"), mtype,
                                 F.lit("'. Use: avm, lead_scoring, price_forecast")))


def _last_wins(record: Column) -> Column:
    """A record whose keys occur once: of a repeated key the last value stays."""
    placed = F.array_sort(F.transform(F.map_entries(record), lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    last = F.filter(placed, lambda e, i: ~F.coalesce(F.get(placed, i + 1)["key"] == e["key"], F.lit(False)))
    keys = F.map_keys(record)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), record).otherwise(
        F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))))


def _records(payload: Column) -> Column:
    """The records of a payload, each key once; null if it is no JSON array of objects."""
    return F.transform(F.from_json(payload, RECORDS), _last_wins)


def parse_payload(requests: DataFrame) -> DataFrame:
    """K-1: trimmed type and parsed records (null when the payload is not a
    JSON array of objects; a single object is read as a one-record array; of a
    repeated key the last value counts)."""
    p = F.trim(F.col("payload"))
    as_array = F.when(p.startswith("{"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(p)
    return requests.withColumns({"mtype": trimmed_type(), "records": _records(as_array)})


def explode_records(parsed: DataFrame, numeric=(), binary=(), categorical=(), unknown: str = "unknown",
                    keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """One row per record with typed, defaulted fields (a value that is no number, NaN among them, or no int for a
    flag, -> 0; infinities are numbers)."""
    rec = parsed.select(*keys, F.posexplode("records").alias("pos", "r"))
    cols = {c: F.coalesce(number(F.col("r")[c]), F.lit(0.0)) for c in numeric}
    cols.update({c: F.coalesce(number(F.col("r")[c]).try_cast("int"), F.lit(0)) for c in binary})
    cols.update({c: F.coalesce(F.col("r")[c], F.lit(unknown)) for c in categorical})
    return rec.withColumns(cols)


_ROW = ("_row", "request_id", "model_type")


def _answers(rows: DataFrame, fields: list[str], order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """One struct per answered record: its place and its fields."""
    return rows.select(*_ROW, F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                                       *[F.col(f) for f in fields]).alias("answer"))


def gather(answers: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """K-4: per request, the records as a JSON array in record order (nulls
    kept); an asked request without a record answers []. A request is told
    by its row, so requests with equal ids keep their own records."""
    none = asked.select(*_ROW, F.lit(None).cast(answers.schema["answer"].dataType).alias("answer"))
    arr = F.array_sort(F.collect_list("answer"))  # skips the null of ``none``
    keep = F.transform(arr, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return answers.unionByName(none).groupBy(*_ROW).agg(F.to_json(keep, {"ignoreNullFields": "false"}).alias("result"))


def _horizon(record: Column) -> Column:
    return number(record["horizon"])


def fault(known: list[str]) -> Column:
    """The error that answers a parsed request (mtype, records), or null if one of the ``known`` models does."""
    far = F.exists("records", lambda r: F.coalesce(_horizon(r).between(C.FORECAST_MAX_HORIZON + 0.5, 2**31 - 1), F.lit(False)))
    return (F.when(~F.col("mtype").isin(*C.REQUEST_MODEL_TYPES), unknown_type_error(F.col("mtype")))
            .when(F.col("records").isNull(), error_object(F.lit("payload is not a JSON array of records")))
            .when(~F.col("mtype").isin(*known), error_object(F.concat(F.lit("model unavailable: "), F.col("mtype"))))
            .when((F.col("mtype") == "price_forecast") & far,
                  error_object(F.lit(f"horizon must be at most {C.FORECAST_MAX_HORIZON} months"))))


def known_types(valuation=None, lead=None, baseline=None) -> list[str]:
    """The model types that the given models answer."""
    return [t for t, m in zip(C.REQUEST_MODEL_TYPES, (valuation, lead, baseline)) if m is not None]


def route(requests: DataFrame, as_of: _dt.date, valuation=None, lead=None, baseline: DataFrame | None = None) -> DataFrame:
    """K-2: route every request to its model; returns request_id, model_type,
    result. ``requests`` needs request_id, model_type, payload; ids may repeat.

    The parsed batch is written once. Each answered branch gathers its records
    by request row and the errors are appended, so no payload is joined back.
    """
    return route_parsed(parsed_requests(requests), as_of, valuation, lead, baseline)


def parsed_requests(requests: DataFrame) -> DataFrame:
    """The requests of ``route`` with their records, parsed and written once, each with a number of its own."""
    check_schema(requests.select("model_type", "payload"))
    return written(parse_payload(requests.select("request_id", "model_type", "payload"))
                   .withColumn("_row", F.monotonically_increasing_id()).drop("payload"), "requests")


def route_parsed(parsed: DataFrame, as_of: _dt.date, valuation=None, lead=None, baseline: DataFrame | None = None) -> DataFrame:
    """``route`` for requests that ``parsed_requests`` has written: for callers that read the records as well."""
    from plotline.operators.forecast import forecast_requests
    judged = parsed.withColumn("wrong", fault(known_types(valuation, lead, baseline)))
    out = judged.filter(F.col("wrong").isNotNull()).select(*_ROW, F.col("wrong").alias("result"))
    ok = judged.filter(F.col("wrong").isNull())
    if valuation is not None:
        asked = ok.filter(F.col("mtype") == "avm")
        avm = explode_records(asked, C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL, keys=_ROW)
        scored = valuation.predict(avm, fill="zero").select(
            *_ROW, "pos", F.col("avm_estimate").alias("estimate"), F.col("avm_low").alias("low"),
            F.col("avm_high").alias("high"))
        fields = ["estimate", "low", "high"]
        out = out.unionByName(gather(_answers(scored, fields), asked, fields))
    if lead is not None:
        asked = ok.filter(F.col("mtype") == "lead_scoring")
        ld = explode_records(asked, C.LEAD_NUMERIC, C.LEAD_BINARY, C.LEAD_CAT, keys=_ROW)
        out = out.unionByName(gather(_answers(lead.predict(ld, fill="zero"), ["lead_score"]), asked, ["lead_score"]))
    if baseline is not None:
        asked = ok.filter(F.col("mtype") == "price_forecast")
        fc = asked.select(*_ROW, F.posexplode("records").alias("pos", "r"))
        fc = fc.select(*_ROW, "pos", F.col("r")["state"].alias("state"),
                       F.col("r")["property_type"].alias("property_type"),
                       _horizon(F.col("r")).try_cast("int").alias("horizon"))
        path = forecast_requests(fc, baseline, as_of).withColumn(
            "forecast_month", F.date_format(F.col("forecast_month").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        fields = ["forecast_month", "forecast_price", "forecast_price_low", "forecast_price_high", "state",
                  "property_type", "last_actual"]
        out = out.unionByName(gather(_answers(path, fields, ("pos", "forecast_month")), asked, fields))
    return check_answers(out.select("request_id", "model_type", "result"))


def check_answers(answers: DataFrame) -> DataFrame:
    """K-9, output side: one text column ``result``."""
    if answers.schema["result"].dataType != T.StringType():
        raise ValueError("result must be a string")
    return answers


def canonical_payload(payload: Column, records: Column | None = None) -> Column:
    """Records re-serialised with their keys sorted (equal requests -> equal text; a repeated key has its last value).
    ``records`` are those of ``parse_payload``, if the request has been parsed: only a single object is then parsed again,
    as its text may go on behind the object."""
    recs = _records(payload) if records is None else F.when(F.trim(payload).startswith("{"), _records(payload)).otherwise(records)
    return F.to_json(F.transform(recs, lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))))


def request_key(records: Column | None = None) -> Column:
    """Equal for identical requests: the trimmed type and the canonical payload (raw text if it does not parse)."""
    return F.md5(F.concat_ws("\u0001", trimmed_type(), F.coalesce(canonical_payload(F.col("payload"), records), F.col("payload"), F.lit("\u0000"))))


def dedupe_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K-5: identical requests (same trimmed type and canonical payload) are
    answered once. Returns (unique requests to route, request_id -> key map).
    Unparsable payloads keep their raw text as key; a null payload is one too.

    The keyed requests (16 bytes a key) are dealt by key once, for the grouping and for the join of a caller."""
    key = F.coalesce(F.unhex(request_key()), F.lit(b""))  # never null, so that no join asks and parses once more
    keyed = requests.withColumn("_key", key).repartition("_key")
    unique = (keyed.groupBy("_key").agg(F.min("request_id").alias("request_id"),
                                        F.min("model_type").alias("model_type"),
                                        F.min("payload").alias("payload")))
    return unique, keyed.select("request_id", "model_type", "_key")


def route_deduplicated(requests: DataFrame, as_of: _dt.date, **models) -> DataFrame:
    """K-5 + K-2: route the unique requests (told by their key), then answer every request."""
    unique, keys = dedupe_requests(requests)
    routed = route(unique.select(F.col("_key").alias("request_id"), "model_type", "payload"), as_of, **models)
    return keys.join(routed.select(F.col("request_id").alias("_key"), "result"), "_key").select("request_id", "model_type", "result")


def unpack_responses(responses: DataFrame) -> DataFrame:
    """K-6: result text -> one row per returned record, or the error text. An
    error is an object with ``error``, alone or as the first of a list."""
    r = F.trim(F.col("result"))
    is_obj = r.startswith("{")
    recs = F.from_json(F.when(is_obj, F.concat(F.lit("["), r, F.lit("]"))).otherwise(r), RECORDS)
    out = responses.select("request_id", recs.alias("records"))
    err = F.try_element_at(F.col("records"), F.lit(1))["error"]
    return (out.select("request_id", err.alias("error"), F.when(err.isNull(), F.col("records")).alias("records"))
            .select("request_id", "error", F.posexplode_outer("records").alias("pos", "record")))


def example_payload(defaults_numeric=C.AVM_NUMERIC + C.AVM_BINARY, defaults_cat=C.AVM_CATEGORICAL,
                    overrides: dict[str, Column] | None = None) -> Column:
    """K-7: the input example (0 for numbers and flags, 'unknown' for
    categories), as a one-record JSON array."""
    overrides = overrides or {}
    fields = [overrides.get(c, F.lit(0)).alias(c) for c in defaults_numeric]
    fields += [overrides.get(c, F.lit("unknown")).alias(c) for c in defaults_cat]
    return F.to_json(F.array(F.struct(*fields)))

"""Registered queries: request batches derived from the listings, routing,
dedupe, unpacking; table writes, namespaces and row counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import config as C
from plotline import oracle as O
from plotline.operators import requests as RQ
from plotline.operators.features import hold_buckets_request
from plotline.plans import common as P
from plotline.plans.catalog import register, sel
from plotline.sources import snapshots as SN

AVM_FIELDS = ["bed", "bath", "house_size", "acre_lot", "state", "zip_code", "property_type"]
LEAD_FIELDS = ["years_since_last_sale", "price", "bed", "house_size", "state", "property_type"]


def avm_requests(spark, sf):
    act = P.active_df(spark, sf)
    return act.select(F.concat(F.lit("avm-"), "listing_id").alias("request_id"), F.lit("avm").alias("model_type"),
                      F.to_json(F.array(F.struct(*AVM_FIELDS))).alias("payload"))


def request_batch(spark, sf):
    """A request table derived from the listings: one valuation request per
    active listing, one lead request per lead row (form-style hold flags), one
    forecast request per segment, the input example per property type, an
    unknown type for 'pending' rows and a truncated payload for
    'ready_to_build' rows."""
    b = P.bronze_df(spark, sf)  # before silver, which is then made from it
    s = P.silver_df(spark, sf)
    lead = P.lead_df(spark, sf)
    flags = hold_buckets_request()
    lead_req = lead.select(F.concat(F.lit("lead-"), "listing_id").alias("request_id"),
                           F.lit(" lead_scoring ").alias("model_type"),
                           F.to_json(F.array(F.struct(*LEAD_FIELDS, *[c.alias(k) for k, c in flags.items()])))
                           .alias("payload"))
    fc = (P.active_listings(s).select("state", "property_type").distinct()
          .select(F.concat(F.lit("fc-"), "state", F.lit("|"), "property_type").alias("request_id"),
                  F.lit("price_forecast").alias("model_type"),
                  F.to_json(F.array(F.struct("state", "property_type", F.lit(12).alias("horizon")))).alias("payload")))
    example = (P.active_listings(s).select("property_type").distinct()
               .select(F.concat(F.lit("ex-"), "property_type").alias("request_id"), F.lit("avm").alias("model_type"),
                       RQ.example_payload(overrides={"property_type": F.col("property_type")}).alias("payload")))
    unknown = b.filter(F.col("status") == "pending").select(
        F.concat(F.lit("unk-"), "listing_id").alias("request_id"), F.lit("valuation").alias("model_type"),
        F.to_json(F.array(F.struct("bed", "bath"))).alias("payload"))
    bad = b.filter(F.col("status") == "ready_to_build").select(
        F.concat(F.lit("bad-"), "listing_id").alias("request_id"), F.lit("avm").alias("model_type"),
        F.concat(F.lit('[{"bed": '), F.coalesce(F.col("bed").cast("string"), F.lit("null"))).alias("payload"))
    return (avm_requests(spark, sf).unionByName(lead_req).unionByName(fc).unionByName(example)
            .unionByName(unknown).unionByName(bad))


def _models(spark, sf):
    """The models of the bundle that the batch run saved and promoted."""
    from plotline.plans.queries_models import batch
    from plotline.plans.versions import serving
    return serving(spark, batch(spark, sf, "bundle").path("models")).models()


_FORECAST_KEYS = ("forecast_month", "forecast_price", "forecast_price_high", "forecast_price_low", "last_actual",
                  "property_type", "state")
#: Every request as (request_id, model_type, kind), as ``request_batch`` makes them.
_BATCH = """batch AS (
  SELECT 'avm-' || listing_id AS request_id, 'avm' AS model_type, 'avm' AS kind FROM active
  UNION ALL SELECT 'lead-' || listing_id, ' lead_scoring ', 'lead' FROM lead
  UNION ALL SELECT DISTINCT 'fc-' || state || '|' || property_type, 'price_forecast', 'fc' FROM active
  UNION ALL SELECT DISTINCT 'ex-' || property_type, 'avm', 'avm' FROM active
  UNION ALL SELECT 'unk-' || listing_id, 'valuation', 'unknown' FROM bronze WHERE status = 'pending'
  UNION ALL SELECT 'bad-' || listing_id, 'avm', 'bad' FROM bronze WHERE status = 'ready_to_build')"""
_EXPLODED = ["bed", "bath", "house_size", "acre_lot", "years_since_last_sale", "price"]


def _exploded_sql(kind: str, src: str, fields: list[str]) -> str:
    nums = [f"{O.r(f'coalesce({c}, CAST(0.0 AS DOUBLE))') if c in fields else 'CAST(0.0 AS DOUBLE)'} AS {c}" for c in _EXPLODED]
    cats = [f"coalesce({c}, 'unknown') AS {c}" if c in fields else f"'unknown' AS {c}" for c in ("state", "zip_code", "property_type")]
    return f"SELECT '{kind}-' || listing_id AS request_id, 0 AS pos, {', '.join(nums + cats)} FROM {src}"


@register("payload_explode", O.with_base(
    f"{_exploded_sql('avm', 'active', AVM_FIELDS)} UNION ALL {_exploded_sql('lead', 'lead', LEAD_FIELDS)} UNION ALL "
    "SELECT DISTINCT 'fc-' || state || '|' || property_type, 0, " + ", ".join(["CAST(0.0 AS DOUBLE)"] * len(_EXPLODED))
    + ", state, 'unknown', property_type FROM active UNION ALL SELECT DISTINCT 'ex-' || property_type, 0, "
    + ", ".join(["CAST(0.0 AS DOUBLE)"] * len(_EXPLODED)) + ", 'unknown', 'unknown', property_type FROM active "
    f"UNION ALL SELECT 'unk-' || listing_id, 0, {O.r('coalesce(bed, CAST(0.0 AS DOUBLE))')}, "
    f"{O.r('coalesce(bath, CAST(0.0 AS DOUBLE))')}, " + ", ".join(["CAST(0.0 AS DOUBLE)"] * (len(_EXPLODED) - 2))
    + ", 'unknown', 'unknown', 'unknown' FROM bronze WHERE status = 'pending'"))
def q_payload_explode(spark, sf):
    """K-1: payload arrays of every request kind parsed into typed records with
    defaults (a payload that does not parse has no record)."""
    parsed = RQ.parse_payload(request_batch(spark, sf))
    rec = RQ.explode_records(parsed, _EXPLODED, [], ["state", "zip_code", "property_type"])
    return P.rounded(rec.select("request_id", "pos", *_EXPLODED, "state", "zip_code", "property_type"))


@register("route_unknown", O.with_base(
    "SELECT 'unk-' || listing_id AS request_id, '{\"error\": \"Unknown model_type ''valuation''. Use: avm, "
    "lead_scoring, price_forecast\"}' AS result FROM bronze WHERE status = 'pending'"))
def q_route_unknown(spark, sf):
    """K-3: an unknown model type answers with an error object."""
    req = request_batch(spark, sf).filter(F.col("request_id").startswith("unk-"))
    return RQ.route(req, C.ADAPTER_AS_OF).select("request_id", "result")


@register("route_requests", None)
def q_route_requests(spark, sf):
    """K-2 + K-5: the whole request batch routed to the valuation, lead and
    forecast plans, identical requests answered once."""
    return RQ.route_deduplicated(request_batch(spark, sf), C.ADAPTER_AS_OF, **_models(spark, sf))


@register("route_walk", O.with_base("SELECT request_id, true AS agrees FROM batch WHERE kind IN ('avm', 'lead')", _BATCH))
def q_route_walk(spark, sf):
    """K-2 checked exactly: the answer of every valuation and lead request is what the walked ensembles give for its payload."""
    from plotline.plans.queries_models import _agree
    from plotline.plans.walk import walked_lead, walked_valuation
    models = _models(spark, sf)
    batch = request_batch(spark, sf).filter(F.trim("model_type").isin("avm", "lead_scoring"))
    answers = RQ.unpack_responses(RQ.route_deduplicated(batch, C.ADAPTER_AS_OF, **models)).filter("pos = 0 and error is null")
    answers = answers.select("request_id", F.coalesce(F.col("record")["estimate"], F.col("record")["lead_score"]).cast("double").alias("answer"))
    parsed = RQ.parse_payload(batch.dropDuplicates(["request_id"])).filter("records is not null")  # an id's requests are equal
    avm = RQ.explode_records(parsed.filter(F.col("mtype") == "avm"), C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL)
    walked = walked_valuation(models["valuation"], avm, ["request_id"], fill="zero").withColumnRenamed("estimate", "walked")
    if models["lead"] is not None:
        ld = RQ.explode_records(parsed.filter(F.col("mtype") == "lead_scoring"), C.LEAD_NUMERIC, C.LEAD_BINARY, C.LEAD_CAT)
        walked = walked.unionByName(walked_lead(models["lead"], ld, ["request_id"]).withColumnRenamed("score", "walked"))
    return answers.join(walked, "request_id").select("request_id", _agree("answer", "walked").alias("agrees"))


_FC_NUMBERS = ["forecast_price", "forecast_price_low", "forecast_price_high", "last_actual"]


@register("records_to_json", O.with_base(
    "SELECT r.request_id, CAST(f.k - 1 AS INTEGER) AS pos, strftime(f.forecast_month, '%Y-%m-%dT00:00:00.000') AS forecast_month, "
    + ", ".join(f"{O.r('f.' + c)} AS {c}" for c in _FC_NUMBERS) + ", f.state, f.property_type "
    "FROM (SELECT DISTINCT state, property_type, 'fc-' || state || '|' || property_type AS request_id FROM active) r "
    "LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY state, property_type ORDER BY forecast_month) AS k FROM forecast) f "
    "ON r.state = f.state AND r.property_type = f.property_type"))
def q_records_to_json(spark, sf):
    """K-4: forecast requests answered as JSON record arrays (ISO months, [] for
    a segment without a baseline), parsed back."""
    from plotline.operators.forecast import baseline_medians
    req = request_batch(spark, sf).filter(F.col("request_id").startswith("fc-"))
    answers = RQ.unpack_responses(RQ.route(req, C.ADAPTER_AS_OF, baseline=baseline_medians(P.active_df(spark, sf))))
    r = F.col("record")
    return P.rounded(answers.select("request_id", "pos", r["forecast_month"].alias("forecast_month"),
                                    *[r[c].cast("double").alias(c) for c in _FC_NUMBERS],
                                    r["state"].alias("state"), r["property_type"].alias("property_type")))


_DEDUP_KEY = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in AVM_FIELDS)
_LEAD_FLAGS = ["hold_0_2", "hold_2_5", "hold_5_10", "hold_10_plus", "long_hold", "very_long_hold"]
_LEAD_KEY = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in LEAD_FIELDS)


@register("request_dedupe", O.with_base(
    f"SELECT 'avm-' || listing_id AS request_id, min('avm-' || listing_id) OVER (PARTITION BY {_DEDUP_KEY}) "
    f"AS answered_by FROM active UNION ALL SELECT 'lead-' || listing_id, min('lead-' || listing_id) OVER (PARTITION BY {_LEAD_KEY}) "
    "FROM lead UNION ALL SELECT request_id, request_id FROM (SELECT DISTINCT 'fc-' || state || '|' || property_type AS request_id "
    "FROM active) UNION ALL SELECT request_id, request_id FROM (SELECT DISTINCT 'ex-' || property_type AS request_id FROM active) "
    "UNION ALL SELECT 'unk-' || listing_id, min('unk-' || listing_id) OVER (PARTITION BY bed, bath) FROM bronze "
    "WHERE status = 'pending' UNION ALL SELECT 'bad-' || listing_id, min('bad-' || listing_id) OVER (PARTITION BY bed) "
    "FROM bronze WHERE status = 'ready_to_build'"))
def q_request_dedupe(spark, sf):
    """K-5: identical requests of every kind map to one answered request."""
    unique, keys = RQ.dedupe_requests(request_batch(spark, sf))
    return keys.join(unique.select("_key", F.col("request_id").alias("answered_by")), "_key") \
        .select("request_id", "answered_by")


_UNKNOWN = "'Unknown model_type ''valuation''. Use: avm, lead_scoring, price_forecast'"


@register("response_unpack", O.with_base(
    "SELECT b.request_id, CASE b.kind WHEN 'unknown' THEN " + _UNKNOWN + " WHEN 'bad' THEN 'payload is not a JSON array of "
    "records' END AS error, CASE WHEN b.kind IN ('avm', 'lead') THEN 0 WHEN b.kind = 'fc' THEN CAST(f.k - 1 AS INTEGER) END AS pos, "
    "CASE WHEN b.kind = 'avm' THEN 'estimate,high,low' WHEN b.kind = 'lead' THEN 'lead_score' WHEN f.k IS NOT NULL THEN '"
    + ",".join(_FORECAST_KEYS) + "' END AS keys FROM batch b LEFT JOIN (SELECT 'fc-' || state || '|' || property_type AS "
    "request_id, row_number() OVER (PARTITION BY state, property_type ORDER BY forecast_month) AS k FROM forecast) f "
    "ON b.request_id = f.request_id", _BATCH))
def q_response_unpack(spark, sf):
    """K-6: answers of the whole batch unpacked into records (their fields
    here, as fitted values have no SQL form), errors surfaced as a column."""
    answers = RQ.unpack_responses(RQ.route_deduplicated(request_batch(spark, sf), C.ADAPTER_AS_OF, **_models(spark, sf)))
    return answers.select("request_id", "error", "pos",
                          F.array_join(F.array_sort(F.map_keys("record")), ",").alias("keys"))


def _example_sql() -> str:
    parts = [f'"{c}":0' for c in C.AVM_NUMERIC + C.AVM_BINARY]
    cat = []
    for c in C.AVM_CATEGORICAL:
        cat.append(f'"{c}":"\' || property_type || \'"' if c == "property_type" else f'"{c}":"unknown"')
    body = ",".join(parts + cat)
    return (f"SELECT DISTINCT 'ex-' || property_type AS request_id, 'avm' AS model_type, "
            f"'[{{{body}}}]' AS payload FROM active")


@register("example_payload", O.with_base(_example_sql()))
def q_example_payload(spark, sf):
    """K-7: the default input example per property type found in the data."""
    return request_batch(spark, sf).filter(F.col("request_id").startswith("ex-"))


@register("schema_contract", O.with_base(
    "SELECT request_id, model_type, CASE WHEN kind = 'bad' THEN NULL ELSE 1 END AS records, "
    "CASE kind WHEN 'unknown' THEN true WHEN 'bad' THEN true ELSE false END AS answered FROM batch", _BATCH))
def q_schema_contract(spark, sf):
    """K-9: the batch checked against the (model_type, payload) text contract;
    the records of a payload, and whether its answer (without any model: an
    error for unknown types and broken payloads) is the one text column."""
    parsed = RQ.parsed_requests(RQ.check_schema(request_batch(spark, sf)))
    answers = RQ.check_answers(RQ.route_parsed(parsed, C.ADAPTER_AS_OF)).filter(~F.col("result").contains("model unavailable"))
    answered = answers.select("request_id", F.lit(True).alias("answered")).distinct()
    return (parsed.select("request_id", "model_type", F.when(F.col("records").isNotNull(), F.size("records")).alias("records"))
            .join(answered, "request_id", "left").withColumn("answered", F.coalesce("answered", F.lit(False))))


# ------------------------------------------------------------- writes, tables
def _scratch(spark, name, sf):
    from plotline.session import scratch_path
    return scratch_path(spark, f"tables/{P.sf_key(spark, sf)}/{name}")


@register("write_overwrite", O.with_base(f"SELECT {sel(['state', 'zip_code', 'property_type', 'sold_count', 'median_sold_price'])} FROM market"))
def q_write_overwrite(spark, sf):
    """S-7: a table of another schema is replaced in one step, the new schema is read back."""
    path = _scratch(spark, "market_snapshots", sf)
    market = P.market_df(spark, sf)
    SN.replace(market.groupBy("state").agg(F.count(F.lit(1)).alias("old_rows")), path)
    SN.replace(market.select("state", "zip_code", "property_type", "sold_count", "median_sold_price"), path)
    return P.rounded(SN.read(spark, path))


@register("write_partitioned", O.with_base("SELECT listing_id, state, status FROM bronze"))
def q_write_partitioned(spark, sf):
    """S-8: hive-style partitions by state, rows placed by state first (a task
    writes few states; large states are split over tasks)."""
    path = _scratch(spark, "bronze_listings", sf)
    SN.replace_by(P.bronze_df(spark, sf), path, "state")
    return SN.read(spark, path).select("listing_id", "state", "status")


def _ensure_namespaces(spark, sf) -> str:
    """The four namespaces of this input folder; returns the name of the bronze table, saved anew."""
    key = P.sf_key(spark, sf)
    for db in ("bronze", "silver", "gold", "features"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS plotline_{db}_{key} LOCATION '{_scratch(spark, 'db_' + db, sf)}'")
    table = f"plotline_bronze_{key}.listings"
    P.bronze_df(spark, sf).hint("rebalance", "state").write.mode("overwrite").partitionBy("state").saveAsTable(table)
    return table


@register("create_namespace", O.with_base("SELECT state, count(*) AS n FROM bronze GROUP BY state"))
def q_create_namespace(spark, sf):
    """S-9: the four namespaces, the bronze table saved into one, counted back."""
    return spark.table(_ensure_namespaces(spark, sf)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@register("scan_table", O.with_base("SELECT listing_id, status, zip_code FROM bronze"))
def q_scan_table(spark, sf):
    """S-3: read a named table."""
    return spark.table(_ensure_namespaces(spark, sf)).select("listing_id", "status", "zip_code")


@register("row_counts", O.with_base(
    "SELECT 'sold_listings' AS table_name, count(*) AS row_count, 'ok' AS status FROM sold "
    "UNION ALL SELECT 'active_listings', count(*), 'ok' FROM active "
    "UNION ALL SELECT 'market_snapshots', count(*), 'ok' FROM market "
    "UNION ALL SELECT 'investment_scores', CAST(NULL AS BIGINT), 'skipped'"))
def q_row_counts(spark, sf):
    """S-11: row counts of written tables, as the writes counted them; an absent table is 'skipped'."""
    s = P.silver_df(spark, sf)
    paths = {}
    for name, df in (("sold_listings", P.sold_listings(s)), ("active_listings", P.active_listings(s)),
                     ("market_snapshots", P.market_df(spark, sf))):
        paths[name] = _scratch(spark, f"rc_{name}", sf)
        SN.replace(df, paths[name])
    paths["investment_scores"] = _scratch(spark, "rc_never_written", sf)
    return SN.row_counts(spark, paths)


@register("skip_empty_write", O.with_base(
    f"SELECT {sel(['state', 'property_type', 'forecast_month', 'forecast_price'])} FROM forecast"))
def q_skip_empty_write(spark, sf):
    """S-12: write only non-empty output (an empty frame leaves the table as it was)."""
    from plotline.operators.forecast import price_forecasts
    fc = price_forecasts(P.active_df(spark, sf), C.ADAPTER_AS_OF)
    path = _scratch(spark, "price_forecasts", sf)
    SN.replace(fc, path, skip_empty=True)
    SN.replace(fc.filter(F.lit(False)), path, skip_empty=True)
    return P.rounded(SN.read(spark, path).select("state", "property_type", "forecast_month", "forecast_price"))


@register("route_stream", None)
def q_route_stream(spark, sf):
    """K-2 as a stream: every request lands as JSON, a Structured Streaming job
    routes each micro-batch to all three models, answers are read back."""
    from plotline.streaming.requests_stream import serve
    base = _scratch(spark, "request_stream", sf)
    request_batch(spark, sf).write.mode("overwrite").json(f"{base}/landing")
    import uuid
    run = uuid.uuid4().hex
    q = serve(spark, f"{base}/landing", f"{base}/answers/{run}", f"{base}/checkpoints/{run}", C.ADAPTER_AS_OF,
              **_models(spark, sf))
    q.awaitTermination()
    return spark.read.parquet(f"{base}/answers/{run}").select("request_id", "model_type", "result")


_WAVE = "CASE WHEN substr(listing_id, 1, 1) < '5' THEN 0 WHEN substr(listing_id, 1, 1) < 'a' THEN 1 ELSE 2 END"


@register("request_cache", O.with_base(
    "SELECT request_id, min(CASE WHEN batch = first_batch THEN request_id END) OVER (PARTITION BY state, property_type) AS answered_by, "
    "CAST(batch AS BIGINT) AS batch FROM first_asked",
    f"waves AS (SELECT 'fw-' || listing_id AS request_id, state, property_type, {_WAVE} AS batch FROM active), "
    "first_asked AS (SELECT *, min(batch) OVER (PARTITION BY state, property_type) AS first_batch FROM waves)"))
def q_request_cache(spark, sf):
    """K-5 across micro-batches: one forecast request per active listing lands in three waves, the stream is started
    anew for each; a request of a segment that an earlier wave asked for is answered by that request."""
    import uuid

    from plotline.operators.forecast import baseline_medians
    from plotline.streaming.requests_stream import serve
    base = f"{_scratch(spark, 'request_cache', sf)}/{uuid.uuid4().hex}"
    active = P.active_df(spark, sf)
    first = F.substring("listing_id", 1, 1)
    requests = active.select(F.concat(F.lit("fw-"), "listing_id").alias("request_id"), F.lit("price_forecast").alias("model_type"),
                             F.to_json(F.array(F.struct("state", "property_type", F.lit(12).alias("horizon")))).alias("payload"),
                             F.when(first < "5", 0).when(first < "a", 1).otherwise(2).alias("wave"))
    medians = baseline_medians(active)
    for wave in range(3):
        requests.filter(F.col("wave") == wave).drop("wave").write.mode("append").json(f"{base}/landing")
        serve(spark, f"{base}/landing", f"{base}/answers", f"{base}/checkpoint", C.ADAPTER_AS_OF, max_files_per_trigger=1_000_000,
              baseline=medians).awaitTermination()
    return spark.read.parquet(f"{base}/answers").select("request_id", "answered_by", F.col("batch_id").cast("long").alias("batch"))

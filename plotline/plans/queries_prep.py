"""Registered queries: preparation, splits, folds, metrics, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline import config as C
from plotline import oracle as O
from plotline.functions import columns as X
from plotline.operators import metrics as M
from plotline.operators import prep as PR
from plotline.operators import silver as SV
from plotline.plans import common as P
from plotline.plans.catalog import register, sel

TRAIN_WHERE = "price BETWEEN 10000 AND 50000000 AND quality_score >= 0.6 AND property_type <> 'LAND'"
AVM_ALL = C.AVM_NUMERIC + C.AVM_CATEGORICAL + C.AVM_BINARY


def train_df(spark, sf):
    """P-8: the valuation training rows."""
    return P.prop_df(spark, sf).filter(SV.price_in_range() & (F.col("quality_score") >= 0.6)
                                       & (F.col("property_type") != "LAND"))


def _fill_sql(src: str, numeric, binary, categorical, medians_from: str | None) -> str:
    parts = []
    for c in numeric:
        fill = f"(SELECT median({c}) FROM {medians_from})" if medians_from else "NULL"
        parts.append(f"{O.r(f'coalesce(TRY_CAST({c} AS DOUBLE), {fill}, CAST(0.0 AS DOUBLE))')} AS {c}")
    parts += [f"coalesce(TRY_CAST({c} AS INTEGER), 0) AS {c}" for c in binary]
    parts += [f"coalesce(CAST({c} AS VARCHAR), 'unknown') AS {c}" for c in categorical]
    return f"SELECT listing_id, {', '.join(parts)} FROM {src}"


TRAIN_CTE = f"train AS (SELECT * FROM prop WHERE {TRAIN_WHERE})"


@register("global_median_fill", O.with_base(
    "SELECT " + ", ".join(f"{O.r(f'median({c})')} AS {c}" for c in C.AVM_NUMERIC) + " FROM train", TRAIN_CTE))
def q_global_median_fill(spark, sf):
    """G-6: exact column medians of the training rows (one row)."""
    med = PR.fit_median_fill(train_df(spark, sf), C.AVM_NUMERIC)
    schema = ", ".join(f"{c} double" for c in C.AVM_NUMERIC)
    return P.rounded(spark.createDataFrame([tuple(med[c] for c in C.AVM_NUMERIC)], schema))


@register("impute_train", O.with_base(
    _fill_sql("train", C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL, "train"), TRAIN_CTE))
def q_impute_train(spark, sf):
    """M-1: numeric -> training median, binary -> 0, category -> 'unknown'."""
    df, _ = PR.impute_train(train_df(spark, sf), C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL)
    return P.rounded(df.select("listing_id", *AVM_ALL))


ACTIVE_MISSING = [c for c in AVM_ALL if c not in {
    "bed", "bath", "house_size", "acre_lot", "lot_sqft", "bath_bed_ratio", "lot_to_living_ratio",
    "census_median_income", "census_median_home_value", "census_median_gross_rent", "census_unemployment_rate",
    "census_poverty_rate", "census_vacancy_rate", "census_owner_occ_rate", "census_college_pct",
    "state", "zip_code", "property_type", "state_tier", "sqft_bucket", "has_prior_sale"}]


def _missing_sql_cols():
    out = []
    for c in ACTIVE_MISSING:
        if c in C.AVM_NUMERIC:
            out.append(f"CAST(0.0 AS DOUBLE) AS {c}")
        elif c in C.AVM_BINARY:
            out.append(f"0 AS {c}")
        else:
            out.append(f"'unknown' AS {c}")
    return out


@register("add_missing_cols", O.with_base(f"SELECT listing_id, {', '.join(_missing_sql_cols())} FROM active"))
def q_add_missing_cols(spark, sf):
    """P-45: active listings lack the context features; add them with typed defaults."""
    df = PR.add_missing_columns(P.active_df(spark, sf), C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL)
    return df.select("listing_id", *ACTIVE_MISSING)


@register("impute_zero", O.with_base(
    _fill_sql("(SELECT *, " + ", ".join(_missing_sql_cols()) + " FROM active)",
              C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL, None)))
def q_impute_zero(spark, sf):
    """M-2: scoring preparation: missing columns added, numeric -> 0,
    binary -> 0, category -> 'unknown'."""
    df = PR.add_missing_columns(P.active_df(spark, sf), C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL)
    return P.rounded(PR.impute(df, C.AVM_NUMERIC, C.AVM_BINARY, C.AVM_CATEGORICAL, 0.0).select("listing_id", *AVM_ALL))


SCALE_COLS = C.AVM_NUMERIC


@register("standard_scale", O.with_base(
    "SELECT listing_id, " + ", ".join(
        f"{O.r(f'(x_{c} - avg(x_{c}) OVER ()) / CASE WHEN stddev_pop(x_{c}) OVER () > 0 THEN stddev_pop(x_{c}) OVER () ELSE 1 END')} AS {c}"
        for c in SCALE_COLS) + " FROM (SELECT listing_id, " + ", ".join(
        f"coalesce(TRY_CAST({c} AS DOUBLE), (SELECT median({c}) FROM train), CAST(0.0 AS DOUBLE)) AS x_{c}"
        for c in SCALE_COLS) + " FROM train) t", TRAIN_CTE))
def q_standard_scale(spark, sf):
    """M-3: (x - mean) / population std on median-filled training columns."""
    df, _ = PR.impute_train(train_df(spark, sf), SCALE_COLS)
    params = PR.fit_standard_scaler(df, SCALE_COLS)
    return P.rounded(PR.standard_scale(df, params).select("listing_id", *SCALE_COLS))


_HOLD_OUT = "(" + ", ".join(O.q(s) for s in C.AVM_TEST_STATES) + ")"


def _codes_sql(src: str, fit_where: str) -> str:
    """The ordinal codes of every category of ``src``, vocabularies from the rows that ``fit_where`` keeps."""
    joins = " ".join(
        f"LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} AS v "
        f"FROM {src} WHERE {fit_where} AND {c} IS NOT NULL)) v_{c} ON p.{c} = v_{c}.v" for c in C.AVM_CATEGORICAL)
    return ", ".join(f"coalesce(v_{c}.code, -1) AS {c}_code" for c in C.AVM_CATEGORICAL) + f" FROM {src} p {joins}"


@register("ordinal_encode", O.with_base(f"SELECT p.listing_id, {_codes_sql('prop', f'state NOT IN {_HOLD_OUT}')}"))
def q_ordinal_encode(spark, sf):
    """M-4: vocabularies of all five categories fitted on the non-held-out
    states, applied to all rows; the held-out states are unseen and get -1."""
    prop = P.prop_df(spark, sf)
    fit = prop.filter(~F.col("state").isin(*C.AVM_TEST_STATES))
    out = prop
    for c in C.AVM_CATEGORICAL:
        out = PR.ordinal_encode(out, c, PR.fit_vocabulary(fit, c), f"{c}_code")
    return out.select("listing_id", *[f"{c}_code" for c in C.AVM_CATEGORICAL])


@register("random_split", O.with_base(
    "SELECT listing_id, CAST(row_number() OVER (ORDER BY md5(listing_id || '|42'), listing_id) "
    "<= ceil(0.15 * count(*) OVER ()) AS INTEGER) AS is_test FROM prop WHERE census_median_gross_rent "
    "BETWEEN 200 AND 10000 AND quality_score >= 0.6"))
def q_random_split(spark, sf):
    """M-6: exactly ceil(15%) of the rent training rows as validation, by md5 order."""
    df = P.prop_df(spark, sf).filter(F.col("census_median_gross_rent").between(200, 10_000)
                                     & (F.col("quality_score") >= 0.6))
    return PR.exact_split(df.select("listing_id"), "listing_id", 0.15, 42)


LEAD_TRAIN = "lead_train AS (SELECT * FROM lead_labeled WHERE years_since_last_sale IS NOT NULL)"


@register("stratified_split", O.with_base(
    "SELECT listing_id, motivated_seller, is_test, CASE WHEN is_test = 1 THEN 0 ELSE CAST(row_number() OVER "
    "(PARTITION BY motivated_seller, is_test ORDER BY md5(listing_id || '|42'), listing_id) <= ceil(0.15 * "
    "count(*) OVER (PARTITION BY motivated_seller, is_test)) AS INTEGER) END AS is_val FROM ("
    "SELECT listing_id, motivated_seller, CAST(row_number() OVER (PARTITION BY motivated_seller ORDER BY "
    "md5(listing_id || '|42'), listing_id) <= ceil(0.2 * count(*) OVER (PARTITION BY motivated_seller)) AS INTEGER)"
    " AS is_test FROM lead_train) t", LEAD_TRAIN))
def q_stratified_split(spark, sf):
    """M-7: 20% test per class, then 15% of the rest per class as validation."""
    df = P.lead_labeled_df(spark, sf).na.drop(subset=["years_since_last_sale"]).select("listing_id", "motivated_seller")
    df = PR.exact_split(df, "listing_id", 0.2, 42, label="motivated_seller", out="is_test")
    train = PR.exact_split(df.filter("is_test = 0"), "listing_id", 0.15, 42, label="motivated_seller", out="is_val")
    test = df.filter("is_test = 1").withColumn("is_val", F.lit(0))
    return train.unionByName(test)


_FOLDS = (f"""SELECT state, fold, n AS count FROM folds WHERE i > 0""", TRAIN_CTE, f"""g AS (
  SELECT state, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, state) AS i FROM train
  WHERE state NOT IN {_HOLD_OUT} GROUP BY state)""", """folds AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS state, CAST(0 AS BIGINT) AS n, 0 AS fold,
    CAST(0 AS BIGINT) AS l0, CAST(0 AS BIGINT) AS l1, CAST(0 AS BIGINT) AS l2
  UNION ALL
  SELECT x.i, x.state, x.n, x.fold, l0 + CASE WHEN x.fold = 0 THEN x.n ELSE 0 END,
    l1 + CASE WHEN x.fold = 1 THEN x.n ELSE 0 END, l2 + CASE WHEN x.fold = 2 THEN x.n ELSE 0 END
  FROM (SELECT g.i, g.state, g.n, f.l0, f.l1, f.l2,
          CASE WHEN l0 <= l1 AND l0 <= l2 THEN 0 WHEN l1 <= l2 THEN 1 ELSE 2 END AS fold
        FROM folds f JOIN g ON g.i = f.i + 1) x)""")


@register("group_kfold", O.with_base(*_FOLDS).replace("WITH ", "WITH RECURSIVE ", 1))
def q_group_kfold(spark, sf):
    """M-8: 3 folds over the training states; no state spans two folds."""
    df = train_df(spark, sf).filter(~F.col("state").isin(*C.AVM_TEST_STATES))
    return PR.group_kfold_map(df, "state", 3).join(df.groupBy("state").count(), "state")


@register("missing_group_default", O.with_base("SELECT listing_id, coalesce(state, 'unknown') AS fold_group FROM train",
                                               TRAIN_CTE))
def q_missing_group_default(spark, sf):
    """M-9: a missing group becomes 'unknown'."""
    return train_df(spark, sf).select("listing_id", F.coalesce("state", F.lit("unknown")).alias("fold_group"))


# ------------------------------------------------------------------- metrics
_EPS = repr(M.EPS)


@register("regression_metrics", O.with_base(
    f"SELECT state_tier, {O.r(f'avg(abs(y - p) / greatest(abs(y), {_EPS}))')} AS mape, {O.r('avg(abs(y - p))')} AS mae, "
    f"count(*) AS n, {O.r('CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END')} AS r2 "
    "FROM (SELECT state_tier, price AS y, zip_median_ppsqft * house_size AS p FROM prop) t "
    "WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY state_tier"))
def q_regression_metrics(spark, sf):
    """E-3: MAPE, MAE, R^2 of the comparable-sales estimate (zip median price
    per sqft x size) against the sold price, per tier."""
    df = P.prop_df(spark, sf).withColumn("p", F.col("zip_median_ppsqft") * F.col("house_size"))
    return P.rounded(M.regression_metrics(df, "price", "p", ["state_tier"]))


_SC = ("sc AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT CAST(unrealized_gain_pct AS DOUBLE) AS score, "
       "CASE WHEN motivated_seller = 1 THEN 1 ELSE 0 END AS pos, CASE WHEN motivated_seller = 1 THEN 0 ELSE 1 END AS neg "
       "FROM lead_labeled WHERE unrealized_gain_pct IS NOT NULL) GROUP BY score)")


@register("roc_auc", O.with_base(
    f"SELECT {O.r('CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cum_neg - neg + neg * 0.5)) / (sum(pos) * sum(neg)) END')} AS auc "
    "FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc) c",
    _SC))
def q_roc_auc(spark, sf):
    """E-4: AUC of the unrealized-gain score for the motivated-seller label."""
    return P.rounded(M.roc_auc(P.lead_labeled_df(spark, sf), "motivated_seller", "unrealized_gain_pct"))


@register("average_precision", O.with_base(
    f"SELECT {O.r('CASE WHEN sum(pos) > 0 THEN sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos) END')} AS average_precision "
    "FROM (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM sc "
    "WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c", _SC))
def q_average_precision(spark, sf):
    """E-5."""
    return P.rounded(M.average_precision(P.lead_labeled_df(spark, sf), "motivated_seller", "unrealized_gain_pct"))


@register("class_weight", O.with_base(
    f"SELECT {O.r('sum(CASE WHEN motivated_seller = 0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN motivated_seller = 1 THEN 1 ELSE 0 END), 1)')}"
    " AS pos_weight FROM lead_train", LEAD_TRAIN))
def q_class_weight(spark, sf):
    """G-7."""
    return P.rounded(M.class_weight(P.lead_labeled_df(spark, sf).na.drop(subset=["years_since_last_sale"]),
                                    "motivated_seller"))


@register("positive_rate", O.with_base(f"SELECT {O.r('avg(motivated_seller)')} AS pos_rate FROM lead_train",
                                       LEAD_TRAIN))
def q_positive_rate(spark, sf):
    """G-8."""
    return P.rounded(M.positive_rate(P.lead_labeled_df(spark, sf).na.drop(subset=["years_since_last_sale"]),
                                     "motivated_seller"))


_GATES = [("avm_mape", C.AVM_MAX_MAPE, "le"), ("lead_auc", C.LEAD_MIN_AUC, "ge"),
          ("forecast_mape", C.FORECAST_MAX_MAPE, "le")]


@register("quality_gate", O.with_base(
    f"SELECT g.metric, {O.r('m.value')} AS value, g.threshold, g.direction, CASE WHEN m.value IS NULL THEN NULL "
    "WHEN g.direction = 'le' THEN m.value <= g.threshold WHEN g.direction = 'ge' THEN m.value >= g.threshold END AS passed "
    "FROM (VALUES " + ", ".join(f"('{m}', {O.d(t)}, '{d}')" for m, t, d in _GATES) + ") g(metric, threshold, direction) "
    "LEFT JOIN (SELECT 'avm_mape' AS metric, avg(abs(price - zip_median_ppsqft * house_size) / greatest(abs(price), "
    f"{_EPS})) AS value FROM prop WHERE zip_median_ppsqft * house_size IS NOT NULL "
    "UNION ALL SELECT 'lead_auc' AS metric, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cum_neg - neg + "
    "neg * 0.5)) / (sum(pos) * sum(neg)) END FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND CURRENT ROW) AS cum_neg FROM sc) c) m ON g.metric = m.metric", _SC))
def q_quality_gate(spark, sf):
    """E-6: metrics against the fixed gates; a metric that was never computed
    (forecast MAPE) gives passed = null."""
    prop = P.prop_df(spark, sf).withColumn("p", F.col("zip_median_ppsqft") * F.col("house_size"))
    mape = M.regression_metrics(prop, "price", "p").select(F.lit("avm_mape").alias("metric"),
                                                           F.col("mape").alias("value"))
    auc = M.roc_auc(P.lead_labeled_df(spark, sf), "motivated_seller", "unrealized_gain_pct") \
        .select(F.lit("lead_auc").alias("metric"), F.col("auc").alias("value"))
    gates = spark.createDataFrame(_GATES, "metric string, threshold double, direction string")
    return P.rounded(M.quality_gate(mape.unionByName(auc), gates)
                     .select("metric", "value", "threshold", "direction", "passed"))


# ------------------------------------------------------ transforms and tiers
@register("log_transform", O.with_base(
    f"SELECT listing_id, {O.r('ln(1 + price)')} AS log_price, {O.r('exp(ln(1 + price)) - 1')} AS price_back FROM prop"))
def q_log_transform(spark, sf):
    """P-38: log1p of the price and expm1 back."""
    df = P.prop_df(spark, sf).withColumn("log_price", F.log1p("price"))
    return P.rounded(df.select("listing_id", "log_price", F.expm1("log_price").alias("price_back")))


@register("price_interval", O.with_base(
    f"SELECT a.listing_id, {O.r('z.zip_median_ppsqft * a.house_size')} AS estimate, "
    f"{O.r('z.zip_median_ppsqft * a.house_size * (1 - 0.1)')} AS low, "
    f"{O.r('z.zip_median_ppsqft * a.house_size * (1 + 0.1)')} AS high "
    "FROM active a LEFT JOIN zip_ctx z ON a.state = z.state AND a.zip_code = z.zip_code"))
def q_price_interval(spark, sf):
    """P-39: estimate with a +-10% band (comparable-sales estimate)."""
    from plotline.operators.features import join_context, zip_context
    s = P.silver_df(spark, sf)
    ctx = zip_context(P.market_df(spark, sf), {"zip_median_ppsqft": "median_price_per_sqft"})
    df = join_context(SV.active_listings(s), ctx).withColumn("estimate", F.col("zip_median_ppsqft") * F.col("house_size"))
    return P.rounded(df.select("listing_id", "estimate", (F.col("estimate") * (1 - C.INTERVAL_PCT)).alias("low"),
                               (F.col("estimate") * (1 + C.INTERVAL_PCT)).alias("high")))


@register("score_tier", O.with_base(
    f"SELECT listing_id, {O.r('s')} AS score, CASE WHEN s <= 0.35 THEN 'cool' WHEN s <= 0.65 THEN 'warm' "
    "WHEN s IS NOT NULL THEN 'hot' END AS lead_tier FROM (SELECT listing_id, least(greatest(coalesce("
    "unrealized_gain_pct, 0.0), 0.0), 1.0) AS s FROM lead) t"))
def q_score_tier(spark, sf):
    """P-40: right-closed tiers on a [0, 1] score."""
    s = F.least(F.greatest(F.coalesce(F.col("unrealized_gain_pct"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    df = P.lead_df(spark, sf).select("listing_id", s.alias("score"))
    return P.rounded(df.withColumn("lead_tier", X.score_tier("score")))

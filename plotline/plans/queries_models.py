"""Registered queries for the fitted models. A fitted value has no SQL twin; what holds exactly for any fit
(row sets, intervals, tiers, limits) is registered with one."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plotline import config as C
from plotline import oracle as O
from plotline.plans import common as P
from plotline.plans import models as MD
from plotline.plans.catalog import register
from plotline.plans.queries_prep import TRAIN_CTE, train_df
from plotline.session import scratch_path


def active_features(spark, sf):
    """Active listings with the same zip context and indicators as training rows."""
    from plotline.operators.features import property_features
    s = P.silver_df(spark, sf)
    return property_features(P.active_listings(s), P.market_df(spark, sf), feature_ts=False)


def batch(spark, sf, *stages):
    """The batch run over an input folder, carried on to the given stages: each stage runs once per application."""
    from plotline.plans.pipeline import Run
    run = Run(spark, scratch_path(spark, f"run/{P.sf_key(spark, sf)}"), C.ADAPTER_AS_OF, sf_dir=sf, run_id="run")
    run.run_all(only=stages)
    return run


def _model(spark, sf, name, kind):
    """A model of the batch run, loaded from where the run saved it; None when there was nothing to fit."""
    return batch(spark, sf, name).model(name, kind)


def valuation(spark, sf):
    return _model(spark, sf, "valuation", MD.Valuation)


def rent(spark, sf):
    return _model(spark, sf, "rent", MD.Rent)


def lead(spark, sf):
    return _model(spark, sf, "lead", MD.Lead)


def _nothing(spark, schema: str):
    """Fewer than the least training rows (P-15): no rows of the same schema."""
    return spark.createDataFrame([], schema)


_ADDRESS = ", ".join(f"{c} string" for c in C.ADDRESS_KEYS)
_VALUATION_SCHEMA = f"{_ADDRESS}, listing_id string, property_type string, price double, avm_estimate double, avm_low double, avm_high double"
_RENT_SCHEMA = f"{_ADDRESS}, listing_id string, property_type string, price double, est_monthly_rent double, est_annual_rent double"
_LEAD_SCHEMA = f"{_ADDRESS}, listing_id string, lead_score double, lead_tier string"

_PREP_NUMERIC = [c for c in C.AVM_NUMERIC if c not in C.AVM_LEAKY]


def _assembled_sql() -> str:
    def x(c):
        return f"coalesce(TRY_CAST(t.{c} AS DOUBLE), m.{c}, CAST(0.0 AS DOUBLE))"
    filled = ", ".join(f"{x(c)} AS {c}" for c in _PREP_NUMERIC)
    medians = ", ".join(f"median({c}) AS {c}" for c in _PREP_NUMERIC)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}" for c in _PREP_NUMERIC)
    codes = ", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in C.AVM_CATEGORICAL)
    flags = ", ".join(f"coalesce({c}, 0) AS {c}" for c in C.AVM_BINARY)
    ranks = " ".join(f"JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM filled)) v_{c} "
                     f"ON f.{c} = v_{c}.v" for c in C.AVM_CATEGORICAL)
    values = [f"(f.{c} - s.m_{c}) / s.s_{c}" for c in _PREP_NUMERIC] + [f"CAST(v_{c}.code AS DOUBLE)" for c in C.AVM_CATEGORICAL] \
        + [f"CAST(f.{c} AS DOUBLE)" for c in C.AVM_BINARY]
    return O.with_base(
        f"SELECT listing_id, CAST(i AS INTEGER) AS position, {O.r('vals[i + 1]')} AS value FROM (SELECT listing_id, vals, "
        f"unnest(range(0, {len(values)})) AS i FROM vectors)", TRAIN_CTE, f"med AS (SELECT {medians} FROM train)",
        f"filled AS (SELECT t.listing_id, {filled}, {codes}, {flags} FROM (SELECT * FROM train) t, med m)",
        f"stats AS (SELECT {stats} FROM filled)",
        f"vectors AS (SELECT f.listing_id, [{', '.join(values)}] AS vals FROM filled f {ranks}, stats s)")


@register("assemble_features", _assembled_sql())
def q_assemble_features(spark, sf):
    """M-5: numeric (median-filled, scaled), ordinal codes and binaries in one
    vector; its entries by position."""
    prep = MD.Prep(list(_PREP_NUMERIC), list(C.AVM_BINARY), list(C.AVM_CATEGORICAL))
    df = train_df(spark, sf)
    x = prep.fit(df).transform(df)
    return P.rounded(x.select("listing_id", F.posexplode(vector_to_array("features")).alias("position", "value")))


@register("valuation_fit", None)
def q_valuation_fit(spark, sf):
    """E-1 + E-3 + E-6: held-out-state metrics of the stacked valuation model and its gate."""
    m = valuation(spark, sf).metrics
    return spark.createDataFrame([(m["mape"], m["mae"], m["r2"], m["n"], m["gate"]["passed"])],
                                 "mape double, mae double, r2 double, n long, passed boolean")


@register("valuation_score", None)
def q_valuation_score(spark, sf):
    """E-2 / C-5: estimate and +-10% interval for every active listing."""
    return MD.valuation_scores(valuation(spark, sf), active_features(spark, sf))


@register("valuation", None)
def q_valuation(spark, sf):
    """C-5: the table that the batch run's valuation stage writes."""
    return batch(spark, sf, "valuation").read("avm_estimates").drop("scored_at")


_HELD = "price BETWEEN 10000 AND 50000000 AND quality_score >= 0.6 AND property_type <> 'LAND' AND state IN (" \
    + ", ".join(O.q(s) for s in C.AVM_TEST_STATES) + ")"


@register("valuation_bounds", O.with_base(
    f"SELECT listing_id, {O.r('price')} AS price, true AS positive, CAST(0.9 AS DOUBLE) AS low_ratio, CAST(1.1 AS DOUBLE) AS high_ratio, "
    f"(SELECT count(*) FROM prop WHERE {_HELD}) AS test_rows FROM active"))
def q_valuation_bounds(spark, sf):
    """E-2: what holds exactly for any fit: every active listing is scored once
    and positive, the interval is +-10%, the held-out states were the test."""
    df, n = q_valuation_score(spark, sf), valuation(spark, sf).metrics["n"]
    return P.rounded(df.select("listing_id", "price", (F.col("avm_estimate") > 0).alias("positive"),
                               (F.col("avm_low") / F.col("avm_estimate")).alias("low_ratio"),
                               (F.col("avm_high") / F.col("avm_estimate")).alias("high_ratio"), F.lit(n).cast("long").alias("test_rows")))


_LIMITS = {"valuation": (500, 0.05, 6), "rent": (500, 0.05, 5), "lead": (400, 0.05, 6)}


@register("hyper_params", O.with_base(" UNION ALL ".join(
    f"SELECT '{m}' AS model, {n} AS max_trees, {O.d(r)} AS rate, {d} AS depth, {1 if m != 'valuation' else 2} AS fits, true AS kept_within "
    f"FROM (SELECT count(*) AS n FROM prop) WHERE n > 0" for m, (n, r, d) in _LIMITS.items())))
def q_hyper_params(spark, sf):
    """E-11: the limits of the three fits; early stopping kept some number of
    trees within them (the numbers are in the models' metrics)."""
    rows = []
    for name, model in (("valuation", valuation(spark, sf)), ("rent", rent(spark, sf)), ("lead", lead(spark, sf))):
        if model is not None:
            m = model.metrics
            rows.append((name, m["limits"]["max_trees"], float(m["limits"]["rate"]), m["limits"]["depth"], len(m["trees"]),
                         all(1 <= t <= m["limits"]["max_trees"] for t in m["trees"])))
    return spark.createDataFrame(rows, "model string, max_trees int, rate double, depth int, fits int, kept_within boolean")


@register("rent_fit_score", None)
def q_rent_fit_score(spark, sf):
    """E-7 / C-7: rent model blended with the yield rent for every active listing."""
    r = rent(spark, sf)
    if r is None:
        return _nothing(spark, _RENT_SCHEMA)
    return r.predict(active_features(spark, sf)).select(*C.ADDRESS_KEYS, "listing_id", "property_type", "price",
                                                        "est_monthly_rent", "est_annual_rent")


@register("rent", None)
def q_rent(spark, sf):
    """C-7: the table that the batch run's rent stage writes."""
    run = batch(spark, sf, "rent")
    return run.read("rent_estimates").drop("scored_at") if rent(spark, sf) is not None else _nothing(spark, _RENT_SCHEMA)


@register("rent_bounds", O.with_base(
    f"SELECT a.listing_id, {O.r('a.price')} AS price, CAST(12 AS DOUBLE) AS months, true AS at_least_yield_share FROM active a"))
def q_rent_bounds(spark, sf):
    """E-7: what holds exactly for any fit: every active listing has one rent,
    a year is twelve months, and the blend is at least the yield's share."""
    df = q_rent_fit_score(spark, sf)
    from plotline.operators.invest import with_state_yield
    share = F.lit(C.RENT_YIELD_WEIGHT) * F.col("price") * F.col("gross_yield") / 12
    return P.rounded(with_state_yield(df).select(
        "listing_id", "price", (F.col("est_annual_rent") / F.col("est_monthly_rent")).alias("months"),
        (F.col("est_monthly_rent") >= share * (1 - 1e-12)).alias("at_least_yield_share")))


@register("lead_fit", None)
def q_lead_fit(spark, sf):
    """E-8 (+ E-4, E-5 on the test split, E-6 gate)."""
    schema = "auc double, average_precision double, pos_weight double, passed boolean"
    ld = lead(spark, sf)
    if ld is None:
        return _nothing(spark, schema)
    m = ld.metrics
    return spark.createDataFrame([(m["auc"], m["average_precision"], m["pos_weight"], m["gate"]["passed"])], schema)


@register("platt_calibrate", None)
def q_platt_calibrate(spark, sf):
    """E-9: calibrated probabilities next to the raw margin, of the same row."""
    ld = lead(spark, sf)
    if ld is None:
        return _nothing(spark, "listing_id string, margin double, lead_score double")
    rows = P.lead_labeled_df(spark, sf).na.drop(subset=["years_since_last_sale"])
    return ld.predict(rows).select("listing_id", "margin", "lead_score")


@register("lead_score", None)
def q_lead_score(spark, sf):
    """E-10 / C-8: every lead scored (scoring fill: zero, as in the notebook)."""
    ld = lead(spark, sf)
    if ld is None:
        return _nothing(spark, _LEAD_SCHEMA)
    return ld.predict(P.lead_df(spark, sf), fill="zero").select(*C.ADDRESS_KEYS, "listing_id", "lead_score",
                                                                "lead_tier")


@register("lead", None)
def q_lead(spark, sf):
    """C-8: the table that the batch run's lead stage writes."""
    run = batch(spark, sf, "lead")
    return run.read("lead_scores").drop("scored_at") if lead(spark, sf) is not None else _nothing(spark, _LEAD_SCHEMA)


@register("lead_bounds", O.with_base(
    "SELECT listing_id, street, true AS in_range, true AS tier_fits FROM lead"))
def q_lead_bounds(spark, sf):
    """E-10: what holds exactly for any fit: every lead has one score in [0, 1]
    and the tier that its score asks for."""
    df = q_lead_score(spark, sf)
    s = F.col("lead_score")
    want = F.when(s <= C.LEAD_COOL_MAX, "cool").when(s <= C.LEAD_WARM_MAX, "warm").otherwise("hot")
    return df.select("listing_id", "street", s.between(0, 1).alias("in_range"), (want == F.col("lead_tier")).alias("tier_fits"))


@register("valuation_investment", None)
def q_valuation_investment(spark, sf):
    """C-9 on model output: the table that the batch run's investment stage writes."""
    return batch(spark, sf, "investment").read("investment_scores")


# ------------------------------------------------------------ exact checks
_TOLERANCE = 1e-9  # relative; the two ways add up the trees in another order


def _agree(a: str, b: str):
    return F.abs(F.col(a) - F.col(b)) <= F.lit(_TOLERANCE) * F.greatest(F.abs(F.col(a)), F.abs(F.col(b)), F.lit(1e-300))


def _numbered(df):
    """Rows with a number that stays: listing ids may repeat."""
    from plotline.session import written
    return written(df.withColumn("row_no", F.monotonically_increasing_id()), "numbered")


@register("valuation_walk", O.with_base(f"SELECT listing_id, {O.r('price')} AS price, true AS agrees FROM active"))
def q_valuation_walk(spark, sf):
    """E-2 / C-5 checked exactly: for every active listing the ensembles walked as node tables give the model's estimate."""
    from plotline.plans.walk import walked_valuation
    rows, model = _numbered(active_features(spark, sf)), valuation(spark, sf)
    walked = walked_valuation(model, rows, ["row_no", "listing_id", "price"])
    return P.rounded(walked.join(model.predict(rows).select("row_no", "avm_estimate"), "row_no")
                     .select("listing_id", "price", _agree("estimate", "avm_estimate").alias("agrees")))


@register("rent_walk", O.with_base(
    f"SELECT listing_id, {O.r('price')} AS price, true AS agrees FROM active, (SELECT count(*) AS n FROM prop) WHERE n > 0"))
def q_rent_walk(spark, sf):
    """E-7 / C-7 checked exactly: the walked ensemble, blended with the yield, gives every active listing's rent."""
    from plotline.operators.invest import with_state_yield
    from plotline.plans.walk import walked_rent
    model = rent(spark, sf)
    if model is None:
        return _nothing(spark, "listing_id string, price double, agrees boolean")
    rows = _numbered(with_state_yield(active_features(spark, sf)))
    walked = walked_rent(model, rows, ["row_no", "listing_id"])
    found = model.predict(rows).select("row_no", "price", "est_monthly_rent")
    return P.rounded(walked.join(found, "row_no").select("listing_id", "price", _agree("monthly", "est_monthly_rent").alias("agrees")))


@register("lead_walk", O.with_base("SELECT listing_id, street, true AS agrees FROM lead"))
def q_lead_walk(spark, sf):
    """E-8 to E-10 / C-8 checked exactly: the walked ensemble and the calibrator's formula give every lead's score."""
    from plotline.plans.walk import walked_lead
    model = lead(spark, sf)
    if model is None:
        return _nothing(spark, "listing_id string, street string, agrees boolean")
    rows = _numbered(P.lead_df(spark, sf))
    walked = walked_lead(model, rows, ["row_no", "listing_id", "street"])
    return walked.join(model.predict(rows, fill="zero").select("row_no", "lead_score"), "row_no") \
        .select("listing_id", "street", _agree("score", "lead_score").alias("agrees"))


_RESIDUAL = 1e-6  # a gradient, relative to the sum of its absolute terms


@register("ridge_certificate", "SELECT * FROM (VALUES ('b0', true), ('b1', true), ('intercept', true)) t(equation, holds)")
def q_ridge_certificate(spark, sf):
    """E-1: the stacking ridge satisfies its normal equations on the out-of-fold predictions."""
    from plotline.plans.walk import ridge_gradient
    return ridge_gradient(valuation(spark, sf)).select("equation", (F.col("residual") <= _RESIDUAL).alias("holds"))


@register("platt_certificate", "SELECT * FROM (VALUES ('slope', true), ('intercept', true)) t(equation, holds)")
def q_platt_certificate(spark, sf):
    """E-9: the calibrator's log loss has no gradient at its coefficients."""
    from plotline.plans.walk import platt_gradient
    model = lead(spark, sf)
    if model is None:
        return _nothing(spark, "equation string, holds boolean")
    return platt_gradient(model).select("equation", (F.col("residual") <= _RESIDUAL).alias("holds"))

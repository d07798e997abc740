"""Hand-computed edge cases (FIXTURES.md §4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plotline.functions import columns as X
from plotline.operators import features as FE
from plotline.operators import forecast as FC


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("bed,size,acre,expected", [
    (3.0, None, 6.0, "RURAL_RESIDENTIAL"),   # null size falls through the condo test
    (None, None, None, "LAND"),
    (5.0, 900.0, None, "MULTI_FAMILY"),      # multi-family before condo
    (2.0, 900.0, 0.04, "CONDO"),
    (2.0, 900.0, 0.05, "SFR"),
])
def test_property_type(spark, bed, size, acre, expected):
    schema = "bed double, house_size double, acre_lot double"
    assert one(spark, X.property_type(), schema, (bed, size, acre)) == expected


def test_sqft_bucket_edges(spark):
    df = spark.createDataFrame([(v,) for v in [799.0, 800.0, 1399.0, 1400.0, 2200.0, 3500.0, None]], "house_size double")
    got = [r[0] for r in df.select(X.sqft_bucket()).collect()]
    assert got == ["micro", "small", "small", "medium", "large", "xlarge", None]


def test_hold_buckets_batch_overlap(spark):
    df = spark.createDataFrame([(5.0,), (None,)], "years_since_last_sale double")
    r = df.select(*[c.alias(k) for k, c in FE.hold_buckets().items()]).collect()
    assert r[0]["hold_2_5"] == 1 and r[0]["hold_5_10"] == 1
    assert r[1]["hold_2_5"] is None  # null comparison stays null


def test_hold_buckets_request(spark):
    df = spark.createDataFrame([("5.0",), ("10",), ("",), (None,)], "y string")
    r = df.select(*[c.alias(k) for k, c in FE.hold_buckets_request(F.col("y")).items()]).collect()
    assert (r[0]["hold_5_10"], r[0]["hold_2_5"], r[0]["hold_10_plus"]) == (1, 0, 0)
    assert (r[1]["hold_10_plus"], r[1]["long_hold"], r[1]["hold_5_10"]) == (1, 1, 0)
    assert r[2]["hold_0_2"] == 1 and r[3]["hold_0_2"] == 1


def test_score_tier_edges(spark):
    df = spark.createDataFrame([(0.35,), (0.65,), (0.6500001,)], "s double")
    assert [r[0] for r in df.select(X.score_tier("s")).collect()] == ["cool", "warm", "hot"]


def test_zip_and_date(spark):
    df = spark.createDataFrame([("601.0", "2023-02-30"), ("123456", "3019-04-02"), ("90210", "1999-12-31")],
                               "z string, d string")
    r = df.select(X.clean_zip("z").alias("z"), X.parse_sale_date("d", dt.date(2002, 1, 1)).alias("d")).collect()
    assert [x["z"] for x in r] == ["00601", "12345", "90210"]
    assert [x["d"] for x in r] == [None, None, dt.date(1999, 12, 31)]


def test_quality_and_address(spark):
    df = spark.createDataFrame([(1.0, None, None, 1.0, None, "x", "a", None, "c")],
                               "price double, bed double, bath double, house_size double, city string, "
                               "zip_code string, street string, c2 string, state string")
    r = df.select(X.quality_score().alias("q"),
                  X.address_key_skip_null("street", "c2", "state").alias("a"),
                  X.address_key_keep_null("street", "c2", "state").alias("b")).first()
    assert r["q"] == 0.5 and r["a"] == "a|c" and r["b"] == "a||c"


def test_payment_zero_rate(spark):
    v = one(spark, X.monthly_payment(F.col("l"), F.lit(0.0), F.lit(30.0)), "l double", (75_000.0,))
    assert math.isclose(v, 75_000 / 360)


def test_irr_npv(spark):
    df = spark.createDataFrame([([-100.0, 10.0, 10.0, 110.0],), ([-100.0, -1.0, -1.0],)], "c array<double>")
    r = df.select(X.irr(F.col("c")).alias("irr"), X.npv(F.col("c"), F.lit(0.0)).alias("npv")).collect()
    assert math.isclose(r[0]["irr"], 0.10, abs_tol=1e-9)
    assert math.isclose(r[0]["npv"], 30.0)
    assert r[1]["irr"] is None  # no sign change: no root


def test_forecast_rates_and_months(spark):
    base = spark.createDataFrame([("A", "SFR", "coastal_premium", 100.0, 5),
                                  ("B", "SFR", "sun_belt", 100.0, 5),
                                  ("C", "SFR", "nowhere", 100.0, 5)],
                                 "state string, property_type string, state_tier string, median_price double, count long")
    rates = {r["state"]: r["annual_rate"] for r in FC.forecast_baseline(base).collect()}
    assert rates == {"A": 0.038, "B": 0.060, "C": 0.038}
    path = FC.forecast_path(FC.forecast_baseline(base).filter("state = 'B'"), 2, dt.date(2024, 11, 17)).collect()
    assert [r["forecast_month"] for r in path] == [dt.date(2024, 12, 1), dt.date(2025, 1, 1)]
    assert math.isclose(path[1]["forecast_price"], 100 * 1.06 ** (2 / 12))


def test_irr_matches_polynomial_roots(spark):
    """IRR by bisection equals the unique real root in the bracket found
    from the polynomial (numpy), and is null when the bracket has no sign change."""
    import numpy as np
    rng = np.random.default_rng(5)
    flows = []
    for _ in range(300):
        c = [-float(rng.uniform(50, 150))] + list(rng.uniform(-20, 60, size=5))
        c[-1] += float(rng.uniform(-50, 200))
        flows.append([float(x) for x in c])
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flows)], "i int, c array<double>")
    got = {r["i"]: r["irr"] for r in df.select("i", X.irr(F.col("c")).alias("irr")).collect()}

    def npv(c, r):
        return sum(x / (1 + r) ** t for t, x in enumerate(c))

    checked = 0
    for i, c in enumerate(flows):
        roots = np.roots(c[::-1])
        rates = sorted(1 / z.real - 1 for z in roots if abs(z.imag) < 1e-12 and z.real > 0)
        inside = [r for r in rates if -1 + 1e-9 < r < 1e6]
        sign_change = npv(c, -1 + 1e-9) * npv(c, 1e6) < 0
        if not sign_change:
            assert got[i] is None
        elif len(inside) == 1:
            assert abs(got[i] - inside[0]) < 1e-9
            checked += 1
    assert checked > 100


def test_irr_far_below_zero(spark):
    """A deal that loses nearly everything still has its rate (no floor at -99 %)."""
    df = spark.createDataFrame([([-100.0, 0.0, 0.0, 1e-9],)], "c array<double>")
    got = df.select(X.irr(F.col("c"), n=4).alias("a"), X.irr(F.col("c")).alias("b")).first()
    want = (1e-9 / 100) ** (1 / 3) - 1
    assert abs(got["a"] - want) < 1e-8 and abs(got["b"] - want) < 1e-8


def test_forecast_without_months_below_one(spark):
    base = spark.createDataFrame([("B", "SFR", "sun_belt", 100.0, 5)],
                                 "state string, property_type string, state_tier string, median_price double, count long")
    seg = FC.forecast_baseline(base)
    for h, n in ((0, 0), (-2, 0), (1, 1)):
        assert FC.forecast_path(seg, h, dt.date(2024, 1, 1)).count() == n


def test_a_sale_after_the_old_fixture_date_is_kept(spark):
    from plotline.operators.clean import bronze
    from plotline.sources.listings import LISTING_SCHEMA
    row = ("b", "sold", 1.0, 2.0, 1.0, 0.1, "s", "c", "Texas", "1", 900.0, "2024-03-01")
    raw = spark.createDataFrame([row, row], LISTING_SCHEMA)
    got = bronze(raw, dt.date(2024, 6, 1), source_file="x").collect()
    assert [r["prev_sold_date"] for r in got] == [dt.date(2024, 3, 1)] * 2
    assert got[0]["listing_id"] == got[1]["listing_id"]  # equal raw rows share an id


def test_irr_of_null_and_short_flows(spark):
    from plotline.functions import columns as X
    df = spark.createDataFrame([(0, [-100.0, 110.0]), (1, None), (2, [-100.0, None]), (3, []), (4, [-100.0, 0.0, 121.0])],
                               "i int, c array<double>")
    got = {r.i: r.irr for r in df.select("i", X.irr(F.col("c")).alias("irr")).collect()}
    assert abs(got[0] - 0.1) < 1e-9 and abs(got[4] - 0.1) < 1e-9
    assert got[1] is None and got[2] is None and got[3] is None


def test_irr_and_draws_are_solved_by_batches(spark):
    import __spark_entry__ as E
    for key in ("irr", "investment_monte_carlo"):
        p = E.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert p.count("ArrowEvalPython") == 1 and "lambdafunction" not in p.split("ArrowEvalPython")[0]

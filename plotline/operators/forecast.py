"""Segment price projection: baseline medians grown at a tier rate."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline import config as C
from plotline.functions.dims import forecast_rate_dim, join_literal_dim

BASELINE_KEYS = ["state", "property_type", "state_tier"]


def baseline_medians(active: DataFrame, min_count: int = C.FORECAST_MIN_GROUP) -> DataFrame:
    """G-4 + P-11 + P-14: exact (interpolated) median price per segment with at
    least ``min_count`` priced listings.

    The median is taken over (price, count) rows per segment, so equal
    prices are one row."""
    from plotline.functions.running import group_medians
    med = group_medians(active.na.drop(subset=["price", "property_type", "state"]), BASELINE_KEYS, "price")
    return (med.select(*BASELINE_KEYS, F.col("median").alias("median_price"), F.col("n").alias("count"))
            .filter(F.col("count") >= min_count))


def forecast_baseline(baseline: DataFrame, rates: dict | None = None,
                      default_rate: float = C.FORECAST_DEFAULT_RATE) -> DataFrame:
    """F-1: the yearly rate per segment from its tier (literal dim, broadcast);
    unknown tiers get ``default_rate``. With the default keys, coastal_premium
    falls back to the default, as in the notebook."""
    df = join_literal_dim(baseline, forecast_rate_dim(baseline.sparkSession, rates), "state_tier", "left")
    return df.withColumn("annual_rate", F.coalesce(F.col("annual_rate"), F.lit(default_rate)))


def forecast_path(seg: DataFrame, horizon: int | str, as_of: _dt.date,
                  pct: float = C.INTERVAL_PCT, keep: tuple[str, ...] = ()) -> DataFrame:
    """F-2: one row per segment and month k = 1..horizon.

    ``horizon`` is a constant or the name of a per-row column. Month k is the
    first day of the as_of month plus k months; the price grows at the
    monthly rate (1 + r)^(1/12) - 1 compounded k times, with a +-pct band.
    A horizon below 1 (or null) gives no month, and neither does a row's horizon
    above ``FORECAST_MAX_HORIZON``, which would become that many rows in one
    task (``requests.route`` answers such a request with an error)."""
    if isinstance(horizon, int):
        if horizon > C.FORECAST_MAX_HORIZON:
            raise ValueError(f"horizon must be at most {C.FORECAST_MAX_HORIZON} months")
        h = F.lit(horizon)
    else:
        h = F.col(horizon).try_cast("int")
    df = seg.filter(h.between(1, C.FORECAST_MAX_HORIZON)).withColumn("k", F.explode(F.sequence(F.lit(1), h)))
    monthly = F.pow(1 + F.col("annual_rate"), F.lit(1.0 / 12)) - 1
    price = F.col("median_price") * F.pow(1 + monthly, F.col("k"))
    return df.select(
        F.add_months(F.trunc(F.lit(as_of), "MM"), F.col("k")).alias("forecast_month"),
        price.alias("forecast_price"),
        (price * (1 - pct)).alias("forecast_price_low"),
        (price * (1 + pct)).alias("forecast_price_high"),
        "state", "property_type",
        F.col("median_price").alias("last_actual"),
        *keep,
    )


def price_forecasts(active: DataFrame, as_of: _dt.date, horizon: int = C.FORECAST_HORIZON, rates: dict | None = None) -> DataFrame:
    """F-3: every segment with >= 3 listings projected ``horizon`` months."""
    return forecast_path(forecast_baseline(baseline_medians(active), rates), horizon, as_of)


def forecast_requests(requests: DataFrame, baseline: DataFrame, as_of: _dt.date) -> DataFrame:
    """Forecast for (state, property_type, horizon) request rows; unknown
    segments give no rows (inner join), horizon defaults to 12."""
    seg = forecast_baseline(baseline).drop("state_tier", "count")
    req = requests.withColumn("horizon", F.coalesce(F.col("horizon").try_cast("int"), F.lit(C.FORECAST_HORIZON)))
    keep = tuple(c for c in requests.columns if c not in ("state", "property_type", "horizon"))
    return forecast_path(req.join(seg, ["state", "property_type"], "inner"), "horizon", as_of, keep=keep)

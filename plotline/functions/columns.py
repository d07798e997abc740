"""Column-expression building blocks: JVM-side, but for ``irr``, a bisection on whole Arrow batches."""

from __future__ import annotations

import datetime as _dt
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline import config as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 indicator; a null comparison stays null (three-valued logic)."""
    return cond.cast("int")


def guarded_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den when den > 0, else null (never divides by zero under ANSI)."""
    return F.when(col(den) > 0, col(num) / col(den)).cast("double")


def round_half_up_ratio(num: str | Column, den: str | Column, scale: int = 4) -> Column:
    """round(num / den, scale) for non-negative integers, exact (no binary
    rounding): floor((2 * num * 10^s + den) / (2 * den)) / 10^s."""
    p = 10 ** scale
    n, d = col(num).cast("long"), col(den).cast("long")
    return (F.floor((n * (2 * p) + d) / (d * 2)) / F.lit(float(p))).cast("double")


# ----------------------------------------------------------------- cleaning
def clean_lower(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def clean_title(c: str | Column) -> Column:
    return F.initcap(F.trim(col(c)))


def clean_zip(c: str | Column) -> Column:
    """Strip a trailing '.0', left-pad with zeros to 5 (longer input is cut to 5)."""
    return F.lpad(F.regexp_replace(col(c), r"\.0$", ""), 5, "0")


def parse_sale_date(c: str | Column, as_of: _dt.date, earliest: str = C.EARLIEST_SALE_DATE) -> Column:
    """yyyy-MM-dd to date; unparsable or outside [earliest, as_of] becomes null."""
    d = F.try_to_date(col(c), "yyyy-MM-dd")
    return F.when(d.between(F.lit(earliest).cast("date"), F.lit(as_of)), d).otherwise(F.lit(None).cast("date"))


# ----------------------------------------------------------- classification
def property_type(house_size: str = "house_size", bed: str = "bed", acre_lot: str = "acre_lot") -> Column:
    hs, bd, ac = col(house_size), col(bed), col(acre_lot)
    return (F.when(hs.isNull() & bd.isNull(), "LAND")
            .when(bd >= 5, "MULTI_FAMILY")
            .when((hs < 1200) & (ac.isNull() | (ac < 0.05)), "CONDO")
            .when(ac >= 5, "RURAL_RESIDENTIAL")
            .otherwise("SFR"))


def sqft_bucket(house_size: str = "house_size") -> Column:
    hs = col(house_size)
    return (F.when(hs < 800, "micro")
            .when(hs < 1400, "small")
            .when(hs < 2200, "medium")
            .when(hs < 3500, "large")
            .when(hs.isNotNull(), "xlarge")
            .otherwise(F.lit(None).cast("string")))


def price_tier(price: str = "price") -> Column:
    p = col(price)
    return (F.when(p < 150_000, "entry")
            .when(p < 350_000, "mid")
            .when(p < 700_000, "upper_mid")
            .when(p < 1_500_000, "luxury")
            .otherwise("ultra_luxury"))


def quality_score(fields: Iterable[str] = ("price", "bed", "bath", "house_size", "city", "zip_code")) -> Column:
    fields = list(fields)
    total = None
    for f in fields:
        term = F.col(f).isNotNull().cast("int")
        total = term if total is None else total + term
    return total / F.lit(float(len(fields)))


def years_since(date_col: str | Column, as_of: _dt.date) -> Column:
    d = col(date_col)
    return F.when(d.isNotNull(), F.round(F.datediff(F.lit(as_of), d) / F.lit(C.DAYS_PER_YEAR), 2)).cast("double")


def score_tier(score: str | Column, cool_max: float = C.LEAD_COOL_MAX, warm_max: float = C.LEAD_WARM_MAX) -> Column:
    """Right-closed bins: (-inf, cool_max] cool, (cool_max, warm_max] warm, else hot."""
    s = col(score)
    return (F.when(s <= cool_max, "cool").when(s <= warm_max, "warm")
            .when(s.isNotNull(), "hot"))


def address_key_skip_null(*cols: str) -> Column:
    """'|'-joined, null parts skipped (concat_ws)."""
    return F.concat_ws("|", *[F.col(c) for c in cols])


def address_key_keep_null(*cols: str) -> Column:
    """'|'-joined, null parts kept as empty slots."""
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


# -------------------------------------------------------------- finance maths
def monthly_payment(loan: Column, annual_rate: Column, term_years: Column) -> Column:
    r = annual_rate / 12
    n = term_years * 12
    g = F.pow(1 + r, n)
    return F.when(r == 0, loan / n).otherwise(loan * (r * g) / (g - 1))


def loan_balance(loan: Column, annual_rate: Column, term_years: Column, years: Column) -> Column:
    r = annual_rate / 12
    n = term_years * 12
    k = years * 12
    return F.when(r == 0, loan * (1 - k / n)).otherwise(
        loan * (F.pow(1 + r, n) - F.pow(1 + r, k)) / (F.pow(1 + r, n) - 1))


def npv(cfs: Column, rate: Column) -> Column:
    """sum_t cfs[t] / (1+rate)^t, t from 0, folded left to right (no
    intermediate array)."""
    return F.aggregate(F.sequence(F.lit(0), F.size(cfs) - 1), F.lit(0.0),
                       lambda a, t: a + F.element_at(cfs, t + 1) / F.pow(1 + rate, t))


IRR_LOW = -1 + 1e-9
IRR_HIGH = 1e6
IRR_STEPS = 60


def npv_fixed(cfs: Column, rate: Column, n: int) -> Column:
    """``npv`` for arrays of a known length n, unrolled into one expression
    (same left-to-right sum, no lambda per element)."""
    total = F.lit(0.0)
    for t in range(n):
        total = total + F.element_at(cfs, t + 1) / F.pow(1 + rate, F.lit(t))
    return total


def _flow_matrix(flows: pa.Array, n: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The flows as (times, rows), shorter rows ending in zeros, and which rows have a null (themselves or in a flow)."""
    if pa.types.is_large_list(flows.type):
        flows = flows.cast(pa.list_(flows.type.value_type))
    sizes = flows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flows.flatten().cast(pa.float64())
    row = np.repeat(np.arange(len(flows)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((max(int(sizes.max(initial=0)), n or 0), len(flows)))
    out[at, row] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    null = flows.is_null().to_numpy(zero_copy_only=False).copy()
    if n is not None:
        null |= sizes < n
        out = out[:n]
    used = at < len(out)
    null[row[used & values.is_null().to_numpy(zero_copy_only=False)]] = True
    return out, null


def bisect_irr(flows: np.ndarray, low: float = IRR_LOW, high: float = IRR_HIGH, steps: int = IRR_STEPS) -> np.ndarray:
    """The rates at which the NPV of (times, rows) flows is zero, NaN where the ends of the bracket have the same sign.

    The NPV is nested in 1 / (1 + rate), last flow first: no powers. ``at`` is the lower end of the bracket; at step k
    the midpoint is at + width / 2^k.
    """
    def sign(rate) -> np.ndarray:
        q = 1.0 / (1.0 + rate)
        total = np.zeros(flows.shape[1])
        for flow in flows[::-1]:
            total = total * q + flow
        return np.sign(total)

    width = high - low
    s_low, s_high = sign(low), sign(high)
    at = np.full(flows.shape[1], low)
    for k in range(1, steps + 1):
        mid = at + width / 2.0 ** k
        at = np.where(sign(mid) == s_low, mid, at)
    return np.where(s_low * s_high < 0, at + width / 2 ** (steps + 1), np.nan)


def irr(cfs: Column, low: float = IRR_LOW, high: float = IRR_HIGH, steps: int = IRR_STEPS,
        n: int | None = None) -> Column:
    """Internal rate of return by bisection on [low, high], a batch of rows at a time.

    null when the ends of the bracket have the same sign or a flow is null. With ``n`` only the first n flows count.
    """
    @F.arrow_udf("double")
    def solve(flows: pa.Array) -> pa.Array:
        matrix, null = _flow_matrix(flows, n)
        with np.errstate(all="ignore"):
            found = bisect_irr(matrix, low, high, steps)
        return pa.array(found, mask=null | np.isnan(found))
    return solve(cfs)


def exact_avg(c: str | Column, scale: int = 4) -> Column:
    """Average summed as an exact decimal: the result does not depend on the
    order rows arrive in (partitioning), unlike a floating-point sum. For
    inputs carrying at most ``scale`` decimals (and ten digits before them, so
    a value fits a long) it is exact up to one division."""
    v = col(c)
    return F.try_divide(F.sum(v.cast(f"decimal(14,{scale})")).cast("double"), F.count(v))

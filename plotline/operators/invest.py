"""Per-property investment measures as column expressions; scenario draws on whole Arrow batches."""

from __future__ import annotations

import math
import sys
from dataclasses import asdict
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline import config as C
from plotline.config import Financing, Hold, Operating
from plotline.functions import columns as X
from plotline.functions.dims import join_literal_dim, tier_assumption_dim

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package

SUMMARY_COLUMNS = ["purchase_price", "total_cash_in", "monthly_payment", "monthly_rent", "gross_yield",
                   "cap_rate", "cash_on_cash_yr1", "dscr_yr1", "noi_yr1", "cash_flow_yr1", "exit_value",
                   "irr", "npv", "hold_years"]


def _lit(v) -> Column:
    return F.lit(float(v))


def loan_terms(price: Column, fin: Financing) -> dict[str, Column]:
    """F-4 / F-5."""
    loan = price * (1 - _lit(fin.down_payment_pct))
    return {
        "loan_amount": loan,
        "monthly_payment": X.monthly_payment(loan, _lit(fin.interest_rate), _lit(fin.loan_term_years)),
        "total_cash_in": price * (_lit(fin.down_payment_pct) + _lit(fin.closing_cost_pct)),
    }


def annual_opex(rent: Column, price: Column, ops: Operating) -> Column:
    """F-6: fees and capex on effective year-1 rent, price-based rates, hoa."""
    eff = rent * (1 - F.col("vacancy_rate")) * 12
    return (eff * (F.col("mgmt_fee_pct") + _lit(ops.capex_pct))
            + price * (F.col("tax_rate") + F.col("insurance_rate") + F.col("maintenance_pct"))
            + _lit(ops.hoa_monthly) * 12)


def noi(year: Column, hold: Hold) -> Column:
    """F-7: rent grown (year-1) times, less the (year-1) opex."""
    rent = F.col("monthly_rent") * F.pow(1 + _lit(hold.annual_rg), year - 1)
    return rent * 12 * (1 - F.col("vacancy_rate")) - F.col("annual_opex")


def cash_flow(year: Column, hold: Hold) -> Column:
    """F-8."""
    return noi(year, hold) - F.col("monthly_payment") * 12


def investment_summary(df: DataFrame, price: str = "price", rent: str = "rent",
                       fin: Financing = Financing(), ops: Operating = Operating(),
                       hold: Hold = Hold(), per_tier: bool = True) -> DataFrame:
    """F-4..F-14 for every row of ``df``.

    ``df`` needs the price and monthly rent columns and, with ``per_tier``,
    the seven tier assumption columns (vacancy, tax, insurance, mgmt,
    maintenance, annual_pg, exit_cap_rate); otherwise those come from ``hold``
    and the 'other' tier.
    """
    if not per_tier:
        t = dict(zip(C.TIER_ASSUMPTION_COLUMNS, C.TIER_ASSUMPTIONS[C.DEFAULT_TIER]))
        t["annual_pg"], t["exit_cap_rate"] = hold.annual_pg, hold.exit_cap_rate
        df = df.withColumns({k: _lit(v) for k, v in t.items()})
    H = hold.hold_years
    p = F.col("purchase_price")
    df = df.withColumns({"purchase_price": F.col(price).cast("double"), "monthly_rent": F.col(rent).cast("double")})
    df = df.withColumns(loan_terms(p, fin))
    df = df.withColumn("annual_opex", annual_opex(F.col("monthly_rent"), p, ops))
    df = df.withColumns({
        "noi_yr1": noi(F.lit(1), hold),
        "noi_exit": noi(F.lit(H), hold),
        "balance_exit": X.loan_balance(F.col("loan_amount"), _lit(fin.interest_rate), _lit(fin.loan_term_years),
                                       F.lit(H)),
    })
    df = df.withColumns({
        "cash_flow_yr1": F.col("noi_yr1") - F.col("monthly_payment") * 12,
        "exit_value": (p * F.pow(1 + F.col("annual_pg"), F.lit(H)) + F.col("noi_exit") / F.col("exit_cap_rate")) / 2,
    })
    last = F.col("exit_value") * (1 - _lit(hold.selling_cost_pct)) - F.col("balance_exit")
    cfs = F.transform(F.sequence(F.lit(0), F.lit(H)),
                      lambda t: F.when(t == 0, -F.col("total_cash_in"))
                      .otherwise(cash_flow(t, hold) + F.when(t == H, last).otherwise(F.lit(0.0))))
    df = df.withColumn("cash_flows", cfs)
    df = df.withColumns({
        "gross_yield": F.col("monthly_rent") * 12 / p,
        "cap_rate": F.col("noi_yr1") / p,
        "cash_on_cash_yr1": X.guarded_ratio("cash_flow_yr1", "total_cash_in"),
        "dscr_yr1": F.when(F.col("monthly_payment") > 0, F.col("noi_yr1") / (F.col("monthly_payment") * 12)),
        "irr": X.irr(F.col("cash_flows"), n=H + 1),
        "npv": X.npv_fixed(F.col("cash_flows"), _lit(hold.discount_rate), H + 1),
        "hold_years": F.lit(H).cast("long"),
    })
    return df


def rent_fallback(est_rent: str = "est_monthly_rent", price: str = "price", gross_yield: str = "gross_yield") -> Column:
    """F-17: the estimated rent when positive, else price x yield / 12."""
    e = F.col(est_rent)
    return F.when(e.isNotNull() & (e > 0), e).otherwise(F.col(price) * F.col(gross_yield) / 12)


def with_rents(est: DataFrame, rents: DataFrame | None, est_rent: str = "est_monthly_rent",
               keys: tuple[str, ...] = tuple(C.ADDRESS_KEYS)) -> DataFrame:
    """J-7: the median rent of the address (or of other ``keys``; with listing_id a listing's own rent) in ``rents``; a
    null rent without such a table. The median is ``percentile_approx``: an actual rent of the address, and the lower
    middle one of an even number of rents, as long as an address has fewer than 10,000 of them."""
    from plotline.functions.joins import left_join_null_safe, one_per_key
    if rents is None:
        return est.withColumn(est_rent, F.lit(None).cast("double"))
    return left_join_null_safe(est, one_per_key(rents, keys, {est_rent: F.percentile_approx(est_rent, 0.5)}), keys)


def with_rent_table(est: DataFrame, path: str, est_rent: str = "est_monthly_rent",
                    keys: tuple[str, ...] = tuple(C.ADDRESS_KEYS)) -> DataFrame:
    """S-10 + J-7: ``with_rents`` over the Parquet table at ``path``, if there is one."""
    from plotline.operators.quality import _exists
    spark = est.sparkSession
    return with_rents(est, spark.read.parquet(path) if _exists(spark, path) else None, est_rent, keys)


def with_state_yield(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """J-10: state -> gross yield through the literal dim, default applied."""
    from plotline.functions.dims import yield_dim
    out = join_literal_dim(df, yield_dim(df.sparkSession, mapping), "state", "left")
    return out.withColumn("gross_yield", F.coalesce(F.col("gross_yield"), F.lit(C.DEFAULT_GROSS_YIELD)))


def with_tier_assumptions(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """J-10: tier -> assumptions (literal 4-row dim, broadcast); unknown tiers
    take the 'other' row."""
    df = df.withColumn("state_tier", F.coalesce(F.col("state_tier"), F.lit(C.DEFAULT_TIER)))
    dim = tier_assumption_dim(df.sparkSession, mapping)
    known = list((mapping or C.TIER_ASSUMPTIONS).keys())
    keyed = df.withColumn("_tier_key", F.when(F.col("state_tier").isin(*known), F.col("state_tier"))
                          .otherwise(F.lit(C.DEFAULT_TIER)))
    return join_literal_dim(keyed, dim.withColumnRenamed("state_tier", "_tier_key"), "_tier_key", "left") \
        .drop("_tier_key")


def investment_frame(est: DataFrame, estimate: str = "avm_estimate", est_rent: str = "est_monthly_rent",
                     fin: Financing = Financing(), ops: Operating = Operating(), hold: Hold = Hold()) -> DataFrame:
    """F-15 with every intermediate column kept (loan, opex, NOI, flows...)."""
    df = est if est_rent in est.columns else est.withColumn(est_rent, F.lit(None).cast("double"))
    df = with_state_yield(df)
    df = df.withColumn("price_", F.col(estimate).try_cast("double"))
    df = df.withColumn("rent_", rent_fallback(est_rent, "price_", "gross_yield"))
    df = df.filter((F.col("price_") > 0) & (F.col("rent_") > 0))
    df = with_tier_assumptions(df).withColumnRenamed("gross_yield", "state_gross_yield")
    return investment_summary(df, "price_", "rent_", fin, ops, hold)


def investment_scores(est: DataFrame, estimate: str = "avm_estimate", est_rent: str = "est_monthly_rent",
                      fin: Financing = Financing(), ops: Operating = Operating(), hold: Hold = Hold(),
                      keep: tuple[str, ...] = tuple(C.ADDRESS_KEYS)) -> DataFrame:
    """F-15: estimate rows (with state, state_tier and optionally a rent
    estimate) -> one row of investment measures per listing.

    price := the estimate; rent := the rent estimate when positive, else the
    yield rent; rows without a positive price and rent are dropped; tier
    assumptions come from the row's tier ('other' when missing).
    """
    df = investment_frame(est, estimate, est_rent, fin, ops, hold)
    return df.select(*SUMMARY_COLUMNS, *keep, F.col("price_").alias("avm_estimate"),
                     F.col("rent_").alias("est_rent"), "state_tier")


def cash_flow_schedule(frame: DataFrame, hold: Hold = Hold(), fin: Financing = Financing(),
                       keep: tuple[str, ...] = ("listing_id",)) -> DataFrame:
    """F-7..F-9 per year y = 1..hold_years: NOI, cash flow, remaining balance."""
    df = frame.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(hold.hold_years))))
    return df.select(*keep, "year",
                     noi(F.col("year"), hold).alias("noi"),
                     cash_flow(F.col("year"), hold).alias("cash_flow"),
                     X.loan_balance(F.col("loan_amount"), _lit(fin.interest_rate), _lit(fin.loan_term_years),
                                    F.col("year")).alias("balance"))


def rent_blend(model_rent: str, price: str = "price", gross_yield: str = "gross_yield",
               model_weight: float = C.RENT_MODEL_WEIGHT, yield_weight: float = C.RENT_YIELD_WEIGHT) -> dict:
    """P-41: max(w_model * max(model, 0) + w_yield * price * yield / 12, 0), and x12."""
    m = F.greatest(F.coalesce(F.col(model_rent), F.lit(0.0)), F.lit(0.0))
    est = F.greatest(_lit(model_weight) * m + _lit(yield_weight) * (F.col(price) * F.col(gross_yield) / 12),
                     F.lit(0.0))
    return {"est_monthly_rent": est, "est_annual_rent": est * 12}


# ------------------------------------------------------------- Monte Carlo
_TAGS = ("rg", "pg", "vac")
MC_SPREAD = {"annual_rg": 0.02, "annual_pg": 0.03, "vacancy_scale": 0.5}
_MC_INPUTS = ["purchase_price", "monthly_rent", "monthly_payment", "total_cash_in", "balance_exit", "annual_pg", "exit_cap_rate",
              "vacancy_rate", "tax_rate", "insurance_rate", "mgmt_fee_pct", "maintenance_pct"]
_MC_ROWS = 1000  # rows whose draws are worked on at once


_MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ROOM = 55  # bytes of a message that is one block
_MD5_ROWS = 192  # keys whose hashes are worked on at once


def _md5_first(heads: np.ndarray, tails: list[bytes]) -> np.ndarray:
    """The first 32 bits of md5(head + tail) of messages of one block: (tails, heads). ``heads`` are rows of bytes."""
    n, size = heads.shape
    mine, ends = np.zeros((n, 64), np.uint8), np.zeros((len(tails), 64), np.uint8)
    mine[:, :size] = heads
    for i, t in enumerate(tails):
        ends[i, size:size + len(t) + 1] = np.frombuffer(t + b"\x80", np.uint8)
        ends[i, 56:58] = divmod(8 * (size + len(t)), 256)[::-1]
    mine, ends = mine.view("<u4").astype(np.uint32), ends.view("<u4").astype(np.uint32)
    words = [mine[None, :, j] if 4 * j + 4 <= size else ends[:, j, None] if 4 * j >= size else mine[None, :, j] + ends[:, j, None]
             for j in range(16)]
    a, b, c, d = (np.full((len(tails), n), v, np.uint32) for v in _MD5_START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif turn == 1:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif turn == 2:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.bitwise_not(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16] + np.uint32(_MD5_SINES[i])
        shift = _MD5_SHIFTS[turn][i % 4]
        np.add(f, a, f), np.add(f, word, f)
        np.right_shift(f, np.uint32(32 - shift), g), np.left_shift(f, np.uint32(shift), f), np.bitwise_or(f, g, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(_MD5_START[0])).byteswap()


def _uniforms(keys: list[str | None], n_draws: int) -> np.ndarray:
    """Repeatable uniforms in [0, 1) from the first 32 bits of md5(key | draw | tag), draws from 1: (rows, draws, tags).

    Keys of a length are hashed together, every hash of a batch a step at a time; messages above one block one by one."""
    tails = [f"{i}|{tag}".encode() for i in range(1, n_draws + 1) for tag in _TAGS]
    after = [b"|" + t for t in tails]
    alike: dict[tuple[bool, int], list[int]] = {}
    heads = [b"" if key is None else key.encode() for key in keys]
    for at, key in enumerate(keys):
        alike.setdefault((key is None, len(heads[at])), []).append(at)  # a null part is left out
    out = np.empty((len(keys), len(tails)), np.uint32)
    for (no_key, size), rows in alike.items():
        ends = tails if no_key else after
        for a in range(0, len(rows), _MD5_ROWS):
            some = rows[a:a + _MD5_ROWS]
            if size + max(map(len, ends), default=0) <= _MD5_ROOM:
                out[some] = _md5_first(np.frombuffer(b"".join(heads[i] for i in some), np.uint8).reshape(len(some), size), ends).T
            else:
                out[some] = [[int.from_bytes(md5(heads[i] + t).digest()[:4]) for t in ends] for i in some]
    return out.reshape(len(keys), n_draws, len(_TAGS)) / 4294967296.0


def draw_npvs(u: np.ndarray, v: dict[str, np.ndarray], ops: dict, hold: dict, spread: dict) -> np.ndarray:
    """The NPV of every row and draw; ``v`` has ``_MC_INPUTS`` as (rows, 1) columns, the others the settings by name."""
    H, rent = hold["hold_years"], v["monthly_rent"]
    scale = float(spread["vacancy_scale"])
    rg = hold["annual_rg"] + (2 * u[:, :, 0] - 1) * spread["annual_rg"]
    pg = v["annual_pg"] + (2 * u[:, :, 1] - 1) * spread["annual_pg"]
    vac = v["vacancy_rate"] * (1 - scale + 2 * scale * u[:, :, 2])
    opex = (rent * (1 - vac) * 12 * (v["mgmt_fee_pct"] + ops["capex_pct"])
            + v["purchase_price"] * (v["tax_rate"] + v["insurance_rate"] + v["maintenance_pct"]) + ops["hoa_monthly"] * 12)
    noi_y = lambda y: rent * np.power(1 + rg, y - 1) * 12 * (1 - vac) - opex
    with np.errstate(divide="raise"):  # as the column expressions would
        exit_v = (v["purchase_price"] * np.power(1 + pg, H) + noi_y(H) / v["exit_cap_rate"]) / 2
    last = exit_v * (1 - hold["selling_cost_pct"]) - v["balance_exit"]
    total = np.zeros_like(rg) - v["total_cash_in"]
    for t in range(1, H + 1):
        flow = noi_y(t) - v["monthly_payment"] * 12 + (last if t == H else 0.0)
        total = total + flow / (1 + hold["discount_rate"]) ** float(t)
    return total


def monte_carlo(frame: DataFrame, n_draws: int = 100, key: str = "listing_id", fin: Financing = Financing(),
                ops: Operating = Operating(), hold: Hold = Hold(), spread: dict = MC_SPREAD,
                quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """F-16: distribution of NPV per listing over ``n_draws`` scenarios.

    Draw i shifts rent growth by +-spread, appreciation by +-spread and
    scales vacancy by [1 - s, 1 + s], each from a repeatable hash of
    (key, i). A batch's draws are one array (no explode, no shuffle): each
    row's NPVs are sorted and the nearest-rank quantiles read off;
    ``prob_npv_positive`` is the share of draws above 0. A row with a null
    input has no quantile and a share of 0. ``frame`` is the output of
    ``investment_frame``.
    """
    names = [f"npv_p{int(round(q * 100))}" for q in quantiles]
    places = [max(1, -(-int(round(q * n_draws * 1e6)) // 10 ** 6)) - 1 for q in quantiles]
    ops_, hold_ = asdict(ops), asdict(hold)  # plain numbers for the tasks

    @F.arrow_udf(", ".join(f"{n} double" for n in [*names, "prob_npv_positive"]))
    def simulate(keys: pa.Array, *inputs: pa.Array) -> pa.Array:
        null = np.zeros(len(keys), dtype=bool)
        for x in inputs:
            null |= x.is_null().to_numpy(zero_copy_only=False)
        cols = [x.cast(pa.float64()).fill_null(1.0).to_numpy(zero_copy_only=False) for x in inputs]
        found = np.empty((len(names) + 1, len(keys)))
        for a in range(0, len(keys), _MC_ROWS):
            some = slice(a, a + _MC_ROWS)
            with np.errstate(over="ignore", invalid="ignore"):
                npvs = draw_npvs(_uniforms(keys[some].to_pylist(), n_draws), {n: c[some, None] for n, c in zip(_MC_INPUTS, cols)},
                                 ops_, hold_, spread)
            npvs.sort(axis=1)
            found[:-1, some] = npvs[:, places].T
            found[-1, some] = ((npvs > 0) | np.isnan(npvs)).sum(axis=1) / float(n_draws)  # NaN is above every number
        found[-1, null] = 0.0
        return pa.StructArray.from_arrays([*[pa.array(f, mask=null) for f in found[:-1]], pa.array(found[-1])], [*names, "prob_npv_positive"])

    out = frame.withColumn("_mc", simulate(F.col(key).cast("string"), *[F.col(c).cast("double") for c in _MC_INPUTS]))
    return out.withColumns({n: F.col("_mc")[n] for n in [*names, "prob_npv_positive"]}).drop("_mc")

"""Periodic runs of words by seed and extend on diagonals.

A run of smallest period q and length L holds L - q >= max(LEAST - q, (TIMES - 1) q) places that equal the word q
places on: with 24 and 3 that is 16 words at least, and 2q beyond q = 8. So runs are sought by class: k-grams
of k = 16 words for periods up to 16, of k = 32 for periods up to 32, and so on; a run of the class overlaps itself at its
period by at least k words. As k is not less than the period, two places of a k-gram in a run that are nearer than the
period would give the run a smaller period, so the occurrence pair of a run's seed is that of the k-gram and its *next*
occurrence: each class enumerates at most one pair a word, however often a k-gram occurs. Pairs are walked in order
of lag and place; a table of the furthest covered place of each lag suppresses seeds inside what was already extended,
so that the extensions of a class pass each place of a run once.

A document is worked on inside one row; Spark deals the rows. A k-gram is named by a 64-bit hash built up by doubling,
and every extension compares the words themselves, so no run is ever reported falsely.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import slices, small_batches

LEAST = 24  # words of the shortest run
TIMES = 3  # periods of the shortest run
_STEP = 64  # words that an extension compares first; the step doubles

Run = tuple[int, int, int]  # start, length, period


def _mixed(h: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Names of grams of twice the size (64-bit arithmetic that wraps round)."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + ahead
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _match(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The first place from ``at`` on, before ``stop``, whose word is not the one ``lag`` places on; else ``stop``."""
    step = _STEP
    while at < stop:
        end = min(at + step, stop)
        unlike = ids[at:end] != ids[at + lag:end + lag]
        if unlike.any():
            return at + int(unlike.argmax())
        at, step = end, step * 2
    return stop


def _match_back(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The smallest place from which all words up to ``at`` equal those ``lag`` places on, not below ``stop``."""
    step = _STEP
    while at > stop:
        low = max(at - step, stop)
        unlike = ids[low:at] != ids[low + lag:at + lag]
        if unlike.any():
            return at - int(unlike[::-1].argmax())
        at, step = low, step * 2
    return stop


def _seeds(names: np.ndarray, low: int, high: int) -> tuple[list[tuple[int, int]], bool]:
    """(lag, place), in that order, of grams whose next occurrence is more than ``low`` and at most ``high`` places
    on (of neighbouring places with one lag only the first); and whether any gram occurs again."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    place, lag = order[:-1][same], (order[1:] - order[:-1])[same]
    mine = (lag > low) & (lag <= high)
    place, lag = place[mine], lag[mine]
    walk = np.lexsort((place, lag))
    place, lag = place[walk], lag[walk]
    head = np.ones(len(place), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return list(zip(lag[head].tolist(), place[head].tolist())), bool(same.any())


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All maximal stretches of smallest period q and length >= max(least, times * q), by start, then period.

    Two stretches can overlap; a stretch is maximal if no neighbouring word extends it with period q.
    """
    n = len(ids)
    found: list[Run] = []
    if n < least:
        return found
    k, h = 1, ids.astype(np.uint64) + np.uint64(1)
    low, high = 0, _first_class(least, times)
    again = True
    while again and times * (low + 1) <= n:
        while k < high:
            h = _mixed(h[:-k], h[k:])
            k *= 2
        seeds, again = _seeds(h, low, high)
        covered: dict[int, int] = {}
        for lag, place in seeds:
            done = covered.get(lag, 0)
            if place < done:
                continue
            left = _match_back(ids, place, lag, done)
            right = _match(ids, place, lag, n - lag)
            covered[lag] = max(right, place + 1)
            length = right - left + lag
            if length >= max(least, times * lag):
                found.append((left, length, lag))
        low, high = high, 2 * high  # a run of the next class overlaps itself by two periods or more, each above ``low``
    return sorted(found, key=lambda r: (r[0], r[2]))


def _first_class(least: int, times: int) -> int:
    """Words of the smallest class: a power of two that every run of a period up to it overlaps itself by."""
    k = 1
    while all(max(least - q, (times - 1) * q) >= 2 * k for q in range(1, 2 * k + 1)):
        k *= 2
    return k


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def tail_repeated(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words with a planted tail: for h = crc32 of the id as text and g = h // 10, if 10 divides h, each word
    from a = g % n on becomes the word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` lists (start, length, period) by start, then period; ``collapsed`` is the words left, joined by one space,
    when every run keeps its first period only. Words are parted by ASCII white space and counted from 0. A null text
    has no words; repeated rows get equal results. ``edit`` changes a document's words before the search.
    """
    if least < 2 or times < 3:
        raise ValueError("runs need two words and three periods at least")
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sizes, runs, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if edit is not None:
                    words = edit(doc_id, words)
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found = runs_of(ids, least, times)
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(ids), found)).tolist()]
                sizes.append(len(ids))
                runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)),
                                              pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return (small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(scan, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def report(docs: DataFrame) -> DataFrame:
    """Contract view of ``find_runs`` with planted tails: the run of greatest length / period, and digests."""
    found = find_runs(docs, edit=tail_repeated)
    # fractions are compared exactly; runs come by start, then period, so the first of equals stays
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)),
                    lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                          r["period"].cast("string")), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))

"""Suffix dedup by minimum-hash window grouping; no suffix is sorted (see the README for why).

A byte goes if a ``SPAN``-byte string over it also starts in a document with a smaller id. External induced sorting would
hold at least sixteen bytes of tuples for every text byte. What is wanted needs less than the order of all suffixes: windows
of one fixed length that are equal. They are brought together by a name that equal windows share wherever they stand:

1. Each window of ``SPAN`` bytes is named by the smallest hash among its ``GRAM``-byte strings. Consecutive windows
   of one name form a run (about sixteen windows): one tuple (name, content name, document, place and common
   length). Tuples are grouped by Spark's external, disk-backed sort.
2. A run whose whole content also stands in a smaller document is settled: all its windows are repeats.
3. Runs that share a name with different content (the ends of repeated passages) go down one level: their bytes
   are brought together by name and their windows are compared one by one. Names with more than ``HOT`` tuples
   are not brought together; their windows are named and grouped themselves, which spreads them over all tasks.

Equal windows always share a name, so no repeat is missed; content names are 64-bit hashes compared only within
equal 64-bit names (together 128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import drop_written, materialise, slices

SPAN = 50
GRAM = 20
RUN = 64  # windows in one tuple, at most
_BLOCK = 1 << 20  # bytes looked at in one piece
_GATHER = 1 << 20  # tuples gathered in a task before equal ones are settled there
HOT = 8192  # tuples of one name whose bytes one task may hold (about 100 bytes each)
_BASE = 0x9E3779B97F4A7C15
#: A tuple's place: start byte << 32 | 24 bits that tell apart texts of one id << 8 | settled << 7 | windows - 1
_SETTLED = 1 << 7


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = (np.full(n, b, np.uint64) for b in (_BASE, inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of any substrings of a block of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(_BLOCK + 4 * SPAN + RUN)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes()[data] * up[:len(data)], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        """Of every substring of one size."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


def _least_over(x: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_names(h: _Hashes) -> np.ndarray:
    """The name of every window of the block."""
    return _least_over(h.grams(GRAM), SPAN - GRAM + 1)


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of equally named windows in a block of documents that end at ``ends``.

    Returns (name, content, start in the block, windows); no window crosses the end of a document.
    """
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < SPAN:
        return none
    h = _Hashes(data)
    names = window_names(h)
    n = len(names)
    opens = np.ones(n, bool)
    np.not_equal(names[1:], names[:-1], out=opens[1:])
    inside = np.ones(n, bool)
    for e in ends[:-1]:
        inside[max(0, e - SPAN + 1):min(e, n)] = False
        if e < n:
            opens[e] = True
    opens[1:] |= inside[1:] != inside[:-1]
    start = np.flatnonzero(opens)
    count = np.diff(np.append(start, n))
    keep = inside[start]
    start, count = start[keep], count[keep]
    if len(count) and count.max() > RUN:  # periodic text
        pieces = -(-count // RUN)
        step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
        start, count = np.repeat(start, pieces) + step, np.minimum(np.repeat(count, pieces) - step, RUN)
    return names[start], h.at(start, count + SPAN - 1), start, count


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row of each document, where its piece starts in the text): pieces of about ``_BLOCK`` bytes."""
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    held, size = [], 0
    pieces = ((row, low, t[low:low + _BLOCK + SPAN - 1]) for row, t in enumerate(texts) if t
              for low in range(0, max(1, len(t) - SPAN + 1), _BLOCK))
    for row, low, piece in [*pieces, (None, 0, b"")]:
        if held and (row is None or size + len(piece) > _BLOCK + SPAN):
            yield (np.frombuffer(b"".join(p for _, _, p in held), np.uint8), np.cumsum([len(p) for _, _, p in held]),
                   np.array([r for r, _, _ in held]), np.array([x for _, x, _ in held], dtype=np.int64))
            held, size = [], 0
        if row is not None and len(piece) >= SPAN:
            held.append((row, low, piece))
            size += len(piece)


def _settle(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of equal (name, content) in one task only the smallest document's tuple is still open.

    The others are repeats for certain: they are marked settled and named by their own place, so a passage that
    stands in a large part of all documents is one tuple a task.
    """
    name, content, doc, place = rows
    order = np.lexsort((doc, content, name))
    n, c, d = name[order], content[order], doc[order]
    first = np.ones(len(n), bool)
    first[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
    least = d[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(n) else d
    done = order[d > least]
    place = place.copy()
    place[done] |= _SETTLED
    name, content = name.copy(), content.copy()
    name[done] = _mix(doc[done].astype(np.uint64) * np.uint64(_BASE) + place[done].astype(np.uint64))
    content[done] = 0
    return [name, content, doc, place]


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held):
        cols = _settle([np.concatenate(x) for x in zip(*held)])
        for low in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[low:low + (1 << 16)].view(np.int64)) for x in cols],
                                             names=["name", "content", "doc_id", "place"])

    held, size = [], 0
    for batch in slices(batches):
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
        for data, ends, row, low in _blocks(batch):
            name, content, start, count = runs(data, ends)
            piece = np.searchsorted(ends, start, side="right")
            begin = start - np.concatenate(([0], ends[:-1]))[piece] + low[piece]
            of = row[piece]
            held.append((name, content, ids[of].astype(np.int64), begin << 32 | tags[of].astype(np.int64) << 8 | (count - 1)))
            size += len(name)
            if size >= _GATHER:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


_ASKED = "name long, window long, doc_id long, tag int, place long, content binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked runs with their bytes; those of hot names window by window."""
    def out(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in _ASKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    for batch in slices(batches):
        rows = []
        for doc_id, text, tag, runs_ in zip(*(batch.column(c).to_pylist() for c in range(4))):
            for run in runs_:
                place = run["place"]
                begin, count = place >> 32, (place & (_SETTLED - 1)) + 1
                content = text[begin:begin + count + SPAN - 1]
                if not run["hot"]:
                    rows.append((run["name"], 0, doc_id, tag, place, content))
                    continue
                windows = _Hashes(np.frombuffer(content, np.uint8)).at(np.arange(count), SPAN).view(np.int64)
                rows += [(run["name"], w, doc_id, tag, (begin + k) << 32, None) for k, w in enumerate(windows.tolist())]
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def _late_windows(name: np.ndarray, doc: np.ndarray, place: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that also stand in a smaller document's content of the same name: (row, place)."""
    count = (place & (_SETTLED - 1)) + 1
    size = count + SPAN - 1
    base = np.cumsum(size) - size
    h = _Hashes(np.frombuffer(b"".join(content), np.uint8))
    row = np.repeat(np.arange(len(name)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    window = h.at(base[row] + offset, SPAN)
    order = np.lexsort((doc[row], window, name[row]))
    n, w, d = name[row][order], window[order], doc[row][order]
    first = np.ones(len(n), bool)
    first[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
    late = np.zeros(len(n), bool)
    late[order] = d > d[np.flatnonzero(first)[np.cumsum(first) - 1]]
    opens = late.copy()
    opens[1:] &= ~late[:-1] | (row[1:] != row[:-1])
    begin = np.flatnonzero(opens)
    if not len(begin):
        return begin, begin
    length = np.bincount(np.cumsum(opens)[late] - 1, minlength=len(begin))
    return row[begin], ((place[row[begin]] >> 32) + offset[begin]) << 32 | (length - 1)


def _compare_by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by name: (doc_id, tag, place) of the late windows."""
    held: pa.Table | None = None
    for batch in _then_none(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        now = table if held is None else held if table is None else pa.concat_tables([held, table])
        if now is None or not len(now):
            continue
        name = now.column("name").to_numpy()
        edges = np.flatnonzero(name[1:] != name[:-1]) + 1
        done = len(name) if batch is None else int(edges[-1]) if len(edges) else 0
        held = now.slice(done)
        bounds = [0, *edges[edges < done].tolist(), done]
        low = 0
        for k, high in enumerate(bounds):  # whole names, at most HOT rows at a time
            if high > low and (high == done or bounds[k + 1] - low > HOT):
                part = now.slice(low, high - low)
                doc, place = part.column("doc_id").to_numpy(), part.column("place").to_numpy()
                row, late = _late_windows(part.column("name").to_numpy(), doc, place, part.column("content").to_pylist())
                tag = part.column("tag").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tag[row]), pa.array(late)], names=["doc_id", "tag", "place"])
                low = high


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the covered bytes: (doc_id, n_bytes, n_removed, n_spans, kept)."""
    for batch in slices(batches):
        rows = []
        for doc_id, text, places in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
            text = text or b""
            if not places:
                rows.append((doc_id, len(text), 0, 0, text))
                continue
            places = np.array(places, dtype=np.int64)
            edge = np.zeros(len(text) + 1, np.int64)
            begin = places >> 32
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + (places & (_SETTLED - 1)) + SPAN, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((doc_id, len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _tag(place: Column) -> Column:
    return (F.shiftright(place, 8).bitwiseAND(F.lit((1 << 24) - 1))).cast("int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``; kept holds the remaining bytes.

    A byte is removed if some ``SPAN`` bytes over it (inside one text) also start in a document with a smaller id.
    Null texts are empty. Rows with a null id are compared with nothing and stay whole. Rows that repeat an id do
    not remove each other, and rows that repeat id and text get equal results. Texts under ``SPAN`` bytes stay.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    texts = texts.withColumn("tag", F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))
    tuples = (texts.filter(f"doc_id is not null and octet_length(text) >= {SPAN}")
              .mapInArrow(_tuples, "name long, content long, doc_id long, place long"))
    by_name, by_content = Window.partitionBy("name"), Window.partitionBy("name", "content")
    ranked = (tuples.repartition("name")
              .withColumn("first", F.min("doc_id").over(by_content))
              .withColumn("least", F.min("doc_id").over(by_name))
              .withColumn("most", F.max("doc_id").over(by_name))
              .withColumn("mixed", F.min("content").over(by_name) != F.max("content").over(by_name))
              .withColumn("hot", F.count("*").over(by_name) > HOT))
    settled = (F.col("place").bitwiseAND(F.lit(_SETTLED)) != 0) | (F.col("doc_id") > F.col("first"))
    asked = ~settled & F.col("mixed") & (F.col("least") < F.col("most"))
    found = materialise(
        ranked.select("doc_id", _tag(F.col("place")).alias("tag"), "place", F.when(asked, F.struct("name", "place", "hot")).alias("ask"),
                      settled.alias("settled")).filter("settled or ask is not null"), "suffix-runs")

    open_runs = found.filter("not settled").groupBy("doc_id", "tag").agg(F.collect_list("ask").alias("asks"))
    asks = materialise(texts.join(open_runs, ["doc_id", "tag"]).select("doc_id", "text", "tag", "asks").mapInArrow(_asked, _ASKED),
                       "suffix-asked")
    late = (asks.filter("content is not null").select("name", "doc_id", "tag", "place", "content").repartition("name")
            .sortWithinPartitions("name").mapInArrow(_compare_by_name, "doc_id long, tag int, place long"))
    windows = asks.filter("content is null").select("name", "window", "doc_id", "tag", "place")
    firsts = windows.groupBy("name", "window").agg(F.min("doc_id").alias("first"))
    late_hot = windows.join(firsts, ["name", "window"]).filter("doc_id > first").select("doc_id", "tag", "place")
    every = found.filter("settled").select("doc_id", "tag", "place").unionByName(late).unionByName(late_hot)
    repeats = materialise(every.groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places")), "suffix-places")
    drop_written(found)
    drop_written(asks)
    return (texts.join(repeats, ["doc_id", "tag"], "left").select("doc_id", "text", "tag", "places")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def report(docs: DataFrame) -> DataFrame:
    """Contract view: the kept bytes as a checksum."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

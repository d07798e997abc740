"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Every benchmark item gives windows of ``window`` consecutive words (a shorter item is one window). Windows of one
length form a Wu-Manber machine whose alphabet is words: a shift table over blocks of two words tells how far the
search may jump, so text without benchmark blocks is read about every ninth word; a block with shift zero selects
its suffix bucket, whose windows are compared word by word.

The machines travel to the tasks in slices of at most ``SLICE_BYTES`` of item text. A larger benchmark is searched
in several narrow passes (no shuffle), so what is broadcast never grows with it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import materialise, slices, small_batches

WINDOW = 10
SLICE_BYTES = 2 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_STATE = "doc_id long, text binary, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; null has none."""
    return _WORD.findall(text.lower()) if text else []


class Machine:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], set[int]]]] = defaultdict(list)
        for w, items in windows.items():
            for end in range(self.block, length + 1):
                b = w[end - self.block:end]
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.bucket[w[-self.block:]].append((list(w), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Start and items of every occurrence."""
        n, length, far, shift, bucket = len(words), self.length, self.far, self.shift, self.bucket
        two, at = self.block == 2, length - 1
        while at < n:
            block = (words[at - 1], words[at]) if two else (words[at],)
            jump = shift.get(block, far)
            if jump:
                at += jump
                continue
            start = at - length + 1
            for w, items in bucket[block]:
                if words[start] == w[0] and words[start:at + 1] == w:
                    yield start, items
            at += 1


class Patterns:
    """All windows of a slice of items; item ids are strings ("" for null)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            size = min(window, len(words))
            for s in range(len(words) - size + 1 if size else 0):
                by_length[size][tuple(words[s:s + size])].add(k)
        self.machines = [Machine(n, w) for n, w in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of hit words, and the ids of the items that hit."""
        found, items = [], set()
        for m in self.machines:
            for start, which in m.search(words):
                found.append((start, start + m.length))
                items |= which
        return merged(found), {self.ids[k] for k in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_BUILT: dict[int, Patterns] = {}


def _patterns(items: list[tuple[str, bytes]], window: int) -> Patterns:
    """Tables are built once per Python worker and slice."""
    key = hash((window, tuple(items)))
    if key not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[key] = Patterns(items, window)
    return _BUILT[key]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                            F.col(text_col).cast("string").cast("binary").alias("t")).filter("t is not null").distinct()


def _slice_count(benchmark: DataFrame, id_col: str, text_col: str) -> int:
    total = _items(benchmark, id_col, text_col).agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(1, -(-total // SLICE_BYTES))


def _slice(benchmark: DataFrame, id_col: str, text_col: str, k: int, n: int) -> list[tuple[str, bytes]]:
    """One slice of the items on the driver: about ``SLICE_BYTES``, whatever the benchmark's size."""
    part = _items(benchmark, id_col, text_col).filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
    return sorted((r.i, bytes(r.t)) for r in part.collect())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, item_ids) for every row of ``docs``, in whole texts.

    spans are the merged word ranges [start, end) inside occurrences; item_ids the sorted ids (as strings) of the
    items with an occurring window. A null or empty text has no words. A null item text gives no window, a null
    item id stands as "". Rows that repeat an item id add their windows to that id. An empty benchmark hits nothing.
    """
    state = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"),
                        F.lit(0).cast("long").alias("n_words"),
                        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
                        F.expr("cast(array() as array<string>)").alias("item_ids"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = _STATE.replace("doc_id long", f"doc_id {id_type}")
    parts = _slice_count(benchmark, item_col, item_text_col)
    for k in range(parts):
        items, last = _slice(benchmark, item_col, item_text_col, k, parts), k == parts - 1

        def scan(batches: Iterator[pa.RecordBatch], items=items, last=last) -> Iterator[pa.RecordBatch]:
            patterns = _patterns(items, window)
            for batch in slices(batches):
                counts, spans, ids = [], [], []
                texts, old_spans, old_ids = (batch.column(c).to_pylist() for c in (1, 3, 4))
                for text, s, i in zip(texts, old_spans, old_ids):
                    words = words_of(text)
                    found, which = patterns.search(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(found + [(x["start"], x["end"]) for x in s])])
                    ids.append(sorted(which.union(i)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.nulls(len(batch), pa.binary()) if last else batch.column(1), pa.array(counts, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "item_ids"])

        state = small_batches(state).mapInArrow(scan, schema)
        if k % 8 == 7:
            state = materialise(state, "decontam")
    return state.drop("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, in whose text no benchmark window occurs (null texts stay)."""
    kept = docs
    at = docs.columns.index(text_col)
    parts = _slice_count(benchmark, item_col, item_text_col)
    for k in range(parts):
        items = _slice(benchmark, item_col, item_text_col, k, parts)

        def scan(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            patterns = _patterns(items, window)
            for batch in slices(batches):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                clean = [not any(True for m in patterns.machines for _ in m.search(w)) for w in map(words_of, texts)]
                yield pc.filter(batch, pa.array(clean, pa.bool_()))

        kept = small_batches(kept).mapInArrow(scan, docs.schema)
        if k % 8 == 7:
            kept = materialise(kept, "decontam")
    return kept


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract view of ``contamination``."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))

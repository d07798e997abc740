"""SimHash near-duplicates: bit-sliced comparison of fingerprints within pigeonhole groups.

1. One fingerprint per document (whole text), computed where the text is read; only 8 bytes travel on.
2. Equal fingerprints collapse to one row. Fingerprints within ``radius`` bits agree on at least two of
   ``radius + 2`` bit blocks, so each is dealt to one group per pair of blocks: no link can be missed.
3. Inside a group fingerprints are stored as bit planes (one packed array per bit). Shifting the planes by d
   rows compares row i with row i + d for 64 rows a word; differing bits are added by carry-save adders, and
   words whose pairs all exceed the radius are abandoned after every eight planes.
4. Groups above ``BLOCK`` rows (thousands of near copies) are cut into blocks, and each pair of blocks is a
   task of its own. Every task emits a spanning forest of its links, never all pairs.
5. Distributed union-find joins the links; classes are named by their smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import materialise, slices, small_batches
from plotline.llm.components import connected_components

BITS = 64
BLOCK = 4096  # rows compared in one piece; larger groups go block against block
SEED = 42


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of one text, as an unsigned integer."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and white space x20, x09-x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[shingle:]] + [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp): fp is the fingerprint as a signed long; texts without words (null too) have 0."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "tag", "fp"])

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return small_batches(picked).mapInArrow(scan, "doc_id long, tag long, fp long")


def block_masks(radius: int) -> list[int]:
    """Bit masks of all pairs of ``radius + 2`` blocks; ``radius`` flips leave two blocks untouched."""
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of row i stands in plane b, word i // 64, bit i % 64; one spare word follows."""
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    words = len(fps) // 64 + 2
    out = np.zeros((BITS, words * 8), np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view("<u8")


def _pack(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[:len(packed)] = packed
    return out.view("<u8")


def _shift(planes: np.ndarray, d: int, words: int) -> np.ndarray:
    """Planes moved down by d rows, ``words`` words wide."""
    w, s = divmod(d, 64)
    low = planes[..., w:w + words]
    if not s:
        return low
    return (low >> np.uint64(s)) | (planes[..., w + 1:w + 1 + words] << np.uint64(64 - s))


def _full_add(a, b, c):
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def within(left: np.ndarray, right: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Positions (bit numbers) where ``valid`` is set and the planes differ in at most ``radius`` (< 7) bits."""
    words = np.flatnonzero(valid)
    alive = valid[words]
    ones = twos = fours = over = np.zeros(len(words), np.uint64)
    for first in range(0, BITS, 8):
        if not len(words):
            return np.empty(0, np.int64)
        x = left[first:first + 8, words] ^ right[first:first + 8, words]
        ones, t1 = _full_add(ones, x[0], x[1])
        ones, t2 = _full_add(ones, x[2], x[3])
        twos, f1 = _full_add(twos, t1, t2)
        ones, t1 = _full_add(ones, x[4], x[5])
        ones, t2 = _full_add(ones, x[6], x[7])
        twos, f2 = _full_add(twos, t1, t2)
        fours, eights = _full_add(fours, f1, f2)
        over = over | eights
        exceeds = over.copy()
        for count in range(radius + 1, 8):
            exceeds |= ((ones if count & 1 else ~ones) & (twos if count & 2 else ~twos) & (fours if count & 4 else ~fours))
        alive = alive & ~exceeds
        keep = alive != 0
        if not keep.all():  # abandon words whose 64 pairs all exceed the radius
            words, alive, ones, twos, fours, over = (v[keep] for v in (words, alive, ones, twos, fours, over))
    bits = np.unpackbits(alive.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    w, b = np.nonzero(bits)
    return words[w] * 64 + b


class _Forest:
    """Union-find over the rows of one block; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.parent[i] != self.parent[j]
        if not apart.any():
            return
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            ra, rb = self._root(a), self._root(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                self.links.append((a, b))
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up


def links_in_runs(fps: np.ndarray, lengths: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links inside consecutive runs of rows: (n, 2) fingerprints."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    lengths = lengths[order]
    total = int(lengths.sum())
    within_run = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows = fps[np.repeat(starts, lengths) + within_run]
    left_over = np.repeat(lengths, lengths) - within_run  # rows from here to the run's end
    longest = int(lengths[0]) if total else 0
    planes = bit_planes(rows)
    planes = np.concatenate([planes, np.zeros((BITS, longest // 64 + 2), np.uint64)], axis=1)  # room for every shift
    forest = _Forest(total)
    for d in range(1, longest):
        n = int(lengths[lengths > d].sum())  # longer runs stand first
        words = n // 64 + 1
        i = within(planes[:, :words], _shift(planes, d, words), _pack(left_over[:n] > d, words), radius)
        forest.add(i, i + d)
    if not forest.links:
        return np.empty((0, 2), np.int64)
    return rows[np.array(forest.links)].view("<i8")


def links_between(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links between the rows of two blocks, by rotating the second past the first."""
    if len(one) < len(two):
        one, two = two, one
    n, m = len(one), len(two)
    planes = np.concatenate([bit_planes(np.concatenate([one, one])), np.zeros((BITS, 2), np.uint64)], axis=1)
    short = bit_planes(two)
    words = m // 64 + 1
    valid = _pack(np.ones(m, bool), words)
    forest = _Forest(n + m)
    for d in range(n):
        i = within(short[:, :words], _shift(planes, d, words), valid, radius)
        forest.add(n + i, (i + d) % n)
    if not forest.links:
        return np.empty((0, 2), np.int64)
    return np.concatenate([one, two])[np.array(forest.links)].view("<i8")


def similar_fingerprints(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span every class of fingerprints (column fp, distinct) within ``radius`` bits."""
    masks = [_signed(m) for m in block_masks(radius)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed(t: np.ndarray, key: np.ndarray, fp: np.ndarray, ends: bool):
            """Links and outgrown runs of all rows but those of the last run, if that may go on."""
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(t)] * ends)).astype(np.int64)
            return bounds[:-1], np.diff(bounds), int(bounds[-1])

        held = [np.empty(0, np.int64)] * 3  # the run that the last batch ended in
        spilled = 0  # blocks of that run that are already out
        for pdf in _then_none(batches):
            now = held if pdf is None else [np.concatenate([h, pdf[c].to_numpy()]) for h, c in zip(held, ("t", "key", "fp"))]
            if not len(now[0]):
                continue
            starts, lengths, done = closed(*now, ends=pdf is None)
            t, key, fp = now
            big, in_place = [], np.ones(len(starts), bool)
            for r in np.flatnonzero((lengths > block) | ((np.arange(len(starts)) == 0) & (spilled > 0))):
                in_place[r] = False
                big.append((starts[r], lengths[r], spilled if r == 0 else 0))
            if len(starts):
                spilled = 0
            rest = len(t) - done
            while pdf is not None and rest >= 2 * block:  # the open run is large: let whole blocks go
                big.append((done, block, spilled))
                done, rest, spilled = done + block, rest - block, spilled + 1
            for s, n, b in big:
                yield pd.DataFrame({"a": fp[s:s + n], "b": key[s:s + n], "t": t[s:s + n].astype(np.int32),
                                    "block": (b + np.arange(n) // block).astype(np.int32)})
            if in_place.any():
                several = in_place & (lengths > 1)
                rows = fp[:int(lengths.sum())][np.repeat(several, lengths)]
                found = links_in_runs(rows.view("<u8"), lengths[several], radius)
                if len(found):
                    yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "t": np.int32(-1), "block": np.int32(0)})
            held = [v[done:] for v in now]

    def compare_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf["a"].to_numpy()[pdf["block"].to_numpy() == k].view("<u8") for k in key[2:])
        if key[2] == key[3]:
            found = links_in_runs(one, np.array([len(one)]), radius)
        else:
            found = links_between(one, two, radius)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    out = materialise(dealt.mapInPandas(compare, "a long, b long, t int, block int"), "simhash-links")
    links = out.filter("t < 0").select("a", "b")
    spill = out.filter("t >= 0")
    if spill.isEmpty():
        return links
    blocks = spill.groupBy("t", "b").agg((F.max("block") + 1).alias("blocks"))
    paired = (spill.join(blocks, ["t", "b"])
              .select("t", "b", "a", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .select("t", "b", "a", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    return links.unionByName(paired.groupBy("t", "b", "i", "j").applyInPandas(compare_blocks, "a long, b long"))


def _then_none(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp, component_id, root) for every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most ``radius`` (< 7)
    differing bits, root the smallest such fingerprint; tag is a hash of the text. Null and empty texts share
    fingerprint 0 and link like any other. A null doc_id never names a class while another id is in it; repeated
    rows get equal results; an empty table gives an empty table.
    """
    fps = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = materialise(similar_fingerprints(distinct.select("fp"), radius), "simhash-spans")
    roots = connected_components(links, "a", "b")
    linked = distinct.join(roots, distinct.fp == roots.node).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "least", "root")
    classes = (distinct.join(named, "fp", "left")
               .select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"),
                       F.coalesce("root", "fp").alias("root")))
    return fps.join(classes, "fp").select("doc_id", "tag", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, its own columns as they are.

    The row with the smallest id stays (a null id only if the class has no other; equal ids by a hash of the text).
    """
    classes = near_duplicates(docs, shingle, radius, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("best")
    kept = classes.groupBy("root").agg(best).select(F.col("best.doc_id").alias("_id"), F.col("best.tag").alias("_tag")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_tag"))
    rows = docs.join(kept, same, "left_semi").withColumn("_tag", F.xxhash64(F.col(text_col).cast("string")))
    return rows.dropDuplicates([id_col, "_tag"]).drop("_tag")


def class_table(docs: DataFrame) -> DataFrame:
    """Contract view: doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

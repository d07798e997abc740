"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs with one word between, hashed to 2^``DIM_BITS`` buckets.
FTRL-proximal keeps a rate per coordinate, and its L1 term leaves few weights other than zero, so the model that
travels to the tasks is a short list of (bucket, weight).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import slices, small_batches
from plotline.llm.langid import held_out

DIM_BITS = 22
SAMPLE = 8000  # labelled documents learned from, at most, half of each class where there are as many
ALPHA, BETA, L1, L2 = 4.0, 1.0, 6.0, 0.0
EPOCHS = 10
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_BLOCK = 1 << 18  # words hashed at once


def _buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of all words, pairs and skip pairs, repeats included."""
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    grams = [h, (h[:-1] * np.uint32(0x85EBCA6B)) ^ (h[1:] * np.uint32(0xC2B2AE35)),
             (h[:-2] * np.uint32(0x27D4EB2F)) + (h[2:] * np.uint32(0x165667B1))]
    return ((np.concatenate(grams) * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)).astype(np.int32)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a whole text, a block of words at a time; blocks overlap by two words."""
    words = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall((text or "").lower())]
    for low in range(0, len(words), _BLOCK):
        yield _buckets(words[low:low + _BLOCK + 2])


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text."""
    found = [np.unique(b) for b in buckets(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


@dataclass(frozen=True)
class ToxicityModel:
    """The weights that are not zero; ``bias`` alone scores a text without words."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        dense = np.zeros(1 << DIM_BITS)
        dense[self.bucket] = self.weight
        sums = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            hit = [b[dense[b] != 0] for b in buckets(t)]
            if hit:
                sums[i] += dense[np.unique(np.concatenate(hit))].sum()
        return 1 / (1 + np.exp(-np.clip(sums, -40, 40)))


def ftrl(rows: list[tuple[np.ndarray, int]]) -> ToxicityModel:
    """FTRL-proximal over the rows in the given order, ``EPOCHS`` times; the last coordinate is the bias."""
    n_dim = (1 << DIM_BITS) + 1
    z, n = np.zeros(n_dim), np.zeros(n_dim)

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for idx, label in rows:
            at = np.append(idx, n_dim - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(n_dim))
    kept = np.flatnonzero(w[:-1])
    return ToxicityModel(kept.astype(np.int32), w[kept], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold (crc32 of the id mod 3 is 1).

    Labels other than 0 and 1 (null too) are left out; an id labelled twice counts as toxic if any label says so.
    At most ``SAMPLE`` documents, chosen by a hash of the id, are read for learning.
    """
    marked = (labels.filter(~held_out(id_col, 3, 1) & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
              .withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 30))))
    some = [marked.filter(F.col("label") == k).orderBy("u", "id").limit(SAMPLE // 2) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most SAMPLE rows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["u", "label", "found"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = (texts.join(chosen, "id").select("text", "u", "label").mapInArrow(scan, "u long, label int, found binary")
            .collect())
    rows = sorted((r.u, bytes(r.found), r.label) for r in rows)[:2 * SAMPLE]
    return ftrl([(np.frombuffer(f, "<i4"), y) for _, f, y in rows])


def score(model: ToxicityModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; the text alone decides, null counts as empty.

    A text without words has the score of the bias alone. predicted is 1 from a score of ``THRESHOLD`` on.
    Without labelled rows every score is 0.5.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = model.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return small_batches(picked).mapInArrow(scan, f"doc_id {id_type}, held_out boolean, score double, predicted int")

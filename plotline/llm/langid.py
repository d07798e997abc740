"""Language ID by a string kernel: blended-spectrum presence kernel, Nyström landmarks, kernel ridge regression.

A text is the set of its letter n-grams of length 1 to ``MAX_N`` (lower-cased, anything but letters is a space), kept
as one presence bit per hash bucket. The kernel of two texts is the number of shared buckets over the root of
their sizes' product. One-versus-rest kernel ridge regression is fitted on a bounded sample through landmark texts;
since the kernel is a dot product, landmarks times dual weights fold into one matrix, and a batch of texts is scored
by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import slices, small_batches

MAX_N = 3
DIM_BITS = 15
SAMPLE = 2048  # labelled rows learned from, at most about this many over all languages
LANDMARKS = 256
RIDGE = 1e-3
UNDETERMINED = "und"
#: Least score in a stage that drops documents of no known language: the score of a text with as many n-grams that
#: training has not seen as the odd texts of the language have, see ``LanguageModel.predict``.
KEEP_SCORE = 0.5
ODD = 0.99  # this share of a language's learnable rows have a lower rate of unseen n-grams than its limit
LEAST_LIMIT = 0.02  # no limit is lower: that few rows of a language say little of its rarest n-grams
FOLDS = 4
_BATCH = 64


@cache
def _letters() -> np.ndarray:
    """Flag of every code point: is it a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def mark_grams(text: str | None, row: np.ndarray) -> bool:
    """Set the presence bits of one whole text in ``row``; False (and no bit) if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter, shift = _letters(), np.uint32(32 - DIM_BITS)
    found = False
    for low in range(0, len(codes), 1 << 20):  # overlapping blocks bound the memory of a very long text
        part = codes[low:low + (1 << 20) + MAX_N - 1]
        is_letter = letter[part]
        if not is_letter.any():
            continue
        found = True
        c = np.where(is_letter, part, np.uint32(32))
        gram = np.zeros(len(c), np.uint32)
        for n in range(1, MAX_N + 1):
            if len(c) < n:
                break
            gram = (gram if n == 1 else gram[:-1]) * np.uint32(0x01000193) + c[n - 1:] + np.uint32(n)
            row[(gram * np.uint32(0x9E3779B1)) >> shift] = True
    return found


@dataclass(frozen=True)
class LanguageModel:
    """classes (sorted) and, for each hash bucket, the folded dual weights of every class; the buckets seen in
    training, and for every class the limit of the share of buckets not seen."""

    classes: tuple[str, ...]
    weights: np.ndarray
    offset: np.ndarray
    seen: np.ndarray
    unseen_limit: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Names and scores. The votes of a text always sum to the same, so the winning one cannot tell an unlearned
        language; the score is 1 less half the unseen n-grams over the number that the limit expects, after two
        standard deviations of that number are taken off (short texts vary more). It does not depend on the number
        of classes."""
        names, scores = [], np.zeros(len(texts))
        for low in range(0, len(texts), _BATCH):
            some = texts[low:low + _BATCH]
            marks = np.zeros((len(some), 1 << DIM_BITS), bool)
            known = np.array([mark_grams(t, marks[i]) for i, t in enumerate(some)], bool)
            if not self.classes:
                names += [UNDETERMINED] * len(some)
                continue
            sizes = np.maximum(marks.sum(axis=1), 1)
            votes = (marks.astype(np.float32) @ self.weights).astype(np.float64) / np.sqrt(sizes)[:, None] + self.offset
            best = votes.argmax(axis=1)
            names += [self.classes[b] if k else UNDETERMINED for b, k in zip(best, known)]
            expected = sizes * self.unseen_limit[best]
            over = np.maximum((marks & ~self.seen).sum(axis=1) - 2 * np.sqrt(expected), 0)
            scores[low:low + len(some)] = np.where(known, np.clip(1 - over / (2 * expected), 0, 1), 0.0)
        return names, scores


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for rows kept from learning: crc32 of the id as text leaves ``fold``; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> pd.DataFrame:
    """(lang, u, bits): presence bits of about ``SAMPLE`` learnable rows, equally many of each language."""
    rows = (docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                    (F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) / (1 << 30)).alias("u")))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "u": [], "bits": []})
    each = max(1, SAMPLE // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * each / n))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits, keep = [], []
            for t in batch.column(1).to_pylist():
                row = np.zeros(1 << DIM_BITS, bool)
                keep.append(mark_grams(t, row))
                bits.append(np.packbits(row).tobytes())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary())], names=["lang", "u", "bits"])
            yield pc.filter(out, pa.array(keep, pa.bool_()))

    some = small_batches(rows).filter(F.col("u") < share[F.col("lang")]).mapInArrow(scan, "lang string, u double, bits binary").toPandas()
    return some.sort_values(["lang", "u", "bits"]).groupby("lang").head(each)


def _unseen_limits(rows: pd.DataFrame, classes: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that any row has, and for each class the share of buckets that ``ODD`` of its rows stay below when
    the other folds' rows are what is seen."""
    packed = np.array([np.frombuffer(b, np.uint8) for b in rows["bits"]])
    fold = rows.groupby("lang").cumcount().to_numpy() % FOLDS
    folds = np.array([np.bitwise_or.reduce(packed[fold == k], axis=0, initial=0) for k in range(FOLDS)], np.uint8)
    others = np.array([np.bitwise_or.reduce(np.delete(folds, k, axis=0), axis=0) for k in range(FOLDS)])
    rate = np.concatenate([np.bitwise_count(part & ~others[f]).sum(axis=1) / np.bitwise_count(part).sum(axis=1)
                           for low in range(0, len(rows), 256) for part, f in [(packed[low:low + 256], fold[low:low + 256])]])
    lang = rows["lang"].to_numpy()
    limits = [max(np.quantile(rate[lang == c], ODD, method="higher"), LEAST_LIMIT) for c in classes]
    return np.unpackbits(np.bitwise_or.reduce(folds, axis=0)).astype(bool), np.array(limits)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the labelled rows outside the held-out fold (a sample of at most ``SAMPLE`` rows)."""
    rows = _sample(docs, id_col, text_col, lang_col)
    classes = tuple(sorted(set(rows["lang"])))
    if not classes:
        return LanguageModel((), np.zeros((1 << DIM_BITS, 0), np.float32), np.zeros(0), np.zeros(1 << DIM_BITS, bool), np.zeros(0))
    unpack = lambda some: np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in some]), axis=1).astype(np.float32)
    per_class = max(1, LANDMARKS // len(classes))
    marks = unpack(rows.groupby("lang").head(per_class)["bits"])
    marks /= np.sqrt(marks.sum(axis=1, keepdims=True))
    kernel = np.concatenate([(x @ marks.T) / np.sqrt(x.sum(axis=1, keepdims=True))
                             for low in range(0, len(rows), 256) for x in [unpack(rows["bits"].iloc[low:low + 256])]]).astype(np.float64)
    own = (marks @ marks.T).astype(np.float64)
    target = np.where(rows["lang"].to_numpy()[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    offset = target.mean(axis=0)
    ridge = kernel.T @ kernel + RIDGE * len(rows) * own + 1e-8 * len(rows) * np.eye(len(own))
    dual = np.linalg.solve(ridge, kernel.T @ (target - offset))
    return LanguageModel(classes, (marks.T @ dual.astype(np.float32)), offset, *_unseen_limits(rows, classes))


def predict(model: LanguageModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; the text alone decides.

    Texts that are null or have no letter are ``und`` with score 0. score says how well training knows the text's
    n-grams: 1 all, 0.5 as well as the odd texts of the winning class, less for other languages; equal votes go to the
    first class name. Without any learnable row all are ``und``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return small_batches(picked).mapInArrow(scan, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def keep_known(model: LanguageModel, docs: DataFrame, least: float = KEEP_SCORE, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text has letters and scores at least ``least``."""
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = model.predict(batch.column(at).to_pylist())
            yield pc.filter(batch, pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return small_batches(docs).mapInArrow(scan, docs.schema)

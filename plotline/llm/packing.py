"""Packing by concatenate and cut: two-pass prefix sums give every token a global offset, windows are fixed.

Pass 1 tokenises each input partition once and writes the ids with running offsets inside the partition. The
partitions' totals (one row each) are summed up in partition order. Pass 2 adds them and cuts each document where a
window of ``size`` ids ends; only the last sequence can be short, so at most ``size - 1`` positions are padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import materialise, small_batches

SIZE = 1024
END_ID = 0


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: Latin-1's own, the rest from 256 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(spec: str) -> Callable[[str], list[int]]:
    """Text to ids as ``tokenizers`` gives them without special tokens added.

    A byte-level BPE file whose merges are listed in id order is run by ``tiktoken`` (the same ids about four
    times as fast); any other file by ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(spec)

    def by_tokenizers(text: str) -> list[int]:
        return plain.encode(text, add_special_tokens=False).ids

    tree = json.loads(spec)
    model, pre = tree["model"], tree.get("pre_tokenizer") or {}
    byte_level = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                  and pre.get("use_regex", True) and not tree.get("normalizer")
                  and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    if not byte_level:
        return by_tokenizers
    vocab, byte = model["vocab"], _byte_of_char()
    special = {t["content"]: t["id"] for t in tree.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ordered = all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges))
    words = [t for t in vocab if t not in special]
    if not ordered or len(words) != 256 + len(merges) or any(c not in byte for t in words for c in t):
        return by_tokenizers

    import tiktoken
    fast = tiktoken.Encoding(
        "byte-level", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        mergeable_ranks={bytes(byte[c] for c in t): vocab[t] for t in words}, special_tokens=special)

    def by_ranks(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as stopped:  # its regex engine gives up on some huge runs of white space
            if isinstance(stopped, (KeyboardInterrupt, SystemExit)):
                raise
            return by_tokenizers(text)

    return by_ranks


_BUILT: dict[int, Callable[[str], list[int]]] = {}


def _encoder(spec: bytes) -> Callable[[str], list[int]]:
    """Built once per Python worker."""
    key = zlib.crc32(spec)
    if key not in _BUILT:
        _BUILT[key] = encoder(spec.decode())
    return _BUILT[key]


def tokenise(docs: DataFrame, spec: bytes, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, at, doc_id, n, ids): ids as little-endian unsigned 32-bit numbers, ``at`` the offset in partition ``part``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, encode = TaskContext.get().partitionId(), 0, _encoder(spec)
        for batch in batches:
            for low in range(0, len(batch), 256):  # ids are about twice as large as their text
                some = batch.slice(low, 256)
                ids = [np.array(encode(t or "") + [end_id], dtype="<u4") for t in some.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), part, np.int32)), pa.array(starts), some.column(0), pa.array(sizes),
                     pa.array([x.tobytes() for x in ids], pa.binary())], names=["part", "at", "doc_id", "n", "ids"])

    return (small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(scan, f"part int, at long, doc_id {id_type}, n long, ids binary"))


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, tokenizer_path: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents laid end to end and cut every ``size`` ids.

    Columns: doc_id, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens (with the end id), sequence_id, offset (place in the sequence), starts_doc and ends_doc (boundary
    records). Null and empty texts give the end id alone; every input row is a document of its own, also when rows
    or ids repeat or ids are null; an empty table gives no piece. Which documents share a sequence follows the
    order of the input files.
    """
    with open(tokenizer_path or default_tokenizer_path(), "rb") as f:
        spec = f.read()
    tokens = materialise(tokenise(docs, spec, end_id, id_col, text_col), "packing-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # one row for each input partition
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (tokens.join(F.broadcast(totals.select("part", before.alias("before"))), "part")
              .withColumn("first", F.col("before") + F.col("at")))
    cut = (placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(first div {size}, (first + n - 1) div {size})")))
           .withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * size - F.col("first")))
           .withColumn("length", F.least("n", (F.col("sequence_id") + 1) * size - F.col("first")) - F.col("start")))
    return cut.select(
        "doc_id", "start", "length", F.expr("substring(ids, int(start * 4 + 1), int(length * 4))").alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id",
        (F.col("first") + F.col("start") - F.col("sequence_id") * size).alias("offset"),
        (F.col("start") == 0).alias("starts_doc"), (F.col("start") + F.col("length") == F.col("n")).alias("ends_doc"))


def pieces(docs: DataFrame) -> DataFrame:
    """Contract view of ``pack``: the ids as a checksum."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                             "sequence_id", "offset")

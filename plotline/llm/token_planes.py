"""Token-id files in planes: blocks of ids are transposed into byte or bit planes, each compressed with zstandard.

Documents are dealt into ranges of doc_id, sorted and tokenised, and each task writes one file through a Spark data
source ("token_planes"). A file:

* ``MAGIC``; then for every block of ``BLOCK`` ids (the last is shorter) its planes one after the other, lowest first, each a
  zstandard frame; a plane of zeros only is left out. Documents cross block borders.
* the document table (Arrow stream of doc_id and n, one row a document in order), a zstandard frame;
* the chunk index, a zstandard frame of little-endian 64-bit numbers: a row for each block with its place in the file,
  its ids and the size of every plane;
* 4 numbers of 64 bits: sizes of the document table and the index, number of planes, bits a plane (8 or 1); ``MAGIC``.

Files have names that no other attempt uses. Only those of the attempts that Spark commits are named in
``_manifest.json``, in order, with the ids before each of them, so retried tasks and lost executors leave no trace in
what is read. The manifest has one short entry a file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from plotline.llm.common import scratch, small_batches

MAGIC = b"IDPLANE1"
MANIFEST = "_manifest.json"
BLOCK = 1 << 16
END_ID = 1
_LEVEL = 3
_CACHE = 600_000  # pieces of text whose ids a worker remembers
_LONG = 64  # characters; longer pieces are not remembered
_OUT_IDS = 1 << 20  # ids after which the reader hands on its documents


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# ----------------------------------------------------------------------------------------------------------- planes
def to_planes(ids: np.ndarray, bits: int = 8) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first: 4 of one byte an id, or 32 of one bit an id (8 a byte)."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    lanes = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(lanes[:, k]), bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: Sequence[bytes | None], n: int, bits: int = 8) -> np.ndarray:
    """The ids that ``to_planes`` cut up; a plane that is None was zero."""
    if bits == 8:
        rows = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                rows[:, k] = np.frombuffer(plane, np.uint8)
    else:
        lanes = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                lanes[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=n)
        rows = np.packbits(lanes, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4")


# ------------------------------------------------------------------------------------------------------------- files
def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A store that pyarrow knows (file, hdfs, s3, gs) and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FileWriter:
    """One file: ids go in document by document and leave as whole blocks."""

    def __init__(self, out, bits: int, block: int):
        self.out, self.bits, self.block = out, bits, block
        self.zstd = zstandard.ZstdCompressor(level=_LEVEL)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.index: list[int] = []
        self.n_docs = self.n_ids = 0
        self.table = None
        self.sink = pa.BufferOutputStream()
        self.out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, batch: pa.RecordBatch) -> None:
        """A batch (doc_id, n, ids)."""
        docs = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_id", "n"])
        if self.table is None:
            self.table = pa.ipc.new_stream(self.sink, docs.schema)
        self.table.write_batch(docs)
        self.n_docs += len(docs)
        for raw in batch.column(2):
            ids = np.frombuffer(raw.as_buffer(), "<u4")
            self.n_ids += len(ids)
            self.waiting.append(ids)
            self.held += len(ids)
            if self.held >= self.block:
                self._blocks()
        self.waiting = [x.copy() for x in self.waiting]  # what waits does not keep the batch

    def _blocks(self, last: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for low in range(0, stop, self.block):
            some = ids[low:min(low + self.block, stop)]
            sizes, start = [], self.at
            for plane in to_planes(some, self.bits):
                packed = self.zstd.compress(plane) if plane.count(0) < len(plane) else b""
                self.out.write(packed)
                self.at += len(packed)
                sizes.append(len(packed))
            self.index += [start, len(some), *sizes]
        self.waiting = [ids[stop:]]
        self.held = len(ids) - stop

    def close(self) -> None:
        if self.held:
            self._blocks(last=True)
        if self.table is not None:
            self.table.close()
        table = self.zstd.compress(self.sink.getvalue().to_pybytes())
        index = self.zstd.compress(np.array(self.index, "<i8").tobytes())
        self.out.write(table + index + struct.pack("<4q", len(table), len(index), 32 // self.bits, self.bits) + MAGIC)


def read_file(store: fs.FileSystem, path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, n, ids) in the order of the file; a few documents at a time, their ids end to end."""
    zstd = zstandard.ZstdDecompressor()
    with store.open_input_file(path) as f:
        size = f.size()
        tail = 32 + len(MAGIC)
        f.seek(size - tail)
        foot = f.read(tail)
        if foot[32:] != MAGIC:
            raise ValueError(f"{path} is no token-id file, or cut off")
        n_table, n_index, n_planes, bits = struct.unpack("<4q", foot[:32])
        f.seek(size - tail - n_index - n_table)
        rest = f.read(n_table + n_index)
        table = zstd.decompress(rest[:n_table])
        index = np.frombuffer(zstd.decompress(rest[n_table:]), "<i8").reshape(-1, 2 + n_planes)
        if not table:
            return

        def blocks() -> Iterator[np.ndarray]:
            for start, n, *sizes in index.tolist():
                f.seek(start)
                yield from_planes([zstd.decompress(f.read(s)) if s else None for s in sizes], n, bits)

        source, left = blocks(), np.empty(0, "<u4")
        for batch in pa.ipc.open_stream(table):
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            low = 0
            ends = np.cumsum(sizes)
            while low < len(sizes):
                done = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, done + _OUT_IDS, "right")))
                need, have = int(ends[high - 1]) - done, [left]
                held = len(left)
                while held < need:
                    have.append(next(source))
                    held += len(have[-1])
                ids = np.concatenate(have) if len(have) > 1 else left
                left = ids[need:]
                yield batch.column(0).slice(low, high - low), sizes[low:high], ids[:need]
                low = high


# ------------------------------------------------------------------------------------------------------- data source
@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    n_docs: int
    n_ids: int


@dataclass
class _File(InputPartition):
    name: str
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, block: int):
        self.path, self.bits, self.block = path.rstrip("/"), bits, block

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.planes"
        store, folder = _opened(self.path)
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{name}") as out:
            file = FileWriter(out, self.bits, self.block)
            for batch in iterator:
                file.add(batch)
            file.close()
        return _Written(part, name, file.n_docs, file.n_ids)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            if m.n_docs:
                files.append({"name": m.name, "start": start, "n_docs": m.n_docs, "n_ids": m.n_ids})
                start += m.n_ids
        store, folder = _opened(self.path)
        store.create_dir(folder)
        temp = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as out:
            out.write(json.dumps({"files": files, "n_ids": start}).encode())
        store.move(temp, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_type
        self.path, self.id_type = path.rstrip("/"), to_arrow_type(schema["doc_id"].dataType)

    def partitions(self) -> Sequence[InputPartition]:
        store, folder = _opened(self.path)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        return [_File(x["name"], x["start"]) for x in files] or [_File("", 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = _opened(self.path)
        start = partition.start
        for doc_ids, sizes, ids in read_file(store, f"{folder}/{partition.name}"):
            ends = np.cumsum(sizes)
            raw = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([doc_ids.cast(self.id_type), pa.array(start + ends - sizes, pa.int64()),
                                              pa.array(sizes, pa.int64()), raw.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
            start += int(ends[-1])


class TokenPlanes(DataSource):
    """Write (doc_id, n, ids) rows, read (doc_id, start, n_tokens, ids). Options: path, bits (8 or 1), block (ids), and
    for reading id_type (Spark's name of the type of doc_id). A folder holds one table; a new write replaces it."""

    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> str:
        return f"doc_id {self.options.get('id_type', 'long')}, start long, n_tokens long, ids binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("bits", 8)), int(self.options.get("block", BLOCK)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


# ------------------------------------------------------------------------------------------------------------ tokens
class Remembered:
    """Ids of strings in two generations: what is asked for stays when the older half goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def missing(self, new: set[str], asked: Iterable[str]) -> list[str]:
        """Which of ``new``, strings that ``young`` has not, are to be found out; all else of ``asked`` is in ``young`` then."""
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
            again = self.old.keys() & asked
            new = new - again
        else:
            again = self.old.keys() & new
        self.young.update((k, self.old[k]) for k in again)
        return list(new - again)


#: Bytes of white space, printable ASCII and U+00C0 to U+00FF in UTF-8 (where every other character starts with another byte).
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3])


def _plain(text: bytes) -> bool:
    """Whether a text has such characters only, and no start of a special token's mark."""
    return not text.translate(None, _PLAIN) and b"<|" not in text


#: Fixed value: the file's splitting pattern, for lower-case texts of these characters.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def _pieces(text: bytes) -> list[str]:
    """The pieces of a text; a chunk between white space with other characters is one piece, with a space before it."""
    if _plain(text):
        return _PIECE.findall(text.decode().lower())
    parts = text.split()
    if len(parts) == 1:
        return [" " + text.decode()] if parts[0] == text else _pieces(parts[0])
    return [p for c in parts for p in (_PIECE.findall(c.decode().lower()) if _plain(c) else (" " + c.decode(),))]


def encoder(spec: str, end_id: int) -> Callable[[Sequence[bytes | None]], list[bytes]]:
    """Texts to ids (little-endian unsigned 32-bit, the end id last) as ``tokenizers`` gives them.

    If the file's rules never look across ASCII white space, a text's ids are those of its chunks between white space, and
    a plain chunk's are those of the pieces that the file's pattern cuts. The library then encodes each distinct piece (or
    chunk that is not plain) while it is remembered, many to a call; else it encodes whole texts.
    """
    from tokenizers import Tokenizer

    plain, end, tree = Tokenizer.from_str(spec), struct.pack("<I", end_id), json.loads(spec)

    def encoded(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]

    if not _parted_by_space(tree):
        return lambda texts: [x + end for x in encoded([(t or b"").decode() for t in texts])]

    mark = tree["model"]["end_of_word_suffix"]
    ends = np.zeros(max(tree["model"]["vocab"].values()) + 1, bool)
    ends[[i for t, i in tree["model"]["vocab"].items() if t.endswith(mark)]] = True
    seen = Remembered(_CACHE)

    def encode_pieces(new: list[str]) -> list[bytes]:
        """Pieces side by side in one text: each ends with the one id that ends a word."""
        out: list[bytes] = []
        for low in range(0, len(new), 2000):
            some = new[low:low + 2000]
            ids = np.array(plain.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(ends[ids]) + 1
            if len(stops) != len(some):  # no file known does this
                out += encoded(some)
                continue
            raw, cuts = ids.tobytes(), [0, *(stops * 4).tolist()]
            out += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def by_pieces(texts: Sequence[bytes | None]) -> list[bytes]:
        parts = [_pieces(t or b"") for t in texts]
        flat = list(chain.from_iterable(parts))
        ids = list(map(seen.young.get, flat))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            new = seen.missing({flat[i] for i in gaps}, flat)
            odd = [p for p in new if p[0] == " "]
            new = [p for p in new if p[0] != " "]
            known = seen.young
            known.update(zip(odd, encoded(odd)))
            known.update(zip(new, encode_pieces(new)))
            for i in gaps:
                ids[i] = known[flat[i]]
            for p in chain(odd, new):
                if len(p) > _LONG:
                    del known[p]
        stops = list(accumulate(map(len, parts), initial=0))
        return [b"".join(ids[i:j]) + end for i, j in zip(stops, stops[1:])]

    return by_pieces


def _parted_by_space(tree: dict) -> bool:
    """Whether ids of texts are those of their chunks between white space, one after the other.

    True for a normaliser that works character by character, or composes (white space composes with nothing), and a
    splitter that drops all white space because no alternative of its pattern matches any.
    """
    steps = tree.get("normalizer") or {}
    steps = steps.get("normalizers", [steps] if steps else [])
    by_char = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ")
                  for s in steps)
    pre = (tree.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = bool(pre) and pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True \
        and pre[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    rest = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in pre[1:])
    marks = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].split() == [t["content"]]
                for t in tree.get("added_tokens", []))
    return bool(tree["model"].get("end_of_word_suffix")) and by_char and split and rest and marks and tree.get("post_processor") is None and not tree.get("truncation") and not tree.get("padding")


_BUILT: dict[tuple[int, int], Callable[[Sequence[bytes | None]], list[bytes]]] = {}


def _encoder(spec: bytes, end_id: int) -> Callable[[Sequence[bytes | None]], list[bytes]]:
    """Built once per Python worker, with the pieces it has seen."""
    key = (zlib.crc32(spec), end_id)
    if key not in _BUILT:
        _BUILT[key] = encoder(spec.decode(), end_id)
    return _BUILT[key]


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer_path: str | None = None, bits: int = 8, block: int = BLOCK,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all rows of ``docs``, each followed by ``end_id``, to plane files under ``path``.

    Rows go in ascending order of id (nulls first, rows of one id by the hash of their text), also across files. A null
    or empty text is the end id alone; repeated rows are documents of their own; an empty table gives no file.
    """
    with open(tokenizer_path or default_tokenizer_path(), "rb") as f:
        spec = f.read()
    spark = docs.sparkSession
    spark.dataSource.register(TokenPlanes)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(spec, end_id)
        for batch in batches:
            for low in range(0, len(batch), 128):
                some = batch.slice(low, 128)
                ids = encode(some.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                                 names=["doc_id", "n", "ids"])

    rows = (small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            # rows of one id, be they a third of all, are dealt by text and place
            .withColumns({"_h": F.xxhash64("text"), "_i": F.monotonically_increasing_id()})
            .repartitionByRange("doc_id", "_h", "_i").sortWithinPartitions("doc_id", "_h", "_i").select("doc_id", "text"))
    (rows.mapInArrow(scan, f"doc_id {id_type}, n long, ids binary").write.format("token_planes").mode("overwrite")
     .option("path", path).option("bits", str(bits)).option("block", str(block)).save())


def read_ids(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files under ``path``; start counts the ids of all documents before."""
    spark.dataSource.register(TokenPlanes)
    return spark.read.format("token_planes").option("path", path).option("id_type", id_type).load()


def report(docs: DataFrame) -> DataFrame:
    """Contract view: files are written and read back, the ids as a checksum."""
    path = scratch(docs.sparkSession, "token-planes")
    write_ids(docs, path)
    back = read_ids(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

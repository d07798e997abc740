import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plotline.llm import packing

TEXTS = ["Hello world, it's 12 o'clock\n\n  now", None, "", "é über ñandú 漢字 \U0001f600", "a <|endoftext|> b", " " * 30_000 + "x",
         "x" * 20_000, "word " * 4000, "tab\t\t\tend   ", "Hello world, it's 12 o'clock\n\n  now", "1234567890" * 300]


def test_ids_equal_the_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = open(path).read()
    want, got = Tokenizer.from_file(path), packing.encoder(spec)
    assert got.__name__ == "by_ranks"
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in TEXTS + rows:
        assert got(t or "") == want.encode(t or "", add_special_tokens=False).ids
    other = json.loads(spec)
    other["normalizer"] = {"type": "Lowercase"}
    assert packing.encoder(json.dumps(other)).__name__ == "by_tokenizers"


def test_pieces_rebuild_every_document(spark):
    docs = spark.createDataFrame([(i % 10 if i else None, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int").repartition(3)
    tok = Tokenizer.from_file(packing.default_tokenizer_path())
    rows = packing.pack(docs, size=64).collect()
    want = sorted(((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.collect()), key=str)
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    rebuilt, at = [], 0
    for r in rows:  # walked in sequence order, documents come out whole, one after the other
        assert (r.sequence_id, r.offset) == divmod(at, 64) and 0 < r.length <= 64 - r.offset
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        if r.starts_doc:
            assert r.start == 0
            rebuilt.append([r.doc_id, []])
        assert rebuilt[-1][0] == r.doc_id and r.start == len(rebuilt[-1][1])
        rebuilt[-1][1] += ids
        assert r.ends_doc == (len(rebuilt[-1][1]) == r.doc_tokens)
        at += r.length
    assert sorted(((i, tuple(x)) for i, x in rebuilt), key=str) == want


def test_contract_view(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string").coalesce(1)
    got = packing.pieces(docs).orderBy("doc_id").collect()
    tok = Tokenizer.from_file(packing.default_tokenizer_path())
    ids = tok.encode("a b c", add_special_tokens=False).ids + [0]
    assert tuple(got[0]) == (1, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids), 0, 0)
    assert tuple(got[1]) == (2, 0, 1, zlib.crc32(b"\0\0\0\0"), 1, 0, len(ids))
    assert packing.pieces(docs.filter("false")).count() == 0

import json
import random
import zlib

import numpy as np
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from plotline.llm import token_planes
from plotline.llm.common import scratch, settings

TEXTS = ["Hello world, it's 12 o'clock\n\n  now", None, "", "é́ ́x É ΣΣ İ ẞ Å 漢字 \U0001f600", "a <|endoftext|> b<|startoftext|>c", " " * 30_000 + "x",
         "x" * 20_000, "word " * 4000, "tab\t\x0b\x1c  end 's 't'll  ", "1234567890" * 300, "\x00 \x85 ​", "''s 'S don't DON'T'll it's' '' ÀÉÎ×÷ß ÿ_1a2 <b> a<|b <|endoftext|>'s «ª²³¼» é3'd " + "long" * 50 + "'re"]


@pytest.mark.parametrize("bits", [8, 1])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        planes = token_planes.to_planes(ids, bits)
        assert len(planes) == 32 // bits
        assert (token_planes.from_planes(planes, n, bits) == ids).all()
    small = token_planes.to_planes(np.arange(256), bits)
    kept = [p if any(p) else None for p in small]
    assert kept.count(None) == (3 if bits == 8 else 24)
    assert (token_planes.from_planes(kept, 256, bits) == np.arange(256)).all()


def test_ids_equal_the_tokenizer(spark, monkeypatch):
    path = token_planes.default_tokenizer_path()
    spec = open(path).read()
    want = Tokenizer.from_file(path)
    monkeypatch.setattr(token_planes, "_CACHE", 3000)  # the generations change often
    got = token_planes.encoder(spec, 1)
    assert got.__name__ == "by_pieces"
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for low in range(0, len(rows), 20):
        texts = TEXTS + rows[low:low + 20]
        for t, ids in zip(texts, got([t and t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == want.encode(t or "", add_special_tokens=False).ids + [1]
    other = json.loads(spec)
    other["pre_tokenizer"] = None
    whole = token_planes.encoder(json.dumps(other), 1)
    assert whole.__name__ != "by_pieces"
    assert np.frombuffer(whole([b"a b"])[0], "<u4").tolist() == Tokenizer.from_str(json.dumps(other)).encode("a b", add_special_tokens=False).ids + [1]


def table(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["some", "words", "Here,", "and"], k=rng.randint(0, 300)))) for i in rng.sample(range(-50, 400), 200)]
    rows += [(7, t) for t in TEXTS] + [(None, "null id"), (7, "same"), (7, "same")]
    return rows, spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, start int").repartition(6)


@pytest.mark.parametrize("bits, block", [(8, 1 << 16), (1, 1000), (8, 64)])
def test_files_give_back_every_document_in_order(spark, bits, block):
    rows, docs = table(spark)
    path = scratch(spark, "planes-test")
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):  # many files
        token_planes.write_ids(docs, path, bits=bits, block=block)
    got = sorted((tuple(r) for r in token_planes.read_ids(spark, path).collect()), key=lambda r: r[1])
    want = Tokenizer.from_file(token_planes.default_tokenizer_path())
    plain = sorted(((i, tuple(want.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows), key=str)
    assert sorted(((r[0], tuple(np.frombuffer(r[3], "<u4").tolist())) for r in got), key=str) == plain
    at = 0
    for doc_id, start, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
    order = [(r[0] is not None, r[0] or 0) for r in got]
    assert order == sorted(order)
    store, folder = token_planes._opened(path)
    files = json.loads(store.open_input_stream(f"{folder}/{token_planes.MANIFEST}").read())["files"]
    assert sum(f["n_ids"] for f in files) == at and len(files) > 1


def test_only_committed_files_count_and_a_cut_file_is_refused(spark):
    _, docs = table(spark)
    path = scratch(spark, "planes-test")
    token_planes.write_ids(docs, path)
    n = token_planes.read_ids(spark, path).count()
    store, folder = token_planes._opened(path)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".planes")]
    raw = store.open_input_stream(f"{folder}/{names[0]}").read()
    with store.open_output_stream(f"{folder}/ids-left-by-a-lost-task.planes") as out:
        out.write(raw)
    assert token_planes.read_ids(spark, path).count() == n
    with store.open_output_stream(f"{folder}/cut.planes") as out:
        out.write(raw[:-3])
    with pytest.raises(ValueError):
        list(token_planes.read_file(store, f"{folder}/cut.planes"))
    token_planes.write_ids(docs.limit(5), path)  # replaces
    assert token_planes.read_ids(spark, path).count() == 5


def test_contract_view(spark):
    docs = spark.createDataFrame([(2, "a b c"), (1, None)], "doc_id int, text string")
    want = Tokenizer.from_file(token_planes.default_tokenizer_path()).encode("a b c", add_special_tokens=False).ids + [1]
    got = token_planes.report(docs).orderBy("doc_id").collect()
    assert tuple(got[0]) == (1, 0, 1, zlib.crc32(b"\1\0\0\0"))
    assert tuple(got[1]) == (2, 1, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    assert token_planes.report(docs.filter("false")).count() == 0

import hashlib
import random

import pytest

from plotline.llm import suffix_dedup


def brute(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for s in range(len(b) - span + 1):
                w = b[s:s + span]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - span + 1):
                if first[b[s:s + span]] < i:
                    gone[s:s + span] = b"\1" * span
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    alphabet = ["the ", "of ", "x", "é", "nd ", "漢"]
    text = lambda k: "".join(rng.choices(alphabet, k=k))
    passages = [text(k) for k in (20, 22, 25, 30, 60, 200)]
    docs = []
    for _ in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 5)
            parts += [p[cut:len(p) - rng.randint(0, 5)], text(rng.randint(0, 30))]
        docs.append("".join(parts))
    docs += [docs[3], docs[3], "a" * 500, "a" * 49, "a" * 50, "ab" * 300, "b" + "a" * 120, None, "", "short"]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block, gather", [(1 << 20, 1 << 20), (128, 40)])
def test_report_against_brute_force(spark, monkeypatch, seed, block, gather):
    rows = corpus(seed)
    rows += [rows[0], (rows[0][0], rows[5][1]), (None, rows[8][1])]  # repeated row, repeated id, null id
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, place string").repartition(3)
    if block != 1 << 20:  # blocks, gathering and powers are module settings of the tasks: try them in this process
        monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
        suffix_dedup._powers.cache_clear()
        import numpy as np
        for _, t in rows:
            b = (t or "").encode()
            if len(b) < 50:
                continue
            seen = set()
            import pyarrow as pa
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b], pa.binary())], names=["i", "t"])
            for data, ends, row, low in suffix_dedup._blocks(batch):
                _, _, start, count = suffix_dedup.runs(data, ends)
                piece = np.searchsorted(ends, start, side="right")
                begin = start - np.concatenate(([0], ends[:-1]))[piece] + low[piece]
                for s, c in zip(begin.tolist(), count.tolist()):
                    assert not seen & set(range(s, s + c))
                    seen |= set(range(s, s + c))
            assert seen == set(range(len(b) - 49))
        suffix_dedup._powers.cache_clear()
        return
    got = [tuple(r) for r in suffix_dedup.report(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("hot, rows_at_once", [(0, 10_000), (8192, 1), (8192, 7)])
def test_hot_names_and_small_batches(spark, monkeypatch, hot, rows_at_once):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        got = [tuple(r) for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.report(docs).count() == 0

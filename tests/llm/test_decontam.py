import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plotline.llm import decontam


def plain_words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    words, hit, ids = plain_words(text), set(), set()
    for i, t in items:
        w = plain_words(t)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == w[s:s + size]:
                    hit |= set(range(p, p + size))
                    ids.add("" if i is None else str(i))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(4)
    vocab = ["ab", "Cd", "é", "x9", "the", "of"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 30)))) for i in range(12)]
    items += [(10, "ab cd"), (3, "of of of of of of of of of of of"), (None, "lonely words of null"), (77, None), (78, "!!"), (79, "")]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 80))) for _ in range(30)]
    texts += [f"zz, {t}. yy" for _, t in items if t] + [None, "", "--", "q " * 20_000 + (items[0][1] or ""), "of " * 40]
    return items, texts


@pytest.mark.parametrize("slice_bytes", [decontam.SLICE_BYTES, 60])
def test_report_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontam, "SLICE_BYTES", slice_bytes)
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = [tuple(r) for r in decontam.report(docs, bench).collect()]
    want = [(i, *brute(t, items)) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontam.decontaminate(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r, w in zip(rows, want) if not w[-1]), key=str)


def test_empty_tables(spark):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert decontam.report(docs.filter("false"), bench).count() == 0
    none = decontam.report(docs, bench.filter(F.lit(False)))
    assert none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == len(texts)

"""run() against the stages' brute-force versions, one after the other, on a small corpus."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plotline.llm import langid, packing, simhash
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_line_dedup import components
from tests.llm.test_simhash import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 45 and n_chars < 3000")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()]
    rows = [tuple(r) for r in docs.collect()]
    for k, (_, text, lang, source, n) in enumerate(rows[:12]):
        words = text.split(" ")
        words[rng.randrange(len(words))] = "altered"
        near = " ".join(words)
        rows += [(100 + k, text, lang, source, n), (200 + k, near, lang, source, len(near))]
    quoted = f"before the passage {items[0][1]} and after it"
    rows += [(300, quoted, "en", "s", len(quoted)), (301, None, None, "s", None), (302, "", "en", "s", 0), (303, "12 -- 7", "en", "s", 7)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_run_against_brute_force(spark, corpus):
    folder, items = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    docs = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda r: r[0])
    model = langid.fit(table)
    names, scores = model.predict([t for _, t in docs])
    docs = [d for d, n, s in zip(docs, names, scores) if n != "und" and s >= langid.KEEP_SCORE]
    assert {301, 302, 303}.isdisjoint(i for i, _ in docs) and len(docs) > 50

    spots = [(i, k, x) for i, t in docs for k, x in enumerate(t.split("\n")) if x.strip()]
    roots = components([x for *_, x in spots])
    lost = {spots[k][:2] for k, r in enumerate(roots) if r != k}
    docs = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in lost)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t.strip()]

    fps = [simhash.fingerprint(t.encode(), 4) for _, t in docs]
    classes, seen, kept = brute_classes(set(fps), 4), set(), []
    for d, f in zip(docs, fps):  # in id order
        if classes[f] not in seen:
            seen.add(classes[f])
            kept.append(d)
    docs = [(i, t) for i, t in kept if not brute_hits(t, items)[-1]]
    assert 300 not in {i for i, _ in docs} and len(docs) > 20

    tok = Tokenizer.from_file(packing.default_tokenizer_path())
    want = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in docs}
    rows = corpus_pipeline.run(spark, folder).collect()
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at, got = 0, {}
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(at, 1024) and r.doc_tokens == len(want[r.doc_id])
        part = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        at += r.length
    assert got == {i: len(x) for i, x in want.items()}


def test_stages_keep_the_columns_of_documents(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert out.filter("n_chars <> length(text)").count() == 0
        assert stage(spark, docs.filter(F.lit(False)), folder).count() == 0

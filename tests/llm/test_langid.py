import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def plain_grams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    return {low[i:i + n] for n in range(1, langid.MAX_N + 1) for i in range(len(low) - n + 1)}


def test_presence_bits_follow_distinct_grams():
    row = np.zeros(1 << langid.DIM_BITS, bool)
    text = "Où est-ce?  Là 12 là."
    assert langid.mark_grams(text, row)
    assert 0 < row.sum() <= len(plain_grams(text)) and row.sum() >= len(plain_grams(text)) - 2
    twice = np.zeros_like(row)
    langid.mark_grams(text + text, twice)
    assert (twice & row).sum() == row.sum()
    for t in (None, "", "12 -- 7"):
        assert not langid.mark_grams(t, np.zeros_like(row))


def test_held_out_accuracy_and_kept_rows(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict(model, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    crc = {r.doc_id: r.h for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h")).collect()}
    assert all(crc[r.doc_id] == r.held_out for r in got)
    assert langid.keep_known(model, docs).count() >= 0.999 * docs.count()


def test_only_the_text_decides_and_held_out_labels_are_not_read(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("lang", F.lit("xx")).withColumn("score", F.lit("clash"))
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(model, docs).collect()}
    two = {r.doc_id - 10_000: (r.lang_pred, r.score) for r in langid.predict(model, moved).collect()}
    assert one == two
    table = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = table.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again = langid.fit(wrong)
    assert again.classes == model.classes and np.array_equal(again.weights, model.weights)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "the and of in"), (4, "é" * 200_000), (4, "the and of in")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = langid.predict(model, docs).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in model.classes for r in got if r.doc_id in (None, 4))
    assert langid.predict(model, docs.filter("false")).count() == 0
    unlabelled = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(unlabelled, docs).collect()} == {"und"}
    single = langid.fit(docs.filter("doc_id = 1 or doc_id = 4").withColumn("lang", F.lit("fr")))
    assert {r.lang_pred for r in langid.predict(single, docs.filter("doc_id = 4")).collect()} <= {"fr", "und"}


@pytest.mark.parametrize("left_out", [("de",), ("es",), ("fr",), ("en",), ("de", "es", "fr")])
def test_texts_of_a_language_not_learned_go(spark, left_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part = langid.fit(docs.filter(~F.col("lang").isin(*left_out)))
    kept = {r.doc_id for r in langid.keep_known(part, docs).select("doc_id").collect()}
    rows = docs.withColumn("held", langid.held_out()).select("doc_id", "lang", "held").collect()
    out = [r.doc_id in kept for r in rows if r.lang in left_out]
    own = [r.doc_id in kept for r in rows if r.held and r.lang not in left_out]
    assert len(out) > 50 and len(own) > 20
    assert sum(out) <= 0.1 * len(out)
    assert sum(own) >= 0.98 * len(own)


def test_other_scripts_go_and_short_texts_stay(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(langid.held_out())
    short = [(r.doc_id, " ".join(r.text.split()[:3])) for r in docs.collect()]
    short = [(i, t) for i, t in short if any(c.isalpha() for c in t)]
    other = [(-1, "Все счастливые семьи похожи друг на друга"), (-2, "人人生而自由在尊严和权利上一律平等"), (-3, "όλοι"),
             (-4, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności")]
    table = spark.createDataFrame(short + other, "doc_id long, text string")
    kept = {r.doc_id for r in langid.keep_known(model, table).collect()}
    assert kept.isdisjoint({-1, -2, -3, -4})
    assert len(kept) >= 0.98 * len(short)


def test_votes_against_a_plain_kernel(spark, monkeypatch):
    """Presence kernel, landmarks and ridge over Python sets, on 40 texts."""
    monkeypatch.setattr(langid, "LANDMARKS", 12)
    rng = random.Random(5)
    words = {"aa": ["dos", "que", "año", "los", "mente"], "bb": ["the", "and", "of", "thing", "ver"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 25))) + " 12!", lang) for i in range(60) for lang in words][:54]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, model = langid._sample(docs, "doc_id", "text", "lang"), langid.fit(docs)
    assert 30 <= len(sample) <= 54

    def grams(text):
        chars = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        found = set()
        for n in range(1, langid.MAX_N + 1):
            for i in range(len(chars) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 + chars[i + k] + k + 1) % 2**32
                found.add(h * 0x9E3779B1 % 2**32 >> (32 - langid.DIM_BITS))
        return found

    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    sets = [set(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))).tolist()) for b in sample["bits"]]
    assert {frozenset(x) for x in sets} <= {frozenset(grams(t)) for _, t, _ in rows}
    marks = [s for lang in model.classes for s in [x for x, own in zip(sets, sample["lang"]) if own == lang][:6]]
    big = np.array([[kernel(a, b) for b in marks] for a in sets])
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    target = np.array([[1.0 if lang == c else -1.0 for c in model.classes] for lang in sample["lang"]])
    offset = target.mean(axis=0)
    dual = np.linalg.solve(big.T @ big + langid.RIDGE * len(sets) * own + 1e-8 * len(sets) * np.eye(len(own)), big.T @ (target - offset))
    for text in ("the thing and año", "quemente", "zzz", "x " + "of the " * 50):
        want = np.array([kernel(grams(text), m) for m in marks]) @ dual + offset
        row = np.zeros(1 << langid.DIM_BITS, bool)
        langid.mark_grams(text, row)
        assert set(np.flatnonzero(row).tolist()) == grams(text)
        got = row.astype(np.float32) @ model.weights / np.sqrt(row.sum()) + model.offset
        assert np.abs(got - want).max() < 1e-4
        assert model.predict([text])[0] == [model.classes[int(want.argmax())]]

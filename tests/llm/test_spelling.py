import random
import re
import zlib
from collections import Counter

import pytest

from plotline.llm import spelling


def counted(rows, least=7, count=2, drop=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop and h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows):
    n = counted(rows)
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, n[w], len(close)]
    rows = []
    for w, (form, c, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, c, k, n[form] if form else None))
    return sorted(rows)


def corpus(seed, docs=300):
    rng = random.Random(seed)
    parts = ["tion", "ing", "ver", "ét", "an", "schei", "×÷", "be", "dr", "ao", "aaa"]
    stems = ["".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(60)]
    weights = [1 / (k + 1) ** 1.5 for k in range(60)]

    def word():
        w = rng.choices(stems, weights)[0]
        if rng.random() < 0.1:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + "q" + w[k + 1:], w.upper(), w.capitalize()])
        return w

    rows = [(i, " ".join(word() + rng.choice(["", ",", "1", "’s", "中"]) for _ in range(rng.randint(0, 200)))) for i in range(docs)]
    return rows + [(None, "nothing nothing nothinng"), (7, None), (8, ""), (9, "a" * 40_000), (10, "a" * 40_000 + " " + "a" * 40_001 + " " + "a" * 40_001),
                   (11, "b7b ĀlettersĀ letters nothing"), (12, "same text twice"), (12, "same text twice")]


@pytest.mark.parametrize("limits", [{}, {"LIST": 3, "LARGE": 5}, {"_PAIRS": 7}])
def test_against_brute_force(spark, limits, monkeypatch):
    for name, value in limits.items():  # other decompositions, long lists, small steps: the same rows
        monkeypatch.setattr(spelling, name, value)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(tuple(r) for r in spelling.variants(docs, drop_one_in=31).collect())
    want = expected(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] for r in want if r[1])


def test_an_edit_leaves_the_bounded_number_of_grams():
    rng = random.Random(5)
    frequent = {"".join(rng.choices("abc", k=rng.randint(3, 6))): 1 for _ in range(300)}
    for _ in range(2000):
        w = "".join(rng.choices("abc", k=rng.randint(7, 14)))
        k = rng.randrange(len(w))
        other = rng.choice([w[:k] + "z" + w[k + 1:], w[:k] + rng.choice("abc") + w[k:], w + "a"])
        longest = spelling.longest_gram(len(w))
        mine, theirs = (spelling.decompose(x, longest, frequent) for x in (w, other))
        shift = len(other) - len(w)
        kept = [(p, g) for p, g in mine if (p, g) in theirs or (p + shift, g) in theirs]
        assert len(kept) >= len(mine) - spelling.affected(mine, len(w)) >= 1
        assert len(theirs) - spelling.affected(theirs, len(other)) >= 1


def test_one_edit_against_its_definition():
    rng = random.Random(6)
    for _ in range(5000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == near(a, b)


def test_followed_forms_empty_table_and_limits(spark):
    chain = [("wordsab", 10_000), ("wordsabc", 1000), ("wordsabcd", 100), ("wordsabcde", 10)]
    docs = spark.createDataFrame([(1, " ".join(f"{w} " * n for w, n in chain))], "doc_id int, text string")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got["wordsabcde"] == ("wordsabcd", "wordsab", 1, 100)
    assert got["wordsabc"] == ("wordsab", "wordsab", 2, 10_000) and got["wordsab"] == (None, "wordsab", 1, None)
    assert spelling.variants(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, min_length=5)

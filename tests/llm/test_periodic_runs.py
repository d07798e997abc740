import hashlib
import random
import zlib

import numpy as np
import pytest

from plotline.llm import periodic_runs


def brute(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        same = [x == y for x, y in zip(words, words[q:])]
        while True in same[i:]:
            i = j = same.index(True, i)
            while j < n - q and words[j] == words[j + q]:
                j += 1
            stretch = words[i:j + q]
            smallest = not any(all(stretch[k] == stretch[k + p] for k in range(len(stretch) - p)) for p in range(1, q))
            if len(stretch) >= max(least, times * q) and smallest:
                out.append((i, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(rng):
    """Words with runs of many periods, runs inside runs, and units that hold grams twice."""
    words = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        if kind < 0.3:
            words += rng.choices("abcdefgh", k=rng.randint(0, 40))
        elif kind < 0.8:
            unit = rng.choices("ab" if rng.random() < 0.5 else "abcdefghijkl", k=rng.randint(1, 45))
            words += (unit * 9)[:rng.randint(1, 6 * len(unit))]
        else:
            u = rng.choices("xyz", k=rng.randint(10, 22))
            unit = u + ["1"] + u + ["2"] + u[:rng.randint(1, 10)]
            words += (unit * 5)[:rng.randint(2 * len(unit), 5 * len(unit))]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (2, 3), (9, 4), (40, 3)])
def test_runs_against_brute_force(least, times):
    rng = random.Random(least)
    seen = 0
    for _ in range(30):
        words = sample(rng)
        number = {w: k for k, w in enumerate(sorted(set(words)))}
        got = periodic_runs.runs_of(np.array([number[w] for w in words], np.int64), least, times)
        assert got == brute(words, least, times)
        seen += len(got)
    assert seen > 15


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and best[1] * 1000 // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_contract_view_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(sample(rng))) for i in range(80)]
    rows += [(None, "a " * 30), (200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "é b   " * 40), (205, "x\x0by\x1fz " * 30),
             (3, "w " * 900), (3, "w " * 900), (10**12, " ".join(map(str, range(900))))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, length string").repartition(4)
    got = sorted((tuple(r) for r in periodic_runs.report(docs).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 1 for r in got) > 8
    assert periodic_runs.report(docs.filter("false")).count() == 0


def test_long_document_and_general_view(spark):
    words = [f"w{k}" for k in range(40_000)] + ["a", "b"] * 60_000 + [f"v{k % 30_000}" for k in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
    row = periodic_runs.find_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(40_000, 120_000, 2), (160_000, 100_000, 30_000)]
    assert row.n_words == 260_000 and row.collapsed == " ".join(words[:40_002] + words[160_000:190_000])

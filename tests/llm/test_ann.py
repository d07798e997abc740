import math
import random

import numpy as np
import pytest

from plotline.llm import ann


def brute(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in rows:
        if q % every == 0:
            s = (x * np.array(v, float)).sum(axis=1)
            s[ids == q] = -np.inf
            order = np.lexsort((ids, -s))[:min(k, len(rows) - 1)]
            out[q] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def test_recall_and_scores_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    want, got = brute(rows), {}
    by_id = dict(rows)
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert math.isclose(r.score, math.fsum(a * b for a, b in zip(by_id[r.query_id], by_id[r.vec_id])), rel_tol=1e-12, abs_tol=1e-12)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("n", [1, 2, 15, 400])
def test_small_and_tied_tables_are_exact_in_size(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([0.5, -1.0, 2.0]) for _ in range(3)]) for i in range(n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items() if v}
    if n <= 20:
        assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_a_hot_vector_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [3.0] * 8) for i in range(300)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    hot = [q for q in want if q >= 1000]
    for q in hot:  # all ties: the smallest ids
        assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want[q]]


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(30)]
    odd = [(40, None), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]),
           (140, [1.0]), (160, []), (None, [1.0, 1.0]), (0, [0.0, 1.0])]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").selectExpr("*", "'x' as score", "1 as leaf")
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(good)
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == want
    assert ann.search(table.filter("vec_id is null")).count() == 0

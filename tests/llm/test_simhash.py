import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plotline.llm import simhash
from plotline.llm.components import connected_components


def brute_classes(fps, radius):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in keys}


def test_fingerprint_against_plain_majority():
    text = "The quick\tbrown Fox\x0bjumps É over the lazy dog the quick brown fox"
    words = "the quick brown fox jumps É over the lazy dog the quick brown fox".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 4) == want
    assert simhash.fingerprint(b"one two", 4) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(b" \n", 4) == 0 == simhash.fingerprint(None, 4)


@pytest.mark.parametrize("block", [4096, 16])
def test_links_span_the_brute_force_classes(spark, block):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:  # chains of near copies, and one dense group
        for _ in range(5):
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.similar_fingerprints(table, 4, block=block)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in links.collect())
    roots = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    got, want = {}, {}
    for f, r in brute_classes([x for x in signed], 4).items():
        want.setdefault(r, set()).add(f)
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def distinct_in_one_group(n):
    """Fingerprints of equal high halves: one pigeonhole group holds them all."""
    rng = np.random.default_rng(n)
    low = np.unique(rng.integers(0, 1 << 32, 2 * n, dtype=np.uint64))
    return rng.permutation(low)[:n] | np.uint64(0xABCD0123 << 32)


def brute_partition(fps, links=None):
    """Classes as a set of frozen sets, from all pairs within 4 bits or from the links given."""
    if links is None:
        links = [(int(fps[i]), int(fps[j])) for i in range(len(fps))
                 for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 4)]
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    classes = {}
    for f in parent:
        classes.setdefault(root(f), set()).add(f)
    return set(map(frozenset, classes.values()))


@pytest.mark.parametrize("n", [191, 193, 300, 4096])
def test_one_long_run_against_brute_force(n):
    fps = distinct_in_one_group(n)
    fps[-n // 4:] = fps[:-(-n // 4)] ^ np.uint64(0b1001)  # partners far apart
    found = simhash.links_in_runs(fps, np.array([n - 3, 3]), 4).view(np.uint64)
    assert (np.bitwise_count(found[:, 0] ^ found[:, 1]) <= 4).all()
    links = [tuple(map(int, r)) for r in found]
    assert brute_partition(fps[:n - 3], [x for x in links if x[0] in set(fps[:n - 3].tolist())]) == brute_partition(fps[:n - 3])


@pytest.mark.parametrize("n", [300, 5_000, 10_000])
def test_large_group_in_blocks_of_the_default_size(spark, n):
    fps = distinct_in_one_group(n)
    fps[-n // 4:] = fps[:-(-n // 4)] ^ np.uint64(0b1001)
    fps = np.unique(fps)
    table = spark.createDataFrame([(f,) for f in fps.view("<i8").tolist()], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.similar_fingerprints(table, 4).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want = brute_partition(fps)
    assert len(want) < len(fps)
    assert brute_partition(fps, links) == want


def test_links_between_blocks_against_brute_force():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    two = np.concatenate([one[:30] ^ np.uint64(5), rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
    found = {tuple(sorted(map(int, r))) for r in simhash.links_between(one, two, 4).view(np.uint64)}
    want = {tuple(sorted((int(a), int(b)))) for a in one for b in two if bin(int(a) ^ int(b)).count("1") <= 4}
    assert found == want


def test_classes_over_a_table_with_odd_rows(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(50)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(60)]
    texts += [t + " extra" for t in texts[:20]] + texts[:5] + [None, "", "  ", "x " * 30_000]
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)] + [(3, texts[3], "clash", None), (None, "solo words here", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, component_id string")
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fp_of = {t: simhash.fingerprint(None if t is None else t.encode(), 4) for _, t, *_ in rows}
    classes = brute_classes(set(fp_of.values()), 4)
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            r = classes[fp_of[t]]
            least[r] = min(least.get(r, i), i)
    want = [(i, fp_of[t] - (1 << 64) if fp_of[t] >> 63 else fp_of[t], least.get(classes[fp_of[t]])) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    kept = [(r.doc_id, classes[fp_of[r.text]]) for r in one.collect()]
    assert sorted(kept, key=str) == sorted(((least.get(r), r) for r in set(classes.values())), key=str)
    empty = simhash.class_table(docs.filter("false"))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}
    assert connected_components(edges.filter(F.lit(False)), "a", "b").count() == 0

import collections

import pytest

from plotline.llm import sharding


def brute_table(shards, slots):
    """Every shard's whole permutation, then claims in turn."""
    pref = []
    for name in shards:
        off, skip = sharding._hash(f"{name}/offset") % slots, sharding._hash(f"{name}/skip") % (slots - 1) + 1
        pref.append([(off + j * skip) % slots for j in range(slots)])
        assert sorted(pref[-1]) == list(range(slots))
    owner = {}
    while len(owner) < slots:
        for k in range(len(shards)):
            if len(owner) < slots:
                owner[next(s for s in pref[k] if s not in owner)] = k
    return [owner[s] for s in range(slots)]


def test_table_against_brute_force_and_balance():
    names = sharding.shard_names(7)
    assert sharding.lookup_table(names, 101) == brute_table(names, 101)
    counts = collections.Counter(sharding.lookup_table(sharding.shard_names()))
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == sharding.SHARDS
    assert sharding.lookup_table(["one"], 5) == [0] * 5
    for bad in ([], ["a"] * 8):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_few_slots_move_when_a_shard_goes():
    names = sharding.shard_names()
    before, after = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(before, after))
    assert moved <= 0.1 * len(before)


def test_rows(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, shard string")
    got = sharding.place(docs, sharding.shard_names()).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id == 1}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    owner = sharding.lookup_table(sharding.shard_names())
    for r in got:
        slot = sharding._hash("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.shard_names()[owner[slot]])
    assert sharding.place(docs.filter("false"), ["x"], 11).count() == 0

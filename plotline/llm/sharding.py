"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of a prime number of slots. Shards take turns; each claims the next free slot of
its permutation, until all slots are taken. A row's shard is the table's entry for the hash of its key, a
constant-time lookup in a broadcast table; when a shard is added or removed, few slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 8191  # prime, over a hundred slots a shard
_DIGITS = 13  # hex digits of md5 that make a hash: 52 bits


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot; ``slots`` is a prime larger than the number of shards."""
    if not shards or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, and shards at least one and at most as many as slots")
    at = [_hash(f"{name}/offset") % slots for name in shards]
    skip = [_hash(f"{name}/skip") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: its text's md5, modulo the slots. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, shards: list[str], slots: int = SLOTS, key_col: str = "doc_id") -> DataFrame:
    """(key_col, slot, shard) for every row; rows with equal keys share a shard, null keys share one too.

    The table has ``slots`` rows (a parameter, not a matter of the data), so it is broadcast.
    """
    table = rows.sparkSession.createDataFrame(
        [(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot int, shard string")
    keyed = rows.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key_col, "slot", "shard")


def oracle() -> str:
    """DuckDB twin for the documents table; the slot owners are given, as their filling is sequential."""
    owners = ",".join(map(str, lookup_table(shard_names())))
    digits = f"substr(md5(coalesce(cast(doc_id as varchar), '')), 1, {_DIGITS})"
    value = " + ".join(f"(instr('0123456789abcdef', substr(h, {i + 1}, 1)) - 1)::bigint * {16 ** (_DIGITS - 1 - i)}" for i in range(_DIGITS))
    return f"""
with hashed as (select doc_id, {digits} as h from documents),
slotted as (select doc_id, cast(({value}) % {SLOTS} as integer) as slot from hashed),
owners as (select [{owners}] as o)
select doc_id, slot, 'shard-' || lpad(cast(o[slot + 1] as varchar), 4, '0') as shard from slotted, owners"""

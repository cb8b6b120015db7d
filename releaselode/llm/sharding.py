"""Permutation-filled lookup table: constant-time, even and stable placement of keys on shards.

Each shard has a preference order over the slots of a table whose size is prime: offset, offset + skip, ... modulo the
size. The shards take turns; each claims its next free slot, until all slots are taken. A key goes to the shard of
slot (hash modulo size). The table has a fixed size that doesn't depend on the data, so it travels as a literal.

Null keys: hashed as the empty string. Repeated keys: the same shard. Empty table: no row. Texts, however long, are not read. Other
columns are kept, but `slot` and `shard` are replaced."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard's index for each slot."""
    if not shards or not is_prime(size) or size < len(shards):
        raise ValueError("shards must not be empty; the size must be prime and no smaller than their number")
    offset = [_hash(f"{s}/offset") % size for s in shards]
    skip = [_hash(f"{s}/skip") % (size - 1) + 1 if size > 1 else 1 for s in shards]
    table, turn, left = [-1] * size, [0] * len(shards), size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while table[slot := (offset[i] + turn[i] * skip[i]) % size] >= 0:
                turn[i] += 1
            table[slot] = i
            turn[i] += 1
            left -= 1
    return table


def slot_of(key: Column, size: int) -> Column:
    """First 32 bits of the key's MD5, modulo the size."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(size).cast("long"))


def place(df: DataFrame, key: str, shards: list[str], size: int = 8191, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """df with the slot and the shard's name of each row; columns of these names are replaced."""
    names = F.array(*(F.lit(s) for s in shards))
    # one constant, folded from a string: a list of thousands of literals would be slow to plan
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    slot = slot_of(df[key], size)
    return df.withColumns({slot_name: slot}).withColumns({shard_name: F.element_at(names, F.element_at(table, F.col(slot_name).cast("int") + 1) + 1)})


def moved(before: list[int], after: list[int]) -> float:
    """The part of the slots whose shard differs."""
    return sum(a != b for a, b in zip(before, after, strict=True)) / len(before)

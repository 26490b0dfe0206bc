"""Consistent placement by a permutation-filled lookup table; DataFrame functions only."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(name: str) -> int:
    """The first 60 bits of the name's MD5."""
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = 10007) -> list[int]:
    """For each slot the index of the shard that owns it.

    Each shard prefers the slots offset, offset + skip, offset + 2 skip ... modulo the prime ``size``: a permutation
    of its own. The shards take turns, and at its turn a shard claims the first free slot it prefers. So shards own
    equally many slots to within one, and taking a shard away moves few slots of the others. The table's size is a
    parameter and doesn't follow the data.
    """
    if size < 3 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be named, apart, and no more than slots")
    at = [number(f"{s}:offset") % size for s in shards]
    skip = [number(f"{s}:skip") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    free = size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot(key: Column, size: int) -> Column:
    """The key's slot; a null key has a slot of its own name."""
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], size: int = 10007) -> DataFrame:
    """rows with slot (int) and shard (string): the lookup table is broadcast, and each row finds its slot there.

    Every row is placed, null and repeated keys and empty tables included; equal keys go to the same shard, so place
    by a key that is nearly unique. No shuffle: the table has ``size`` rows whatever the data. ``slot`` and ``shard``
    replace columns of these names.
    """
    spark = rows.sparkSession
    table = [shards[k] for k in lookup_table(shards, size)]
    lookup = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(table)), "array<string>")).alias("_slot", "shard"))
    rows = rows.drop("shard").withColumn("slot", slot(F.col(key), size))
    return rows.join(F.broadcast(lookup), F.col("slot") == F.col("_slot")).drop("_slot")

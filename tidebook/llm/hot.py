"""Comparing all rows of a key with each other when some keys are very common."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.cluster import cut

#: Keys that a broadcast may hold.
BROADCAST = 20_000


def in_bounded_groups(rows: DataFrame, key: list[str], within: str, most: int, weight: Column | None = None) -> DataFrame:
    """rows with columns ``part`` and ``of`` such that any two rows of a key meet in a group (key, part) of bounded size.

    A key of at most ``most`` rows (or of that ``weight``) is one group, part 0. The rows of a larger one are dealt by the hash of ``within``
    into chunks of about half that, and each pair of chunks is a group: a row is copied once per chunk of its own key
    only. Nothing is dropped, and each two rows of different chunks meet exactly once. Keys are counted with partial
    sums before the shuffle; the larger ones (at most rows / most of them) are counted in turn, and joined back: by
    broadcast if they are BROADCAST or fewer, else by a shuffle. Without any, the rows need no join.
    """
    counts = rows.groupBy(*key).agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).where(F.col("n") > most)
    counts = cut(counts.select(*(F.col(k).alias(f"_{k}") for k in key), F.ceil(F.col("n") * 2 / most).cast("int").alias("of")))
    common = counts.count()
    if not common:
        return rows.withColumn("chunk", F.lit(0)).withColumn("part", F.lit(0).cast("long"))
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    out = rows.join(F.broadcast(counts) if common <= BROADCAST else counts, same, "left").drop(*(f"_{k}" for k in key))
    out = out.withColumn("chunk", F.when(F.col("of").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(within, F.lit(17)), F.col("of")).cast("int")))
    other = F.explode(F.when(F.col("of").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("of") - 1)))
    out = out.withColumn("other", other)
    out = out.withColumn("part", F.least("chunk", "other").cast("long") * F.lit(1 << 31) + F.greatest("chunk", "other"))
    return out.drop("of", "other")


def dealt_join(rows: DataFrame, values: DataFrame, key: list[str], within: str | Column, common: DataFrame, most: int, how: str = "inner") -> DataFrame:
    """rows joined to values, of which there is one per key; keys are never null.

    common(key, rows) holds the keys of more than ``most`` rows, of which there are at most rows / most. Their rows are
    dealt by the hash of ``within`` into parts of about that, and their value is copied to each part.
    """
    common = cut(common.select(*(F.col(k).alias(f"_{k}") for k in key), F.ceil(F.col("rows") / most).cast("int").alias("_of")))
    count = common.count()
    if not count:
        return rows.join(values, key, how)
    common = F.broadcast(common) if count <= BROADCAST else common
    same = lambda df: [df[k] == F.col(f"_{k}") for k in key]
    marked = lambda df: df.join(common, same(df), "left").drop(*(f"_{k}" for k in key))
    left = marked(rows.withColumn("_w", F.xxhash64(within))).withColumn("_part", F.coalesce(F.pmod("_w", F.col("_of")), F.lit(0)).cast("int")).drop("_of", "_w")
    right = marked(values).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_of"), F.lit(1)) - 1))).drop("_of")
    return left.join(right, [*key, "_part"], how).drop("_part")


class Forest:
    """Union of numbered items, many links at a time; memory follows the items, not the links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if (up == root).all():
                return root
            root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))

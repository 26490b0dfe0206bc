"""What the operators share of Spark: cutting lineage in the shared folder, and connected components."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.plans.session import cut

__all__ = ["components", "cut", "release"]


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to any more, before the next step writes its own.

    Checkpoints stay until the folder is emptied, or Spark drops them too where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    for pause in (1.0, 0.5, 0.0):  # threads that end a little later hold on to what they ran
        collect(spark)
        time.sleep(pause)


def collect(spark: SparkSession) -> None:
    """One collection on both sides of the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for each node of links(a, b), both long: component is the smallest node reachable.

    Alternating large-star and small-star rounds: each turns every node's neighbours towards the smallest one it
    sees, so the links end as stars after about the square of the logarithm of the longest chain. A round aggregates
    a minimum per node (combined before the shuffle) and joins it back; no node's neighbours are gathered.
    Links with a null or equal ends are left out; no links give no rows.
    """
    spark = links.sparkSession
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, both.a == low.n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: links now point from a to a smaller b
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        turned = large.join(low, large.a == low.n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(turned.union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
        collect(spark)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

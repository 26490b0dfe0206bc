"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.cluster import cut

WORD = r"[^\x20\x09-\x0D]+"


def offset(source: Column, seed: str) -> Column:
    """The source's random offset: a whole number of 0 to 2 ** 40 - 1, the same on each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))), 1, 10), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, weight, target.

    Sources by code point, null last, weigh ``weights`` in turn. They share the total by weight; none gets more than
    ``most`` times its size, and what is over goes to the others by weight, until none is above. That ends at one
    level for a unit of weight: with sources ordered by size / weight, the level that follows from taking the first k
    as full rises with k until the next one fits and falls from there, so the final level is the largest of these.
    There is a row per source here, so windows over all rows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / weight.cast("double"))
    rows = rows.withColumn("level", F.max("level").over(every))
    full = (most * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", "weight", F.least(F.col("level") * F.col("weight"), full).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(source, text, ...) -> keep, size, source, source_size, target, copies, taken.

    A source's documents in the order (size, then keep) each expect target / source_size copies. The expected
    copies are summed up along that order, one random offset is added, and a document is taken once for each whole
    number that its own part crosses, so each gets the whole number below or above what it expects, and runs of
    documents of like size get their share. All of this is whole-number arithmetic in units of 2 ** -40 copies:
    reruns agree whatever the partitions. The place in the order comes from a range partitioning and the row's
    place in its partition: no source is gathered in one task.

    A null or empty text has size 0; documents of an all-empty source are not taken. A null source is a source of its
    own, the last. Repeated rows count one by one. An empty table gives no rows. Columns not named are not read.
    """
    # sizes are counted once: the ranges are sampled from what is written
    rows = cut(docs.select(*keep, F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), *(F.col(k).asc_nulls_last() for k in keep)]
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at") - F.shiftleft("part", 33))
    # a row per partition and source: how many of the source come before
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("place").alias("first"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n") - F.col("first"))
    shares = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    # target / source_size copies, in units of 2 ** -40
    shares = shares.withColumn("step", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.lit(2.0**40)).cast("long"), F.lit(most << 40))).otherwise(F.lit(0)).cast("decimal(20,0)"))
    shares = shares.select(F.col("source").alias("s"), "source_size", "target", "step", offset(F.col("source"), seed).cast("decimal(20,0)").alias("offset"))
    place = counts.select(F.col("source").alias("c"), F.col("part").alias("p"), "before").join(shares, F.col("c").eqNullSafe(F.col("s")))
    rows = rows.join(place, F.col("source").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    crossed = lambda i: F.expr(f"cast((({i}) * step + offset) div {2**40} as bigint)")
    rows = rows.withColumn("copies", crossed("before + place + 1") - crossed("before + place"))
    return rows.select(*keep, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

"""Partitioned storage, exports, upserts, and the cache of queried intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.plans.session import cut


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_partition(spark: SparkSession, path: str, exchange: str, pair: str, day: str, dry_run: bool = True) -> str | None:
    """The folder of a day of an exchange and pair, if there is one; it is deleted unless this is a dry run."""
    folder = f"{path}/exchange={exchange}/pair={pair}/dt={day}"
    if not exists(spark, folder):
        return None
    if not dry_run:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return folder


def delete_era(spark: SparkSession, path: str, exchange: str, pair: str, era: Column, next_era: Column | None = None) -> None:
    """Deletes a venue's rows of [era, next_era) from a partitioned store: days that lie within go, the days at its ends are written anew."""
    rows = spark.read.parquet(path).where((F.col("exchange") == exchange) & (F.col("pair") == pair) & (F.col("dt") >= F.to_date(era)))
    rows = rows if next_era is None else rows.where(F.col("dt") <= F.to_date(next_era))
    mine = (F.col("ts") >= era) & (F.lit(True) if next_era is None else F.col("ts") < next_era)
    kept = cut(rows.where(~mine).drop("dt"))
    days = [r.dt.isoformat() for r in rows.select("dt").distinct().collect()]  # a row per day of one venue's era
    left = {r.dt.isoformat() for r in kept.select(F.to_date("ts").alias("dt")).distinct().collect()}
    write_partitioned(kept, path, "overwrite")
    for day in set(days) - left:
        drop_partition(spark, path, exchange, pair, day, dry_run=False)


def write_partitioned(rows: DataFrame, path: str, mode: str = "append") -> None:
    """By exchange, pair and day, each day's files in the order of time, so that scans prune by all three."""
    rows = rows.withColumn("dt", F.to_date("ts"))
    rows.repartition("exchange", "pair", "dt").sortWithinPartitions("exchange", "pair", "dt", "ts").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("exchange", "pair", "dt").parquet(path)


def write_stream(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """The running query that appends a stream to a partitioned store; the sink's log makes each micro-batch count once.

    ``trigger`` is that of writeStream; by default all that is there is taken, and the query ends.
    """
    stream = rows.withColumn("dt", F.to_date("ts")).writeStream.format("parquet").partitionBy("exchange", "pair", "dt")
    return stream.option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def scan(spark: SparkSession, path: str, exchange: str | None = None, pair: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows by partition and time; filters are added only for what is given."""
    rows = spark.read.parquet(path)
    if exchange:
        rows = rows.where(F.col("exchange") == exchange)
    if pair:
        rows = rows.where(F.col("pair") == pair)
    if start is not None:
        rows = rows.where((F.col("dt") >= F.to_date(start)) & (F.col("ts") >= start))
    if end is not None:
        rows = rows.where((F.col("dt") <= F.to_date(end)) & (F.col("ts") < end))
    return rows.drop("dt")


def upsert(have: DataFrame, new: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """Both by key: the new row where there is one (``update``), or the old one (insert only)."""
    both = have.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    order = F.col("_n").desc() if update else F.col("_n").asc()
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r", "_n")


def append_changed(have: DataFrame, new: DataFrame, key: list[str], since: str) -> DataFrame:
    """The rows of ``new`` that differ from the latest row of their key in ``have`` in anything but ``since``."""
    latest = have.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(since).desc()))).where("_r = 1")
    values = [c for c in new.columns if c != since]
    return new.join(latest.select(*(F.col(c).alias(f"_{c}") for c in values)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in values], "left_anti")


def export_csv(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").csv(path, header=True)


class IntervalCache:
    """Query results by interval, as Parquet: only the gaps of a wanted range are computed.

    Each computed interval is a folder of its own, named by its ends, and the folders that were written whole are the
    registry: any session on the same path sees them, and computing an interval again overwrites its folder. Intervals
    that end less than ``settled_seconds`` ago may still change and are never kept.
    """

    def __init__(self, spark: SparkSession, path: str, settled_seconds: int = 900):
        self.spark, self.path, self.settled = spark, path, settled_seconds

    def folder(self, key: str) -> str:
        return f"{self.path}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def kept(self, key: str) -> list[tuple[int, int]]:
        """The intervals that have a folder, in order; two sessions may have written ones that overlap."""
        if not exists(self.spark, self.folder(key)):
            return []
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(key))
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        whole = [n for n in names if exists(self.spark, f"{self.folder(key)}/{n}/_SUCCESS")]
        return sorted(tuple(map(int, n.split("_"))) for n in whole)

    def periods(self, key: str) -> list[tuple[int, int]]:
        """The cached time of a key as intervals that neither touch nor overlap."""
        out: list[tuple[int, int]] = []
        for a, b in self.kept(key):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def gaps(self, key: str, start: int, end: int) -> list[tuple[int, int]]:
        out, at = [], start
        for a, b in self.periods(key):
            if b <= at or a >= end:
                continue
            if a > at:
                out.append((at, a))
            at = max(at, b)
        return [*out, (at, end)] if at < end else out

    def load(self, key: str, start: int, end: int, compute: Callable[[int, int], DataFrame], now: int) -> DataFrame:
        """Rows of [start, end) microseconds; compute(a, b) gives those of an interval, with a column ts."""
        stable = min(end, now - self.settled * 1_000_000)
        for a, b in self.gaps(key, start, stable):
            compute(a, b).write.mode("overwrite").parquet(f"{self.folder(key)}/{a}_{b}")
        us, parts, at = F.unix_micros("ts"), [], start
        for a, b in self.kept(key):
            low, high = max(a, at), min(b, stable)
            if low < high:  # of overlapping folders each instant comes from one
                parts.append(self.spark.read.parquet(f"{self.folder(key)}/{a}_{b}").where((us >= low) & (us < high)))
                at = high
        if stable < end:
            parts.append(compute(max(start, stable), end))
        return reduce(DataFrame.unionByName, parts) if parts else compute(start, end)

    def load_seconds(self, key: str, start: int, end: int, compute: Callable[[int, int], DataFrame], now: int) -> DataFrame:
        """load() over whole seconds around the range, so that ranges that differ by less share their intervals; rows of the range alone."""
        second = 1_000_000
        rows = self.load(key, start // second * second, -(-end // second) * second, compute, now)
        return rows.where((F.unix_micros("ts") >= start) & (F.unix_micros("ts") < end))

    def periods_frame(self, keys: list[str]) -> DataFrame:
        """key, period_start, period_end of what is cached."""
        rows = [(k, a, b) for k in keys for a, b in self.periods(k)]
        out = self.spark.createDataFrame(rows, "key string, a long, b long")
        return out.select("key", F.timestamp_micros("a").alias("period_start"), F.timestamp_micros("b").alias("period_end"))

"""Exact top-k by inner product: ball trees per shard, searched by branch and bound."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.cluster import cut

#: Rows of a shard, rows of a leaf, queries of a block.
SHARD, LEAF, BLOCK = 4096, 64, 512
#: Pivots at most, shards' balls that a block meets at a time, and trees that a task searches for a block.
PIVOTS, BALLS, TREES = 256, 512, 16
NO_ID = np.iinfo(np.int64).max


LOW = np.iinfo(np.int64).min


def dense(lists: pa.Array) -> np.ndarray:
    """Whole numbers, as doubles, one row per list; shorter lists are filled up with zeros."""
    size = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), float)
    out = np.zeros((len(lists), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(lists)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in doubles where all partial sums are below 2 ** 53, then in 64-bit whole
    numbers, then in Python's; what is beyond 64 bits becomes the nearest number that isn't, -2 ** 63 aside."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    with np.errstate(over="ignore"):
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dims
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62 and max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0))) < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


def upper_bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and ball the most that their inner product can be; rounding and overflow never make it less."""
    dims = min(queries.shape[1], centre.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        q, c = queries[:, :dims], centre[:, :dims]
        reach = np.sqrt((queries * queries).sum(1))[:, None]
        upper = q @ c.T + reach * radius
        # what rounding can take off: sums of up to dims products, each within the norms
        upper += 1e-9 * (np.abs(upper) + reach * (np.sqrt((centre * centre).sum(1)) + radius) * 1e-3 + 1)
    return np.where(np.isnan(upper), np.inf, upper)


class BallTree:
    """Points in leaf order, and for each node its span, centre, radius and parent."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(points))
        x = points
        nodes: list[tuple[int, int, int]] = []
        todo = [(0, len(points), -1)] if len(points) else []
        while todo:
            a, b, parent = todo.pop()
            nodes.append((a, b, parent))
            if b - a > LEAF:
                part = order[a:b]
                middle = (b - a) // 2
                widest = np.ptp(x[part], axis=0).argmax()
                order[a:b] = part[np.argpartition(x[part, widest], middle)]
                todo += [(a, a + middle, len(nodes) - 1), (a + middle, b, len(nodes) - 1)]
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]
        self.span = np.array(nodes, np.int64).reshape(-1, 3)
        x = x[order]
        self.centre = np.array([x[a:b].mean(0) for a, b, _ in nodes]).reshape(len(nodes), points.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            self.radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for (a, b, _), c in zip(nodes, self.centre, strict=True)])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, bound): for each query and leaf the least upper bound of q . x on the way from the root to it."""
        upper = upper_bounds(queries, self.centre, self.radius)
        leaf = np.ones(len(self.span), bool)
        for k, (_, _, parent) in enumerate(self.span.tolist()):
            if parent >= 0:
                np.minimum(upper[:, k], upper[:, parent], out=upper[:, k])
                leaf[parent] = False
        leaves = np.flatnonzero(leaf)
        return leaves, upper[:, leaves]


class Search:
    """The best ``k`` of a block of queries so far; shares its k-th scores with every tree that comes."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, least: np.ndarray, k: int):
        n = len(queries)
        self.queries, self.rows, self.least, self.k = queries, rows, least, k
        self.score = np.full((n, k), LOW)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def visit(self, tree: BallTree) -> None:
        """Each query goes through the leaves by falling bound, until the next bound is below its k-th score."""
        if not len(tree.points):
            return
        leaves, upper = tree.bounds(self.queries)
        order = np.argsort(-upper, axis=1, kind="stable")
        on = np.arange(len(self.queries))
        for turn in range(len(leaves)):
            nearest = order[on, turn]
            on = on[upper[on, nearest] >= np.maximum(self.score[on, -1], self.least[on])]
            if not len(on):
                break
            nearest = order[on, turn]
            for leaf in np.unique(nearest):
                a, b, _ = tree.span[leaves[leaf]].tolist()
                self.offer(on[nearest == leaf], tree.points[a:b], tree.ids[a:b], tree.rows[a:b])

    def offer(self, who: np.ndarray, points: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score = products(self.queries[who], points)
        score = np.where(self.rows[who][:, None] == rows, LOW, score)
        better = score.max(1) >= np.maximum(self.score[who, -1], self.least[who])
        who, score = who[better], score[better]
        if not len(who):
            return
        score = np.concatenate((self.score[who], score), 1)
        ids = np.concatenate((self.ids[who], np.broadcast_to(ids, (len(who), len(ids)))), 1)
        order = np.lexsort((ids, ~score), axis=1)[:, : self.k]  # ~ turns the order of whole numbers around
        self.score[who] = np.take_along_axis(score, order, 1)
        self.ids[who] = np.take_along_axis(ids, order, 1)


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k best of all other rows.

    Components become floor(scale * x); the score is the exact inner product of these whole numbers, ties go to the
    smaller vec_id; fewer rows than k give fewer. Rows lie with the nearest of a few pivots (a bounded sample of rows:
    PIVOTS of them, by hash, which changes no result), in shards of about ``shard`` rows, each with a ball tree; queries
    lie in blocks the same way. A block first searches a shard of its own pivot. The k-th scores from there say, by the
    shards' balls alone, which shards can't hold any better row for any query of the block: these are never sent. The
    others are, TREES of them to a task, where the k-th scores go on from tree to tree.

    Rows whose vector is null, empty, or holds null or non-finite components, scaled or not, take no part; a zero
    vector does. Shorter vectors count as if filled up with zeros. A score beyond 64 bits counts as the nearest number
    that fits, -2 ** 63 aside. Repeated rows are rows of their own: only the query's very row is left out. A null vec_id
    is no query; as a candidate it comes last among ties. An empty table gives no rows.
    """
    spark = rows.sparkSession
    x = F.transform(F.col(embedding), lambda v: v.cast("double") * scale)
    fine = (F.size(x) > 0) & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    live = rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), fine.alias("fine")).where("fine")
    # doubles from 2 ** 52 on are whole
    whole = F.transform("x", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    live = cut(live.select("vec_id", whole.alias("v")).withColumn("row", F.monotonically_increasing_id()))
    count, asked = live.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-count // shard)), max(1, -(-asked // BLOCK))
    few = max(1, min(PIVOTS, shards // 4))
    sample = live.orderBy(F.xxhash64("row", F.lit(3)), "row").limit(few).select("v").collect()  # at most PIVOTS rows
    width = max((len(r.v) for r in sample), default=1)
    pivots = np.array([[*r.v, *[0.0] * (width - len(r.v))] for r in sample]).reshape(-1, width) if sample else np.zeros((1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = dense(batch.column("v"))
            dims = min(v.shape[1], pivots.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                away = (pivots * pivots).sum(1) - 2 * (v[:, :dims] @ pivots[:, :dims].T)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.nan_to_num(away).argmin(1).astype(np.int32))], names=[*batch.schema.names, "pivot"])

    live = cut(live.mapInArrow(place, "vec_id long, v array<double>, row long, pivot int"))
    queries = live.where(F.col("vec_id") % every == 0)

    def dealt(df: DataFrame, most: int, name: str, salt: int) -> DataFrame:
        """df with ``name``: a number for each pivot's part of about ``most`` rows; there is a row per pivot to plan them."""
        sizes = df.groupBy("pivot").agg(F.ceil(F.count("*") / most).cast("int").alias("_of"))
        sizes = sizes.withColumn("_first", F.coalesce(F.sum("_of").over(Window.orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
        return df.join(F.broadcast(sizes), "pivot").withColumn(name, F.col("_first") + F.pmod(F.xxhash64("row", F.lit(salt)), F.col("_of")).cast("int")).drop("_of", "_first")

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["vec_id"].fill_null(NO_ID).to_numpy()
        tree = BallTree(dense(table["v"].combine_chunks()), ids, table["row"].to_numpy())
        out = {"pivot": table["pivot"][:1], "shard": pa.array([key[0].as_py()], pa.int32()), "centre": pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(tree.radius[0])]), "body": pa.array([pickle.dumps(tree)], pa.binary())}
        return pa.table(out)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        body = (dense(table["v"].combine_chunks()), table["row"].to_numpy(), table["vec_id"].to_numpy(), np.full(len(table), LOW))
        return pa.table({"pivot": table["pivot"][:1], "block": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([pickle.dumps(body)], pa.binary())})

    trees = cut(dealt(live, shard, "shard", 1).groupBy("shard").applyInArrow(grow, "pivot int, shard int, centre array<double>, radius double, body binary"))
    packed = cut(dealt(queries, BLOCK, "block", 2).groupBy("block").applyInArrow(pack, "pivot int, block int, body binary"))

    def search(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come as a block's queries, then the trees for them."""
            now = None

            def result() -> Iterator[pa.RecordBatch]:
                (block, _), ids, s = now
                if not last:
                    body = (s.queries, s.rows, ids, np.maximum(s.least, s.score[:, -1]))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pickle.dumps(body)], pa.binary())], names=["block", "body"])
                    return
                who, place = np.nonzero(s.score > LOW)
                found = s.ids[who, place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.rows[who]), pa.array(ids[who]), pa.array(found, mask=found == NO_ID), pa.array(s.score[who, place])],
                    names=["row", "query_id", "vec_id", "score"],
                )

            for batch in batches:
                for i in range(len(batch)):
                    r = batch.slice(i, 1).to_pylist()[0]
                    body = pickle.loads(r["body"])
                    if r["kind"] == 0:
                        if now is not None:
                            yield from result()
                        q, rows, ids, least = body
                        now = ((r["block"], r["g"]), ids, Search(q, rows, least, k))
                    elif now is not None and now[0] == (r["block"], r["g"]):
                        now[2].visit(body)
            if now is not None:
                yield from result()

        return run

    def meet(queries: DataFrame, trees: DataFrame, tasks: int, last: bool) -> DataFrame:
        """queries(block, g, body) and trees(block, g, shard, body) in a task per block and g, the queries first."""
        rows = queries.select("block", "g", F.lit(0).alias("kind"), F.lit(0).alias("shard"), "body").union(trees.select("block", "g", F.lit(1), "shard", "body"))
        rows = rows.repartition(tasks, "block", "g").sortWithinPartitions("block", "g", "kind", "shard")
        return rows.mapInArrow(search(last), "row long, query_id long, vec_id long, score long" if last else "block int, body binary")

    # 1. one shard of the block's own pivot
    first = trees.groupBy("pivot").agg(F.min("shard").alias("shard"))
    home = packed.select("pivot", "block").join(first, "pivot").join(trees.select("shard", "body"), "shard").withColumn("g", F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = cut(meet(packed.withColumn("g", F.lit(0)), home, max(parts, min(blocks, 4 * parts)), False))

    # 2. shards whose ball may hold a better row for some query of a block: blocks meet the balls, many shards to a row
    balls = trees.groupBy(F.floor(F.col("shard") / BALLS).alias("pack")).agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("balls"))
    packs = -(-(trees.agg(F.max("shard")).first()[0] or 0) // BALLS) + 1
    asks = queries.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs)))).join(balls, "pack")

    def open_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                q, _, _, least = pickle.loads(r["body"])
                dims = max(len(x["centre"]) for x in r["balls"])
                centre = np.array([[*x["centre"], *[0.0] * (dims - len(x["centre"]))] for x in r["balls"]])
                upper = upper_bounds(q, centre, np.array([x["radius"] for x in r["balls"]]))
                reached = (upper >= least[:, None]).any(0)
                shard = np.array([x["shard"] for x in r["balls"]], np.int32)[reached]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shard), r["block"], np.int32)), pa.array(shard)], names=["block", "shard"])

    pairs = cut(asks.select("block", "body", "balls").mapInArrow(open_shards, "block int, shard int"))
    pairs = pairs.withColumn("g", F.floor(F.col("shard") / TREES).cast("int"))
    tasks = max(parts, pairs.select("block", "g").distinct().count() // 4)
    everywhere = pairs.join(trees.select("shard", "body"), "shard")
    found = meet(queries.join(pairs.select("block", "g").distinct(), "block"), everywhere, tasks, True)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

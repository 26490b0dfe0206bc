"""Near-duplicates of embeddings by p-stable hashing, checked with exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.cluster import components, cut
from tidebook.llm.hot import Forest, dealt_join, in_bounded_groups
from tidebook.llm.text import mix

#: Rows of one comparison group.
GROUP = 2048
#: Rows of one vector in a task.
MOST = 100_000
#: Width of a quantised projection of unit vectors, and how many rows of a label an average bucket should hold.
WIDTH, CROWD = 2.0, 32
#: Bits by which a projection of that width tells random vectors apart: the entropy of floor(z / 2 + u), z normal, u uniform.
APART = 1.28


def collides(cosine: float, width: float = WIDTH) -> float:
    """The probability that a quantised projection puts two unit vectors of this cosine in one cell."""
    ratio = width / math.sqrt(max(2 - 2 * cosine, 1e-12))
    return 1 - math.erfc(ratio / math.sqrt(2)) - math.sqrt(2 / math.pi) / ratio * (1 - math.exp(-ratio * ratio / 2))


def plan(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """(tables, bits) for ``count`` vectors of a label: random buckets hold about CROWD of them, whatever the count, and a
    link at the threshold is found with probability ``recall``. Comparisons per vector follow the tables, not the count."""
    bits = max(6, math.ceil(math.log2(max(count, 1) / CROWD) / APART)) if count > CROWD else 6
    return math.ceil(math.log(1 - recall) / math.log1p(-(collides(threshold) ** bits))), bits


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of doubles from a list column without nulls whose lists are equally long."""
    if not len(lists):
        return np.zeros((0, 0))
    return np.asarray(lists.flatten(), float).reshape(len(lists), -1)


class Projections:
    """``tables`` hashes of unit vectors, each of ``bits`` numbers floor((a x + b) / width) with Gaussian a."""

    def __init__(self, dims: int, tables: int, bits: int, width: float, seed: int):
        random = np.random.Generator(np.random.PCG64([seed, dims]))
        self.a = random.standard_normal((dims, tables * bits)) / width
        self.b = random.random(tables * bits)
        self.odd = random.integers(0, 1 << 63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shape = (tables, bits)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        cells = np.floor(unit @ self.a + self.b).astype(np.int64).view(np.uint64).reshape(len(unit), *self.shape)
        return (mix((cells * self.odd).sum(2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(rows: DataFrame, embedding: str) -> DataFrame:
    """rows with ``x`` array<double>: null where the vector is null, empty, zero, or holds null or non-finite components."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(x, lambda v: v != 0)
    return rows.withColumn("x", F.when(fine, x))


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93,
    recall: float = 0.99, seed: int = 9, most: int = GROUP,
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Vectors of one non-null label and of one length are linked if their cosine, in doubles, is ``threshold`` or more.
    Candidates share a bucket of at least one table; a link at the threshold itself is found with probability
    ``recall``, closer ones with more, and no pair below the threshold is linked. How many tables there are, of how many
    projections, follows from the largest label's number of distinct vectors (``plan``). Equal vectors of a label
    are one representative with a count, so copies are not paired. Each linked pair of representatives is counted in
    the first table whose bucket it shares, at both ends, and gives a link for the components only where it joins two
    parts of its group: pairs are never rows. Buckets of over ``most`` rows are compared chunk by chunk, all of them.

    n_links: other rows linked directly, copies included. component_id: the smallest vec_id reachable, itself included;
    kept: whether that is its own. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    of null label, link with nothing. Repeated rows count as copies. A null vec_id takes part but is never the smallest.
    """
    single = "array<float>" if dict(rows.dtypes)[embedding] == "array<float>" else None
    rows = vectors(rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding")), "embedding")
    rows = cut(rows.select("vec_id", F.when(F.col("x").isNotNull(), F.col("label")).alias("label"), F.when(F.col("label").isNotNull(), F.col("x")).alias("x")))
    live = rows.where("label is not null")
    # what a float column holds fits floats; lengths and products are of doubles
    wide = np.float32 if single else np.float64
    reps = cut(live.groupBy("label", "x").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tables, bits = plan(largest, threshold, recall)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Projections] = {}
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, len(whole), 500)):
                size = np.diff(np.asarray(batch.column("x").offsets))
                for dims in np.unique(size).tolist():
                    part = batch.filter(pa.array(size == dims))
                    x = matrix(part.column("x"))
                    unit = units(x)
                    hashes = known.setdefault(dims, Projections(dims, tables, bits, WIDTH, seed))(unit)
                    which = np.repeat(np.arange(len(part)), tables)
                    out = part.take(pa.array(which))
                    every = pa.ListArray.from_arrays(np.arange(0, len(which) * tables + 1, tables, dtype=np.int32), hashes[which].ravel())
                    lists = pa.ListArray.from_arrays(np.arange(0, len(which) * dims + 1, dims, dtype=np.int32), x.astype(wide)[which].ravel())
                    yield pa.RecordBatch.from_arrays(
                        [out.column("label"), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(hashes.ravel()), out.column("rep"), out.column("copies"), lists, every],
                        names=["label", "t", "h", "rep", "copies", "x", "every"],
                    )

    kind = dict(rows.dtypes)["label"]
    spreaded = reps.select("label", "x", "rep", "copies").mapInArrow(spread, f"label {kind}, t int, h int, rep long, copies long, x {single or 'array<double>'}, every array<int>")
    key = ["label", "t", "h"]
    groups = in_bounded_groups(spreaded, key, "rep", most)
    groups = groups.repartition(parts, *key, "part").sortWithinPartitions(*key, "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group: (a, links of a found here, null) and (a, null, b) for the links of a spanning forest."""
        rest = None
        for batch in batches:
            if rest is not None and len(rest):
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            names = [batch.column(k) for k in (*key, "part")]
            differ = np.zeros(len(batch) - 1, bool) if len(batch) else np.zeros(0, bool)
            for c in names:
                v = c.to_numpy(zero_copy_only=False)
                differ |= v[1:] != v[:-1]
            cuts = np.flatnonzero(differ) + 1
            stop = int(cuts[-1]) if len(cuts) else 0
            if stop:
                yield from groups_of(batch.slice(0, stop), np.r_[0, cuts[:-1]], cuts)
            rest = batch.slice(stop)
        if rest is not None and len(rest):
            yield from groups_of(rest, np.array([0]), np.array([len(rest)]))

    def groups_of(batch: pa.RecordBatch, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        lone = end - begin > 1
        counts: list[tuple] = []
        ties: list[tuple] = []
        for a, b in zip(begin[lone].tolist(), end[lone].tolist(), strict=True):
            found = pairs_of(batch.slice(a, b - a))
            if found is not None:
                rep, n, x, y = found
                counts.append((rep, n))
                ties.append((x, y))
        if counts:
            a = np.concatenate([c[0] for c in counts] + [t[0] for t in ties])
            n = np.concatenate([c[1] for c in counts] + [np.zeros(len(t[0]), np.int64) for t in ties])
            b = np.concatenate([c[0] for c in counts] + [t[1] for t in ties])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(b)], names=["a", "n", "b"])

    def pairs_of(group: pa.RecordBatch) -> tuple | None:
        u, every = units(matrix(group.column("x"))), np.asarray(group.column("every").flatten()).reshape(len(group), -1)
        rep, copies, chunk = (group.column(c).to_numpy() for c in ("rep", "copies", "chunk"))
        t, part = group.column("t")[0].as_py(), group.column("part")[0].as_py()
        two = part >> 31 != part & (1 << 31) - 1
        n = np.zeros(len(rep), np.int64)
        forest = Forest(len(rep))
        for i in range(0, len(rep), 512):
            near = (u[i : i + 512] @ u.T) >= threshold
            near &= np.arange(len(rep)) > np.arange(i, min(i + 512, len(rep)))[:, None]
            if two:
                near &= chunk[i : i + 512, None] != chunk
            x, y = np.nonzero(near)
            x += i
            if t and len(x):  # counted in an earlier table?
                new = (every[x, :t] != every[y, :t]).all(1)
                x, y = x[new], y[new]
            np.add.at(n, x, copies[y])
            np.add.at(n, y, copies[x])
            forest.link(x, y)
        if not n.any():
            return None
        root = forest.roots()
        tied, some = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(n)
        return rep[some], n[some], rep[tied], rep[root[tied]]

    found = cut(groups.mapInArrow(compare, "a long, n long, b long"))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.where("a <> b").select("a", "b"))
    reps = reps.join(joined, reps.rep == joined.node, "left").withColumn("root", F.coalesce("component", "rep"))
    lowest = reps.groupBy("root").agg(F.min("low").alias("component_id"))
    of = reps.join(links, reps.rep == links.a, "left").join(lowest, "root")
    common = reps.where(F.col("copies") > MOST).select("label", "x", F.col("copies").alias("rows"))
    of = of.select("label", "x", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = dealt_join(live, of, ["label", "x"], F.monotonically_increasing_id(), common, MOST).select("vec_id", "n_links", "component_id")
    alone = rows.where("label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

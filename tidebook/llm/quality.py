"""Quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import text as X

#: Byte classes that are counted per text.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:'\"-()",
    "loud": b"!?",
    "bar": b"|",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
    "line": b"\n",
    "wide": range(0xC0, 0x100),
}
NAMES = ("words", "length", "upper", "digit", "stop", "loud", "bar", "sign", "line", "same", "distinct", "busiest")
#: Bytes of text that the kernel takes at a time.
PIECE = 4 << 20


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics per text, in the order of NAMES; whole texts are counted, null as empty."""
    data, offsets = X.buffer(texts)
    starts, ends, first = X.words(data, offsets)
    n = len(offsets) - 1
    words = np.diff(first)
    some = np.maximum(words, 1)
    count = {}
    for name, members in CLASSES.items():
        mark = np.zeros(256, bool)
        mark[list(members)] = True
        sums = np.concatenate(([0], np.cumsum(mark[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)))
        count[name] = np.diff(sums[offsets])
    hashes = X.hash_spans(data, starts, ends, True)
    doc = np.repeat(np.arange(n), words)
    same = np.zeros(len(hashes), np.int32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    # distinct words, and how often the commonest comes, per text
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    distinct = np.bincount(d[at], minlength=n)
    busiest = np.zeros(n)
    np.maximum.at(busiest, d[at], np.diff(np.append(at, len(h))))
    letters = np.maximum(count["upper"] + count["lower"] + count["wide"], 1)
    size = np.diff(offsets)
    share = lambda x, of: np.sqrt(x / of)  # noqa: E731  spreads the shares near zero
    return np.column_stack(
        (
            np.log1p(words),
            np.log1p((size - words) / some),
            share(count["upper"], letters),
            share(count["digit"], np.maximum(size, 1)),
            share(count["stop"], some),
            share(count["loud"], some),
            share(count["bar"], some),
            share(count["sign"], some),
            share(count["line"], some),
            share(np.bincount(doc, same, n), some),
            np.log1p(distinct) / np.log1p(np.maximum(words, 1)),
            share(np.maximum(busiest - 1, 0), some),
        )
    )


@dataclass(frozen=True)
class Quadratic:
    """Two Gaussian classes: priors, means, and inverse Cholesky factors of their shrunk covariances."""

    prior: tuple[float, float]
    mean: np.ndarray
    factor: np.ndarray
    half_log_det: np.ndarray

    @staticmethod
    def fit(count: np.ndarray, total: np.ndarray, products: np.ndarray, shrink: float, floor: float) -> Quadratic | None:
        """From each class's row count, sums, and sums of products; None if a class has no rows.

        A class covariance is drawn by ``shrink`` towards the diagonal of the pooled covariance, and ``floor`` is added
        to each variance, so it has a Cholesky factor however few rows there are.
        """
        if min(count) < 1:
            return None
        mean = total / count[:, None]
        covariance = products / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = np.diag(np.diag((covariance * (count / count.sum())[:, None, None]).sum(0)))
        factor, log_det = [], []
        for k in range(2):
            s = (1 - shrink) * covariance[k] + shrink * pooled + floor * np.eye(len(pooled))
            lower = np.linalg.cholesky((s + s.T) / 2)
            factor.append(np.linalg.inv(lower))
            log_det.append(np.log(np.diag(lower)).sum())
        return Quadratic(tuple(count / count.sum()), mean, np.array(factor), np.array(log_det))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1, from the difference of Mahalanobis log densities."""
        density = [np.log(self.prior[k]) - self.half_log_det[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in range(2)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def apart(doc_id: Column, parts: int, held: int) -> Column:
    """Whether the document is in the held-out part; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == held


def with_statistics(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep and an array column x of the text's statistics."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("text"))
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, "text", PIECE):
            x = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), lists], names=[*keep, "x"])

    return rows.mapInArrow(X.lean(run), schema)


def fit(examples: DataFrame, shrink: float = 0.2, floor: float = 1e-3) -> Quadratic | None:
    """examples(x array<double>, quality int): every row counts; rows whose quality isn't 0 or 1 are left out.

    Spark sums each class's moments (two rows reach the driver, whatever the data).
    """
    k = len(NAMES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col("x")[i] for i in range(k)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {int(r["quality"]): r for r in examples.where("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n"), *sums).collect()}
    if len(rows) < 2:
        return None
    count = np.array([rows[c]["n"] for c in (0, 1)], float)
    total = np.array([[rows[c][f"s{i}"] for i in range(k)] for c in (0, 1)])
    products = np.zeros((2, k, k))
    for c in (0, 1):
        for i, j in pairs:
            products[c, i, j] = products[c, j, i] = rows[c][f"p{i}_{j}"]
    return Quadratic.fit(count, total, products, shrink, floor)


def learn(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, statistics_of: DataFrame | None = None, most: int | None = None) -> Quadratic | None:
    """A model from the documents outside the held-out part that ``labels`` (doc_id, quality) marks.

    A document with several labels has the lowest; null ids and null labels are left out. None without both classes.
    ``most`` bounds the labelled rows that are learned from, about: of more, those stay whose id's hash falls in a share
    of that size, and only their texts are looked at. Columns besides doc_id, text and quality are not read.
    """
    if most is not None:
        share = max(1, labels.count() // most)
        sampled = F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0
        docs, labels = docs.where(sampled), labels.where(sampled)
    rows = statistics_of if statistics_of is not None else with_statistics(docs, "text", "doc_id")
    marks = labels.where(~apart(F.col("doc_id"), parts, held)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fit(rows.join(marks, "doc_id").select("x", "quality"))


def scored(rows: DataFrame, model: Quadratic | None, text: str = "text", score: str = "score") -> DataFrame:
    """rows, all columns, and ``score``: 0 to 1, higher where quality 1 is likelier; 0.5 without a model.

    Empty and null texts are scored like any other, by their statistics. ``score`` replaces a column of that name.
    """
    rows = rows.drop(score)
    schema = T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, text, PIECE):
            s = np.full(len(batch), 0.5) if model is None else model.score(statistics(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, score])

    return rows.mapInArrow(X.lean(run), schema)


def scored_statistics(rows: DataFrame, model: Quadratic | None, score: str = "score") -> DataFrame:
    """The same from rows that already have their statistics in x; x is dropped."""
    schema = T.StructType([*rows.drop("x").schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            s = np.full(len(batch), 0.5) if model is None else model.score(x) if len(batch) else np.zeros(0)
            names = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s)], names=[*names, score])

    return rows.mapInArrow(X.lean(run), schema)

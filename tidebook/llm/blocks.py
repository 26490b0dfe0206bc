"""Documents in blocks that ask key buckets questions: counting and matching without a row per word.

A block holds some documents' whole texts, compressed. A task reads a block, hashes its words in numpy, and sends each
bucket the distinct keys it has there, sorted and packed; the bucket sees all blocks' keys, and answers each. So a key
costs a few bytes per block in which it occurs, however often it occurs there, and no key's occurrences are gathered.
Blocks and buckets both hold a bounded number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import text as X
from tidebook.llm.cluster import cut

#: Bytes of text of a block, and keys of a bucket, about.
BLOCK, BUCKET = 12 << 20, 2_000_000


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def swell(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Numbers with equal bytes of all of them next to each other, compressed."""
    values = np.ascontiguousarray(values)
    return values.dtype.str.encode().ljust(4) + squeeze(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:4].strip().decode())
    return np.frombuffer(swell(data[4:]), np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers from 0, in the least bytes that hold them all."""
    most = int(values.max(initial=0))
    return pack(values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising unsigned 64-bit numbers."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


@dataclass
class Block:
    """Some documents: ids (null as None in ``missing``), marks, and the words of all in one sequence."""

    block: int
    ids: np.ndarray
    missing: np.ndarray
    marked: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(row: dict) -> Block:
        ids = row["ids"]
        missing = np.array([i is None for i in ids], bool)
        return Block(
            row["block"], np.array([0 if i is None else i for i in ids], np.int64), missing, np.array(row["marked"], bool),
            np.frombuffer(swell(row["text"]), np.uint8), np.array(row["offsets"], np.int64),
        )


def make(docs: DataFrame, doc_id: str, text: str, marked: Column) -> DataFrame:
    """block, ids, marked, offsets, text, words: a row per block, in the shared folder. Null texts are empty.

    Document ids are whole numbers; ids of another kind are refused.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be a whole number, not {docs.schema[doc_id].dataType.simpleString()}")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(marked, F.lit(False)).alias("marked"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(X.pieces(batches, "text", BLOCK)):
            data, offsets = X.buffer(batch.column("text"))
            starts, _, _ = X.words(data, offsets)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k]), one(batch.column("id")), one(batch.column("marked")), one(pa.array(offsets)), pa.array([squeeze(data.tobytes(), 5)], pa.binary()), pa.array([len(starts)])],
                names=["block", "ids", "marked", "offsets", "text", "words"],
            )

    return cut(rows.mapInArrow(run, "block long, ids array<long>, marked array<boolean>, offsets array<long>, text binary, words long"))


def buckets(blocks: DataFrame, most: int | None = None) -> int:
    """How many buckets of ``most`` (BUCKET) keys hold those of these blocks, if all words were apart."""
    return max(1, -(-(blocks.agg(F.sum("words")).collect()[0][0] or 0) // (most or BUCKET)))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def sorted_unique(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows in the order of keys (the first counts most), and where a new value begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, new

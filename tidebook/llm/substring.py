"""Repeated passages: fixed-block anchors, probed with every rolling window, and extended to whole repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import blocks as B
from tidebook.llm import text as X
from tidebook.llm.cluster import cut, release

_ONE, _TWO = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
KEY_BITS = 48


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """At each place the sum of h[i + j] * base ** j for j < n, modulo 2 ** 64, by doubling; the last n - 1 aren't given."""
    mod = (1 << 64) - 1
    out, size, have, width = None, 0, h, 1
    while True:
        if n & width:
            out = have if out is None else out[: len(have) - size] + np.uint64(pow(base, size, 1 << 64) & mod) * have[size:] if len(have) > size else have[:0]
            size += width
        if size == n:
            return out[: max(0, len(h) - n + 1)]
        have = have[:-width] + np.uint64(pow(base, width, 1 << 64) & mod) * have[width:] if len(have) > width else have[:0]
        width *= 2


class Passages:
    """A block's words, its anchors and probes, and its windows of ``length`` words."""

    def __init__(self, block: B.Block, length: int):
        self.block, self.length, self.anchor = block, length, length // 2
        self.starts, self.ends, self.first = X.words(block.data, block.offsets)
        self.words, self.checks = X.word_hashes(block.data, block.offsets)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.end = self.first[1:][self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def fits(self, n: int) -> np.ndarray:
        """Places where n words begin that lie in one document."""
        at = np.arange(max(0, len(self.words) - n + 1))
        return at[at + n <= self.end[at]]

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, key, reference): all rolling runs of half a window; a document's non-overlapping ones are references."""
        at = self.fits(self.anchor)
        key = X.mix(rolling(self.words, self.anchor, _ONE)[at]) >> np.uint64(64 - KEY_BITS)
        return at, key, (at - self.first[self.doc[at]]) % self.anchor == 0

    def distinct_probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, reference, several): rising keys, whether a reference has it, whether it comes more than once."""
        _, key, reference = self.probes()
        both = np.sort(key << np.uint64(1) | reference.astype(np.uint64))
        key = both >> np.uint64(1)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(key)] - 1 if len(key) else new
        return key[new], (both[last] & np.uint64(1)).astype(bool), last > new

    def windows(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, key, check): the windows that hold a hit, each with two hashes of 64 bits that share nothing: they are
        sums over different hashes of the words, to different bases."""
        at, key, _ = self.probes()
        hit = np.zeros(len(self.words) + self.length + 1, np.int32)
        if len(hits):
            k = np.minimum(np.searchsorted(hits, key), len(hits) - 1)
            hit[at[hits[k] == key] + 1] = 1
        hit = np.cumsum(hit)
        place = self.fits(self.length)
        place = place[hit[place + self.length - self.anchor + 1] > hit[place]]
        return place, X.mix(rolling(self.words, self.length, _ONE)[place]), X.mix(rolling(self.checks, self.length, _TWO)[place])

    def firsts(self, hits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, order, new): windows, their order by key and then by document and place, and each key's first one."""
        place, key, check = self.windows(hits)
        doc = self.doc[place]
        rank = np.empty(len(self.block.ids), np.int64)
        rank[np.lexsort((self.block.ids, self.block.missing))] = np.arange(len(self.block.ids))
        order = np.lexsort((place, rank[doc], check, key))
        k, c = key[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        return place, key, check, order, new


def spans(bucket_of: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that rising numbers fall in."""
    edge = np.searchsorted(bucket_of, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, int(edge[b]), int(edge[b + 1])


def bucket_of(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(bits - 40)) * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)


def hits_of(answers: list[dict], p: Passages, buckets: int) -> np.ndarray:
    key, _, _ = p.distinct_probes()
    mask = {a["bucket"]: a["body"] for a in answers}
    out = [np.zeros(0, np.uint64)]
    for b, i, j in spans(bucket_of(key, KEY_BITS, buckets), buckets):
        out.append(key[i:j][np.unpackbits(np.frombuffer(B.swell(mask[b]), np.uint8), count=j - i).astype(bool)])
    return np.concatenate(out)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20) -> DataFrame:
    """A row per document: doc_id, n_words, spans (array of from, to in words), kept (the words left, space-joined).

    A word goes if a run of ``length`` words that covers it begins earlier too: in a document of smaller id, or at an
    earlier place of the same one. Runs are judged on the whole input.

    1. References are each document's non-overlapping runs of length // 2 words; every rolling run of that size of any
       document probes them. Wherever a run of ``length`` words repeats, its earlier copy holds a whole reference, and
       the later one holds the same words at the same offset, so both have a hit.
    2. Hits are extended: every window around a hit is sent, once per block, as 128 bits of two hashes with its first
       place; its bucket finds which block has the first of all. The other windows are repeats; where they follow each
       other they join to spans, the maximal repeats. Copies cost a row each, never a pair.

    Hits are matched by 48 bits; a false one only costs a look in step 2. Null texts have no words. Documents of null
    id come last, and rows of equal id count as documents in the order they are read. Empty tables give no rows.
    """
    blocks = B.make(docs, doc_id, text, F.lit(False))
    n = B.buckets(blocks)
    spark = docs.sparkSession

    def ask_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            key, reference, several = Passages(B.Block.of(row), length).distinct_probes()
            for b, i, j in spans(bucket_of(key, KEY_BITS, n), n):
                body = [B.pack_sorted(key[i:j]), B.squeeze(np.packbits(reference[i:j]).tobytes()), B.squeeze(np.packbits(several[i:j]).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["block"]]), pa.array([body], pa.list_(pa.binary()))], names=["bucket", "block", "body"])

    def answer_probes(table: pa.Table) -> pa.Table:
        key = [B.unpack_sorted(r.as_py()[0]) for r in table["body"]]
        size = [len(k) for k in key]
        bits = lambda k: np.concatenate([np.unpackbits(np.frombuffer(B.swell(r.as_py()[k]), np.uint8), count=s) for r, s in zip(table["body"], size, strict=True)])
        order, new = B.sorted_unique(np.concatenate(key))
        at = np.flatnonzero(new)
        reference = np.maximum.reduceat(bits(1)[order], at)
        several = np.maximum.reduceat(bits(2)[order], at) | (np.diff(np.r_[at, len(order)]) > 1)
        hit = np.empty(len(order), bool)
        hit[order] = (reference & several).astype(bool)[np.cumsum(new) - 1]
        cuts = np.cumsum(size)[:-1]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": pa.array([1] * len(table), pa.int32()), "body": pa.array([B.squeeze(np.packbits(h).tobytes()) for h in np.split(hit, cuts)], pa.binary())})

    answer = "block long, bucket int, kind int, body binary"
    probed = cut(blocks.mapInArrow(ask_probes, "bucket int, block long, body array<binary>").groupBy("bucket").applyInArrow(answer_probes, answer))
    release(spark)

    def ask_windows(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "body": []}
        for row in block.to_pylist():
            p = Passages(B.Block.of(row), length)
            place, key, check, order, new = p.firsts(hits_of(answers.to_pylist(), p, n))
            first = order[new]
            key, check, place = key[first], check[first], place[first]
            doc = p.doc[place]
            for b, i, j in spans(bucket_of(key, 64, n), n):
                used, which = np.unique(doc[i:j], return_inverse=True)
                out["bucket"].append(b)
                out["block"].append(row["block"])
                # places count from the document's own first word
                out["body"].append([B.pack_sorted(key[i:j]), B.pack(check[i:j]), B.pack(p.block.ids[used]), np.packbits(p.block.missing[used]).tobytes(), B.pack_small(which), B.pack_small(place[i:j] - p.first[doc[i:j]])])
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.int64()), "body": pa.array(out["body"], pa.list_(pa.binary()))})

    def answer_windows(table: pa.Table) -> pa.Table:
        key, check, ids, missing, place, sender, size = [], [], [], [], [], [], []
        for k, (block, body) in enumerate(zip(table["block"].to_pylist(), table["body"].to_pylist(), strict=True)):
            key.append(B.unpack_sorted(body[0]))
            check.append(B.unpack(body[1]))
            used = B.unpack(body[2])
            which = B.unpack(body[4])
            ids.append(used[which])
            missing.append(np.unpackbits(np.frombuffer(body[3], np.uint8), count=len(used))[which])
            place.append(B.unpack(body[5]).astype(np.int64))
            sender.append(np.full(len(which), block))
            size.append(len(which))
        key, check, ids, missing, place, sender = map(np.concatenate, (key, check, ids, missing, place, sender))
        order = np.lexsort((place, sender, ids, missing, check, key))
        k, c = key[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": pa.array([2] * len(table), pa.int32()), "body": pa.array([B.squeeze(np.packbits(h).tobytes()) for h in np.split(first, np.cumsum(size)[:-1])], pa.binary())})

    by_block = lambda df: df.groupBy("block")
    asked = by_block(blocks).cogroup(by_block(probed)).applyInArrow(ask_windows, "bucket int, block long, body array<binary>")
    judged = cut(asked.groupBy("bucket").applyInArrow(answer_windows, answer))
    release(spark)

    def settle(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "spans": [], "kept": []}
        answers = answers.to_pylist()
        for row in block.to_pylist():
            p = Passages(B.Block.of(row), length)
            place, key, _, order, new = p.firsts(hits_of([a for a in answers if a["kind"] == 1], p, n))
            mask = {a["bucket"]: a["body"] for a in answers if a["kind"] == 2}
            first = order[new]
            repeat = np.ones(len(place), bool)
            for b, i, j in spans(bucket_of(key[first], 64, n), n):
                repeat[first[i:j]] = ~np.unpackbits(np.frombuffer(B.swell(mask[b]), np.uint8), count=j - i).astype(bool)
            depth = np.zeros(len(p.words) + 1, np.int64)
            np.add.at(depth, place[repeat], 1)
            np.add.at(depth, place[repeat] + length, -1)
            gone = np.cumsum(depth)[:-1] > 0
            raw = p.block.data.tobytes()
            lost = np.concatenate(([0], np.cumsum(gone)))
            for d, (a, b) in enumerate(zip(p.first[:-1].tolist(), p.first[1:].tolist(), strict=True)):
                out["doc_id"].append(row["ids"][d])
                out["n_words"].append(b - a)
                if lost[b] == lost[a]:
                    out["spans"].append([])
                    out["kept"].append(b" ".join(raw[p.block.offsets[d] : p.block.offsets[d + 1]].split()).decode())
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
                out["spans"].append([{"from": s, "to": e} for s, e in edge.reshape(-1, 2).tolist()])
                keep = a + np.flatnonzero(~gone[a:b])
                out["kept"].append(b" ".join([raw[s:e] for s, e in zip(p.starts[keep].tolist(), p.ends[keep].tolist(), strict=True)]).decode())
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "spans": pa.array(out["spans"], span), "kept": pa.array(out["kept"], pa.string())})

    return by_block(blocks).cogroup(by_block(probed.union(judged))).applyInArrow(settle, "doc_id long, n_words long, spans array<struct<from: long, to: long>>, kept string")

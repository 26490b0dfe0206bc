"""SimHash near-duplicates, found by covering the fingerprints with the code words of a product of Golay codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import text as X
from tidebook.llm.cluster import components, cut
from tidebook.llm.hot import Forest, dealt_join, in_bounded_groups

#: Bytes of text that the kernel takes at a time, and that the signatures of near-duplicates do.
PIECE, SIGNED = 1 << 20, 1 << 18
#: The binary Golay code: length, check bits, covering radius, generator polynomial x11+x9+x7+x6+x5+x+1.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b101011100011
#: Rows of one comparison group.
GROUP = 4096
#: Rows of one fingerprint in a task.
MOST = 100_000
#: Fingerprints beyond which the free bits join the anchors' keys: 16 at home at an anchor, on average.
FINER = 1 << 28

_LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprints(texts: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint per text, as unsigned numbers.

    A-Z are lower-cased; the features are all runs of ``words`` words joined by a space, repeats included, or the whole
    word sequence if the text has fewer; a bit is 1 if it is set in over half of the features' XXH64. Null, empty and
    blank texts have no feature and the fingerprint 0.
    """
    data, offsets = X.buffer(texts)
    raw = X.FOLD[data].tobytes()
    out = np.zeros(len(offsets) - 1, np.uint64)
    xxh64 = xxhash.xxh64_intdigest
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts = raw[a:b].split()
        n = len(parts)
        if n > words:
            joined = b" ".join(parts)
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            starts = [0, *(spaces[: n - words] + 1).tolist()]
            stops = [*spaces[words - 1 :].tolist(), len(joined)]
            h = np.array([xxh64(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)], np.uint64)
            bits = np.zeros(64, np.int64)
            octets = h.view(np.uint8).reshape(-1, 8)
            at = np.arange(0, len(h), 255)
            for j in range(8):  # eight counters of 8 bits in a number, for up to 255 features
                sums = np.add.reduceat(_LANES[octets[:, j]], at)
                bits[8 * j : 8 * j + 8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
            out[k] = np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0]
        elif n:
            out[k] = xxh64(b" ".join(parts), seed)
    return out


@cache
def coset_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, first, upto): the error patterns of weight up to 2 RADIUS + 2, by syndrome and weight.

    Patterns of syndrome s start at first[s], ordered by weight; upto[s, w] of them weigh at most w. A fixed table of
    the code, 0.9 million numbers.
    """
    most = 2 * RADIUS + 2
    step = np.zeros(LENGTH, np.int64)
    x = 1
    for i in range(LENGTH):
        step[i] = x
        x <<= 1
        if x >> CHECKS & 1:
            x ^= GENERATOR
    patterns, syndromes, weights = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for w in range(1, most + 1):
        high = np.floor(np.log2(np.maximum(patterns[-1], 1))).astype(np.int64) + (patterns[-1] > 0)  # next free bit
        count = LENGTH - high
        base = np.repeat(np.arange(len(high)), count)
        bit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + high[base]
        patterns.append(patterns[-1][base] | 1 << bit)
        syndromes.append(syndromes[-1][base] ^ step[bit])
        weights.append(np.full(len(bit), w))
    p, s, w = map(np.concatenate, (patterns, syndromes, weights))
    order = np.lexsort((w, s))
    upto = np.zeros((1 << CHECKS, most + 1), np.int64)
    np.add.at(upto, (s, w), 1)
    upto = np.cumsum(upto, 1)
    return p[order], np.cumsum(upto[:, -1]) - upto[:, -1], upto


def lanes(features: np.ndarray, doc: np.ndarray, docs: int, count: int) -> np.ndarray:
    """(docs, count) 64-bit numbers: a bit is set if over half of the document's features have it in their hash."""
    n = np.bincount(doc, minlength=docs)
    out = np.zeros((docs, count), np.uint64)
    # runs of up to 255 features of one document, for eight counters of 8 bits in a number
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    at = np.unique(np.concatenate([np.flatnonzero((np.arange(len(features)) - first[doc]) % 255 == 0), np.zeros(0, np.int64)]))
    if not len(at):
        return out
    for lane in range(count):
        octets = X.mix(features + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        bits = np.zeros((docs, 64), bool)
        for j in range(8):
            sums = np.add.reduceat(_LANES[octets[:, j]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
            whole = np.zeros((docs, 8), np.int64)
            np.add.at(whole, doc[at], sums)
            bits[:, 8 * j : 8 * j + 8] = whole * 2 > n[:, None]
        out[:, lane] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def syndrome(x: np.ndarray) -> np.ndarray:
    s = x.copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        s ^= np.where(s >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return s


def anchors(fingerprint: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, home): for each fingerprint all anchors within covering radius plus threshold.

    The anchors are the pairs of Golay code words; they cover the lower 46 bits with radius 6, and the other 18 bits
    are left free. ``home`` marks each fingerprint's nearest anchor. Two fingerprints that differ in ``threshold`` bits
    or fewer share the first one's home.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the table of patterns holds thresholds 0 to 2")
    patterns, first, upto = coset_table()
    low = (fingerprint & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    high = (fingerprint >> np.uint64(LENGTH) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    s, t = syndrome(low), syndrome(high)
    nearest = (low ^ patterns[first[s]]) | (high ^ patterns[first[t]]) << LENGTH
    most = 2 * RADIUS + threshold
    index, anchor = [], []
    for w in range(most + 1):
        begin = upto[s, w - 1] if w else np.zeros(len(s), np.int64)
        mine, other = upto[s, w] - begin, upto[t, most - w]
        pairs = mine * other
        who = np.repeat(np.arange(len(s)), pairs)
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        a = patterns[first[s][who] + begin[who] + k // other[who]]
        b = patterns[first[t][who] + k % other[who]]
        index.append(who)
        anchor.append((low[who] ^ a) | (high[who] ^ b) << LENGTH)
    index, anchor = np.concatenate(index), np.concatenate(anchor)
    return index, anchor, anchor == nearest[index]


def free_keys(fingerprint: np.ndarray, threshold: int) -> np.ndarray:
    """(n, threshold + 1) numbers from the 18 bits that the anchors leave free, cut into equal parts, above the anchor's 46.

    Fingerprints that differ in ``threshold`` bits agree in one of the parts, so they share that one's number.
    """
    width = (64 - 2 * LENGTH) // (threshold + 1)
    free = (fingerprint >> np.uint64(2 * LENGTH)).astype(np.int64)
    return np.stack([(free >> width * k & (1 << width) - 1) << 2 | k for k in range(threshold + 1)], 1) << 2 * LENGTH


def with_fingerprint(docs: DataFrame, text: str = "text", column: str = "simhash") -> DataFrame:
    """docs, all columns, and the fingerprint as a long (its 64 bits); ``column`` replaces one of that name."""
    rest = [c for c in docs.columns if c != column]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(column, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, text, PIECE):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fingerprints(batch.column(text)).view(np.int64))], names=[*rest, column])

    return docs.mapInArrow(run, schema)


def eights(numbers: np.ndarray) -> pa.Array:
    """Each row of 64-bit numbers as binary."""
    numbers = np.ascontiguousarray(numbers).reshape(len(numbers), -1)
    width = 8 * numbers.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(np.arange(0, len(numbers) * width + 1, width, dtype=np.int32)), pa.py_buffer(numbers)])


def linked(distinct: DataFrame, threshold: int = 2, most: int = GROUP, finer: int = FINER) -> DataFrame:
    """distinct(f long) -> links(a, b) that join any two fingerprints which differ in ``threshold`` bits or fewer.

    A fingerprint lies at home at its nearest anchor and probes all others in reach: only homes are compared with the
    rows of their anchor, which finds every pair, at the home of either. Over ``finer`` fingerprints
    the free bits join the key, which copies rows threefold and makes groups 64 times smaller; the pairs found are the
    same. Each comparison group gives a spanning forest, at most one link per row, so that groups of copies don't give
    links by the square.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = distinct.count() > finer
    distinct = distinct.repartition(parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").to_numpy()
            for i in range(0, len(f), 2000):
                part = f[i : i + 2000]
                index, anchor, home = anchors(part.view(np.uint64), threshold)
                for key in free_keys(part.view(np.uint64), threshold).T if fine else [np.zeros(len(part), np.int64)]:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | key[index]), pa.array(part[index]), pa.array(home)], names=["anchor", "id", "home"])

    rows = in_bounded_groups(distinct.mapInArrow(spread, "anchor long, id long, home boolean"), ["anchor"], "id", most)
    rows = rows.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part", F.col("home").desc())

    def within(rows: pa.RecordBatch) -> pa.RecordBatch:
        g = Groups(rows)
        home = np.asarray(rows.column("home"))
        homes = np.add.reduceat(home.astype(np.int64), g.first) if len(home) else np.zeros(0, np.int64)
        bits = g.ids.view(np.uint64)
        here = np.flatnonzero((g.size[g.group] > 1) & (homes[g.group] > 0))
        for k in range(int(homes.max(initial=0))):
            here = here[(homes[g.group[here]] > k) & (here - g.first[g.group[here]] > k)]
            a = g.first[g.group[here]] + k
            near = np.bitwise_count(bits[a] ^ bits[here]) <= threshold
            g.link(a[near], here[near])
        return g.links()

    return rows.select("anchor", "part", "id", "home", "chunk").mapInArrow(by_group(within), "a long, b long")


class Groups:
    """Rows in the order of (anchor, part): their groups, and a spanning forest of the links found among their ids."""

    def __init__(self, rows: pa.RecordBatch):
        anchor, part, self.ids, self.chunk = (rows.column(c).to_numpy() for c in ("anchor", "part", "id", "chunk"))
        new = np.ones(len(self.ids), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.size = np.bincount(self.group) if len(new) else np.zeros(0, np.int64)
        # a group of two chunks compares across them only
        self.both = (part >> 31) != (part & (1 << 31) - 1)
        self.values, self.item = np.unique(self.ids, return_inverse=True)
        self.trees = Forest(len(self.values))

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ~self.both[a] | (self.chunk[a] != self.chunk[b])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        fine = self.meet(a, b)
        self.trees.link(self.item[a[fine]], self.item[b[fine]])

    def links(self) -> pa.RecordBatch:
        root = self.trees.roots()
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(self.values[tied]), pa.array(self.values[root[tied]])], names=["a", "b"])


def by_group(within: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = 100_000, most_bytes: int = 8 << 20) -> Callable:
    """A function of batches that come in the order of (anchor, part): ``within`` sees whole groups, several at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = size = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            size += batch.nbytes
            if count >= most or size >= most_bytes:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor, part = rows.column("anchor").to_numpy(), rows.column("part").to_numpy()
                last = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
                stop = int(last[-1]) + 1 if len(last) else 0
                if stop:
                    yield within(rows.slice(0, stop))
                held = [rows.slice(stop)]
                count, size = len(rows) - stop, 0
        if count:
            yield within(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return X.lean(run)


def forest(rows: DataFrame, threshold: int, most: int = GROUP) -> DataFrame:
    """rows(anchor long, id long, bits binary) -> links(a, b): rows that share an anchor and differ in few bits.

    Each group of rows gives a spanning forest of these links. Rows of a common anchor are compared chunk by chunk.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_bounded_groups(rows, ["anchor"], "id", most)
    rows = rows.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")

    def within(rows: pa.RecordBatch) -> pa.RecordBatch:
        g = Groups(rows)
        data, _ = X.buffer(rows.column("bits"))
        bits = data.view(np.uint64).reshape(len(g.ids), -1)
        end = np.cumsum(g.size)[g.group]
        here = np.flatnonzero(g.size[g.group] > 1)
        for step in range(1, int(g.size.max(initial=0))):
            here = here[here + step < end[here]]
            if not len(here):
                break
            a = here[g.meet(here, here + step)]
            apart = np.zeros(len(a), np.int64)
            for k in range(bits.shape[1]):
                apart += np.bitwise_count(bits[a, k] ^ bits[a + step, k])
                if k % 4 == 3:  # what differs too much already needs no further lanes
                    a, apart = a[apart <= threshold], apart[apart <= threshold]
            a = a[apart <= threshold]
            g.link(a, a + step)
        return g.links()

    return rows.select("anchor", "part", "id", "bits", "chunk").mapInArrow(by_group(within), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 2) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in ``threshold`` bits or fewer; component_id is the smallest
    doc_id reachable, the document's own included. Texts without words have the fingerprint zero and are linked like
    any other. Repeated rows stay. A null doc_id takes part in links and is never the smallest, unless its whole
    component is null. An empty table gives no rows. Other columns are not read.
    """
    rows = cut(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "text", "f").drop("text"))
    first = cut(rows.groupBy("f").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    common = first.where(F.col("rows") > MOST).select("f", "rows")
    groups = components(linked(first.select("f"), threshold))
    first = first.join(groups, first.f == groups.node, "left").select("f", "low", F.coalesce("component", "f").alias("root"))
    lowest = first.groupBy("root").agg(F.min("low").alias("component_id"))
    of = first.select("f", "root").join(lowest, "root").drop("root")
    return dealt_join(rows, of, ["f"], F.monotonically_increasing_id(), common, MOST).select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


#: Tables of the similarity search, and least hashes that make a table's key: sets of Jaccard similarity j share a key
#: with probability 1 - (1 - j ** ROWS) ** TABLES, 0.998 at 0.8, whatever the edit.
TABLES, ROWS = 12, 4
#: Lanes of 64 bits of the fingerprint that chooses candidates, and bits of it that may differ: at Jaccard similarity 0.8
#: the angle between the sets is acos(1.6 / 1.8), 0.1515 of the bits, 78 with a deviation of 8; three of these are allowed.
DECIDE, DIFFER = 8, 103
#: Shingles of one group of exact comparisons, and what a row weighs besides its own.
SHINGLES, ROW = 500_000, 256


def least(features: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, TABLES) keys: each of the ROWS least hashes of the document's features; documents come in order, repeats change nothing."""
    out = np.zeros((docs, TABLES), np.uint64)
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    if not len(at):
        return out
    for t in range(TABLES):
        x = X.mix(features ^ X.mix(np.array([t + 1], np.uint64)))
        key = np.full(len(at), t, np.uint64)
        for k in range(ROWS):
            key = X.mix(key + np.minimum.reduceat(x * X.powers(0xD1342543DE82EF95, ROWS)[k], at))
        out[doc[at], t] = key
    return out


def signatures(texts: pa.Array, shingle: int = 5) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(sequence, decide, keys): 128 bits that name the word sequence, the fingerprint of shingles, and a row of tables' keys.

    Shingles are the set of all runs of ``shingle`` words (the whole sequence if there are fewer): a repeat counts once.
    A-Z count as a-z. No words: zeros.
    """
    data, offsets = X.buffer(texts)
    raw = X.FOLD[data].tobytes()
    sequence = [xxhash.xxh3_128_digest(b" ".join(raw[a:b].split())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    starts, ends, first = X.words(data, offsets)
    docs, size = len(offsets) - 1, np.diff(first)
    h = X.hash_spans(data, starts, ends, True)
    doc = np.repeat(np.arange(docs), size)
    place = np.arange(len(h)) - first[doc]
    base = 0xD1342543DE82EF95
    run = np.minimum(shingle, size)[doc]
    runs = h.copy()
    for k in range(1, shingle):
        more = np.flatnonzero((run > k) & (place + k < size[doc]))
        runs[more] += h[more + k] * X.powers(base, shingle)[k]
    whole = place + run <= size[doc]
    features, doc = X.mix(runs[whole]), doc[whole]
    order = np.lexsort((features, doc))
    features, doc = features[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (features[1:] != features[:-1]) | (doc[1:] != doc[:-1])
    features, doc = features[new], doc[new]
    return sequence, lanes(features, doc, docs, DECIDE), least(features, doc, docs)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The set of a text's shingles as rising XXH64 of their bytes, words lower-cased (A-Z) and joined by a space."""
    parts = X.FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()
    if not parts:
        return np.zeros(0, np.uint64)
    run = min(shingle, len(parts))
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(parts[i : i + run]), 42) for i in range(len(parts) - run + 1)}), np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def compared(rows: DataFrame, most: int = SHINGLES) -> DataFrame:
    """rows(component long, node long, keys binary, text) -> links(a, b) between texts of a component that are similar.

    Two texts that share the key of a table are compared by their whole sets of shingles, unless links join them
    already. Components of more than ``most`` shingles are compared chunk by chunk, all pairs of chunks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, "text", SIGNED):
            found = [shingle_set(t) for t in batch.column("text").to_pylist()]
            weight = pa.array([ROW + len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("node"), batch.column("keys"), pa.array([x.tobytes() for x in found], pa.binary()), weight], names=["anchor", "id", "keys", "shingles", "weight"])

    rows = cut(rows.select("component", "node", "keys", "text").mapInArrow(X.lean(sets), "anchor long, id long, keys binary, shingles binary, weight long"))
    rows = in_bounded_groups(rows, ["anchor"], "id", most, F.col("weight"))
    rows = rows.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part")

    def within(rows: pa.RecordBatch) -> pa.RecordBatch:
        g = Groups(rows)
        data, _ = X.buffer(rows.column("keys"))
        keys = data.view(np.uint64).reshape(len(g.ids), -1)
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        end = np.cumsum(g.size)[g.group]
        here = np.flatnonzero(g.size[g.group] > 1)
        for step in range(1, int(g.size.max(initial=0))):
            here = here[here + step < end[here]]
            if not len(here):
                break
            a = here[g.meet(here, here + step)]
            a = a[(keys[a] == keys[a + step]).any(1)]
            a = a[g.trees.find(g.item[a]) != g.trees.find(g.item[a + step])]
            near = np.array([similar(shingles[i], shingles[i + step]) for i in a.tolist()], bool)
            g.link(a[near], a[near] + step)
        return g.links()

    return rows.select("anchor", "part", "id", "keys", "shingles", "chunk").mapInArrow(by_group(within), "a long, b long")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = GROUP) -> DataFrame:
    """docs, all columns, with one document of each group of near-duplicates: the one of smallest doc_id.

    Near-duplicates are linked texts and what links reach: equal word sequences (A-Z as a-z), and texts whose sets of
    5-word shingles have a similarity of 0.8 or more; no other texts are linked. Candidates share the key of one of the
    tables, each of a few least hashes of the set: 0.998 of pairs at 0.8 do, and more above, however the words that
    differ lie. Their SimHash of 512 bits, of the same set, says which of them may be similar; what these links join is
    compared by whole sets, and only links that hold there count. Groups give spanning forests, never their pairs.

    Texts without words, nulls too, are one group. Repeated rows and rows of equal id and text count once. A null
    doc_id is the largest. An empty table gives no rows. Working columns begin with an underscore and two letters.
    """
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    row = F.concat(F.length(name).cast("string"), F.col(doc_id).isNull().cast("string"), name, F.coalesce(F.concat(F.lit("="), F.col(text).cast("string")), F.lit("")))
    keyed = docs.withColumn("_sk", F.md5(row))
    plain = keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), "_sk")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.pieces(batches, "text", SIGNED):
            sequence, decide, keys = signatures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_sk"), pa.array(sequence, pa.binary()), eights(decide), eights(keys)], names=["doc_id", "_sk", "sequence", "bits", "keys"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    signed = cut(plain.mapInArrow(X.lean(sign), f"doc_id {kind}, _sk string, sequence binary, bits binary, keys binary"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a sequence of words once, with its first document
    first = signed.groupBy("sequence").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_sk")).alias("low"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    first = cut(first.select("low", "bits", "keys", F.monotonically_increasing_id().alias("id")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                batch = whole.slice(i, 2000)
                data, _ = X.buffer(batch.column("keys"))
                anchor = data.view(np.uint64).reshape(len(batch), -1).view(np.int64).ravel()
                took = batch.take(pa.array(np.repeat(np.arange(len(batch)), TABLES)))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), took.column("id"), took.column("bits")], names=["anchor", "id", "bits"])

    spreaded = first.select("id", "bits", "keys").repartition(parts).mapInArrow(X.lean(spread), "anchor long, id long, bits binary")
    maybe = components(cut(forest(spreaded, DIFFER, most)))
    asked = first.join(maybe, first.id == maybe.node).select("component", "node", "keys", F.col("low._sk").alias("_st"))
    met = plain.join(cut(asked), plain["_sk"] == F.col("_st")).groupBy("_sk").agg(*(F.first(c).alias(c) for c in ("component", "node", "keys", "text")))
    groups = components(cut(compared(met)))
    first = first.join(groups, first.id == groups.node, "left").withColumn("root", F.coalesce("component", "id"))
    kept = first.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low._sk").alias("_st"))
    return keyed.join(kept, keyed["_sk"] == kept["_st"], "left_semi").dropDuplicates(["_sk"]).drop("_sk")

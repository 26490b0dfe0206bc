"""Byte-level BPE with word ends: encoding by batched merge rounds in numpy, and decoding.

The vocabulary is a ``tokenizers`` JSON file that the caller names. Only the driver reads it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidebook.llm import text as X

#: Bytes of text that the kernel takes at a time.
PIECE = 2 << 20
#: Runs of text, and words, whose ids a worker remembers, and bytes of them; beyond that it forgets them all and goes on.
REMEMBERED, REMEMBERED_BYTES = 700_000, 64 << 20
#: Bytes from which on a word goes through its rounds alone.
LONG = 1024


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


@dataclass
class Vocabulary:
    """Merge table as sorted pair keys, and the split rules of the file."""

    tokens: list[str]
    pair_key: np.ndarray
    pair_rank: np.ndarray
    pair_into: np.ndarray
    inner: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte at a word's end
    pattern: str
    special: dict[str, int]
    spec: str
    _compiled: list = field(default_factory=list, repr=False)

    @staticmethod
    def read(path: str) -> Vocabulary:
        """Of a BPE file with an end-of-word suffix whose text steps are: NFC, white space to a space, lower case, keep what a pattern finds, bytes to letters."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        spec = json.loads(text)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, by_byte = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or by_byte["type"] != "ByteLevel" or spec["decoder"]:
            raise ValueError("the file asks for text steps that this encoder doesn't have")
        end = model["end_of_word_suffix"]
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for token, k in [*ids.items(), *special.items()]:
            tokens[k] = token
        left, right, into = (np.array(c, np.int64) for c in zip(*((ids[a], ids[b], ids[a + b]) for a, b in model["merges"]), strict=True))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        letters = byte_letters()
        return Vocabulary(tokens, key[order], order.astype(np.int64), into[order], np.array([ids[c] for c in letters]), np.array([ids[c + end] for c in letters]), split["pattern"]["Regex"], special, text)

    def words(self, chunk: str) -> list[bytes | int]:
        """What a run of text without ASCII white space is split into: words as UTF-8, or ids of special tokens."""
        if not self._compiled:
            marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
            library = Tokenizer.from_str(self.spec)
            self._compiled += [regex.compile(self.pattern), regex.compile(f"({marks})") if marks else None, library, {c: b for b, c in enumerate(byte_letters())}]
        find, marks, library, byte = self._compiled
        out: list[bytes | int] = []
        for part in marks.split(chunk) if marks and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part and max(part) < "\u0180" and "\xa0" not in part and "\x85" not in part and "İ" not in part:
                # composed letters of one case pair each, and no white space: the text steps come to this
                out += [w.encode() for w in find.findall(part.lower())]
            elif part:
                # the library's own Unicode tables
                pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
                out += [bytes(map(byte.__getitem__, w)) for w, _ in pieces]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of word k are ids[first[k]:first[k + 1]]; no word is empty.

        All words lie in one flat array. In a round each word's lowest-ranked pair is found by binary search of all
        neighbouring pairs among the sorted pair keys, and merged wherever it stands in that word, from the left where
        it overlaps itself. Merges made of a pair rank behind it, so this is the order of one merge at a time. Words
        without a known pair leave the array. A word of LONG bytes or more has rounds of its own.
        """
        if any(len(w) >= LONG for w in words):
            short = [w for w in words if len(w) < LONG]
            ids, first = self.merge(short) if short else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            rest = iter(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            lists = [self.merge_long(w) if len(w) >= LONG else ids[slice(*next(rest))] for w in words]
            return np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        stop = np.cumsum(size)
        ids = self.inner[data]
        ids[stop - 1] = self.last[data[stop - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_words = [], []
        never = np.int64(1 << 40)
        while len(ids):
            rank = np.full(len(ids), never)
            into = np.zeros(len(ids), np.int64)
            if len(ids) > 1:
                at, known = self.look_up(ids[:-1], ids[1:])
                known &= word[:-1] == word[1:]
                rank[:-1][known] = self.pair_rank[at[known]]
                into[:-1][known] = self.pair_into[at[known]]
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, begins)
            length = np.diff(np.r_[begins, len(ids)])
            best = np.repeat(lowest, length)
            over = best == never
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                on = ~over
                ids, word, rank, into, best = ids[on], word[on], rank[on], into[on], best[on]
                if not len(ids):
                    break
            hit = rank == best
            place = np.flatnonzero(hit)
            # in a run of neighbouring hits (a pair of one symbol) every other one, from the left
            run = np.r_[True, np.diff(place) != 1]
            first = place[run][np.cumsum(run) - 1]
            place = place[(place - first) % 2 == 0]
            ids[place] = into[place]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            ids, word = ids[keep], word[keep]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the sorted keys, whether it is there) of pairs of symbols."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return at, self.pair_key[at] == key

    def merge_long(self, text: bytes) -> np.ndarray:
        """The ids of one word, by the same rounds, each over the places of the lowest-ranked pair alone.

        Symbols are a linked list; a round looks up only the pairs that it made, so a word of n bytes takes about
        n log n steps however many rounds it needs.
        """
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        ids = self.inner[data]
        ids[-1] = self.last[data[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        found = np.full(n, -1)  # place of a symbol's pair in the sorted keys, -1 without one
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(place: np.ndarray) -> None:
            place = place[(place >= 0) & (after[np.maximum(place, 0)] < n)]
            at, known = self.look_up(ids[place], ids[after[place]])
            found[place] = np.where(known, at, -1)
            place, rank = place[known], self.pair_rank[at[known]]
            order = np.argsort(rank, kind="stable")
            place, rank = place[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(place, cuts), rank[np.r_[0, cuts]].tolist() if len(rank) else [], strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(part)

        look(np.arange(n - 1))
        while ranks:
            r = heappop(ranks)
            place = np.unique(np.concatenate(waiting.pop(r)))
            place = place[(found[place] >= 0) & (self.pair_rank[found[place]] == r)]
            if not len(place):
                continue
            run = np.r_[True, place[1:] != after[place[:-1]]]
            start = np.flatnonzero(run)
            turn = np.arange(len(place)) - start[np.cumsum(run) - 1]
            place = place[turn % 2 == 0]
            gone = after[place]
            ids[place] = self.pair_into[found[place]]
            found[gone] = -1
            found[place] = -1
            beyond = after[gone]
            after[place] = beyond
            inside = beyond < n
            before[beyond[inside]] = place[inside]
            before[gone] = -2
            look(np.unique(np.concatenate((place, before[place]))))
        return ids[before != -2]


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at:at + size], one after the other."""
    before = np.cumsum(size) - size
    return flat[np.arange(size.sum()) + np.repeat(at - before, size)]


class Lists:
    """Lists of ids by the bytes (or id) that they stand for, in one flat array; ``held`` counts what the keys take."""

    def __init__(self) -> None:
        self.number: dict = {}
        self.held = 0
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: list, flat: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.held += sum(len(k) for k in keys if not isinstance(k, int))
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        return gather(self.flat, self.at[numbers], size), size


class Encoder:
    """Encodes texts; remembers runs of text and their words between calls, each by its bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.chunks, self.words = Lists(), Lists()

    def learn(self, chunks: list[bytes]) -> None:
        """Remembers the ids of new runs of text; their new words go through the merge rounds in one batch."""
        parts: list[bytes | int] = []
        count = []
        for c in chunks:
            if c.isalpha():
                parts.append(c.lower())
                count.append(1)
            elif c[:-1].isalpha() and c[-1:] in b".,:;!?":
                parts += (c[:-1].lower(), c[-1:])
                count.append(2)
            else:
                found = self.vocabulary.words(c.decode("utf-8", "replace"))
                parts += found
                count.append(len(found))
        number = self.words.number
        if new := [*dict.fromkeys(w for w in parts if w not in number)]:
            special = [w for w in new if isinstance(w, int)]
            spelled = [w for w in new if not isinstance(w, int)]
            if spelled:
                ids, first = self.vocabulary.merge(spelled)
                self.words.add(spelled, ids, np.diff(first))
            self.words.add(special, np.array(special, np.int32), np.ones(len(special), np.int64))
        ids, size = self.words.take(np.array([number[w] for w in parts], np.int64))
        ends = np.concatenate(([0], np.cumsum(size)))
        stop = np.cumsum(np.array(count, np.int64))
        self.chunks.add(chunks, ids, np.diff(np.concatenate(([0], ends[stop]))))

    def ids(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, size) of runs of text, one after the other."""
        for known in (self.chunks, self.words):
            if len(known.at) > REMEMBERED or known.held > REMEMBERED_BYTES:
                known.__init__()
        number = self.chunks.number
        if new := [r for r in dict.fromkeys(runs) if r not in number]:
            self.learn(new)
        return self.chunks.take(np.fromiter(map(number.__getitem__, runs), np.int64, len(runs)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text k are ids[first[k]:first[k + 1]]."""
        data, offsets = X.buffer(texts)
        raw = data.tobytes()
        size = np.zeros(len(offsets) - 1, np.int64)
        out = [np.zeros(0, np.int32)]
        for spans in portions(raw, offsets.tolist()):
            found = [raw[a:b].split() for _, a, b in spans]
            ids, each = self.ids([run for runs in found for run in runs])
            ends = np.concatenate(([0], np.cumsum(each)))
            stop = np.cumsum([len(runs) for runs in found])
            np.add.at(size, [k for k, _, _ in spans], np.diff(np.concatenate(([0], ends[stop]))))
            out.append(ids)
        return np.concatenate(out), np.concatenate(([0], np.cumsum(size)))


_GAP = re.compile(rb"[\x20\x09-\x0d]")


def portions(raw: bytes, offsets: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) that hold about PIECE bytes each; longer texts are cut at white space."""
    held, size = [], 0
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        while a < b:
            gap = _GAP.search(raw, a + PIECE, b) if b - a > PIECE else None
            stop = gap.end() if gap else b
            held.append((k, a, stop))
            size += stop - a
            a = stop
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def decode(ids: np.ndarray, first: np.ndarray, tokens: list[str]) -> list[str]:
    """The texts of lists of ids: their tokens joined by a space, as the library does for files without a decoder."""
    spelled = np.array(tokens, object)[ids].tolist()
    return [" ".join(spelled[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs, all columns, and ``ids`` array<int>; with ``decoded`` also the text that decoding these ids gives.

    Whole texts are encoded without special tokens being added; strings of special tokens in a text become their ids,
    as in the library. A null or empty text, or one of white space only, has no ids. Rows stay where they are: no
    shuffle. New columns replace old ones of their names.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    new = [ids, *([decoded] if decoded else [])]
    rest = [c for c in docs.columns if c not in new]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in X.pieces(batches, text, PIECE):
            found, first = encoder(batch.column(text))
            made = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found))]
            if decoded:
                made.append(pa.array(decode(found, first, vocabulary.value.tokens), pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, *new])

    return docs.mapInArrow(X.lean(run), schema)


def decode_column(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows, all columns, and the text of ``ids``; null ids give an empty text. ``decoded`` replaces a column."""
    tokens = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(path).tokens)
    rest = [c for c in rows.columns if c != decoded]
    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids).fill_null([])
            size = np.array([len(x) for x in lists], np.int64)
            first = np.concatenate(([0], np.cumsum(size)))
            texts = decode(np.asarray(lists.flatten(), np.int64), first, tokens.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, decoded])

    return rows.mapInArrow(X.lean(run), schema)


def digests(rows: DataFrame, keep: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """keep, n_tokens, and SHA-256 of the decimal ids joined by a space and of the decoded text."""
    return rows.select(
        keep,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )

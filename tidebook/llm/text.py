"""Numpy kernels over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so it never depends on a locale or a Unicode
version. Every kernel works on an Arrow string column's own buffer: no Python string is made for a word.
"""

from __future__ import annotations

import ctypes
import itertools
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that one call of the hashing kernel takes at a time (its temporaries take about 40 times as much).
PIECE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FOLDED = _BYTE[FOLD]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(1 << max(n - 1, 0).bit_length(), np.uint64(base & (1 << 64) - 1))
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


def trim() -> None:
    """Gives free memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; its worker, which waits for other tasks afterwards, keeps no free memory meanwhile."""

    @wraps(run)
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't ``apart``, cut at the texts' ends."""
    inside = ~apart
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= apart[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= apart[1:]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of data[start:end]; the spans are in order and don't overlap. fold: A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTE_FOLDED if fold else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.multiply(table[data[low:high]], powers(_BASE, high - low), out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * powers(_INVERSE, high - low)[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        i = j
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans, and for text k its words first[k] .. first[k + 1]."""
    starts, ends = runs(SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, digests, size): the number of each word's distinct word, in the order of ``words``, the two halves of each
    distinct word's XXH3 of 128 bits, and the words of each text. Words are told apart by their bytes."""
    starts, ends, first = words(data, offsets)
    body = data.tobytes().translate(FOLD.tobytes() if fold else None, np.flatnonzero(SPACE).astype(np.uint8).tobytes())
    edge = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=edge[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(body)]).dictionary_encode()
    raw, edge = buffer(found.dictionary)
    raw, edge = raw.tobytes(), edge.tolist()
    digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in itertools.pairwise(edge)])
    return found.indices.to_numpy().astype(np.int64), np.frombuffer(digests, np.uint64).reshape(-1, 2), np.diff(first)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, in the order of ``words``."""
    which, digests, _ = distinct_words(data, offsets, fold)
    return digests[which, 0], digests[which, 1]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        _, offsets = buffer(batch.column(text))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j

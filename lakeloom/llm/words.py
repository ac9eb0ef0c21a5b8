"""Words and shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)
#: The lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)

#: Byte classes. SPACED: only \x20 and \x09-\x0D part words. PLAIN: so does ASCII that is neither letter nor digit.
SPACED = np.zeros(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
#: A-Z lower-cased, all else as it is.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


#: Bytes of text that are worked on at a time.
STEP_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on one another."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after the other, and the n + 1 offsets. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(data: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about STEP_BYTES of text each."""
    _, offsets = text_bytes(data.column(column))
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
        yield data.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Hashes of the words of several texts, in order. first[i]:first[i + 1] are those of text i."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: its pieces of eight bytes, each mixed with its place, summed, and
    mixed again with the length. Equal bytes give equal hashes wherever they stand; different ones, of any length,
    give equal ones about once in 2 ** 64 pairs."""
    if not len(start):
        return np.zeros(0, np.uint64)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    length = end - start
    pieces = np.maximum(1, (length + 7) >> 3)
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    value = eight[np.repeat(start, pieces) + 8 * place] & _LOW[np.clip(np.repeat(length, pieces) - 8 * place, 0, 8)]
    value = mix(value + (place + 1).astype(np.uint64) * _STEP)
    return mix((np.add.reduceat(value, first) if len(value) > len(start) else value) + length.astype(np.uint64) * _ODD)


def word_hash(word: str) -> np.uint64:
    """The hash that words_of() gives a word."""
    data = LOWER[np.frombuffer(word.encode("utf-8", "surrogateescape"), np.uint8)]
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of marked bytes begin and end; a text's end ends a run."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words_of(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACED) -> Words:
    """Words of any length: a text that is one word of many megabytes is one word."""
    if len(data):
        start, end = runs_of(~parts[data], offsets)
        if len(start):
            return Words(span_hashes(LOWER[data], start, end), np.searchsorted(start, offsets), start, end)
    none = np.zeros(0, np.int64)
    return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one run of words; with fewer words, of the whole run as one."""
    if len(hashes) == 0:
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(k))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    if len(words.hashes) == 0:
        return [words.hashes for _ in range(len(words.first) - 1)]
    # All at once where a text has k words; shingles across two texts are never looked at.
    every = shingle_hashes(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - k + 1] if b - a >= k else shingle_hashes(words.hashes[a:b], k)))
    return out

"""Dense features of whole texts, many texts at once."""

from __future__ import annotations

import numpy as np

from lakeloom.llm.words import SPACED, words_of

NAMES = (
    "words", "word_bytes", "distinct", "top_word", "repeats", "long_words", "caps_words", "doubled_marks",
    "upper", "digits", "spaces", "beyond_ascii", "marks", "exclaims", "pipes", "stops", "lines", "distinct_lines", "line_words",
)

_C = np.arange(256)
_UPPER, _DIGIT, _BEYOND = (_C >= 65) & (_C <= 90), (_C >= 48) & (_C <= 57), _C >= 128
_LETTER = _UPPER | ((_C >= 97) & (_C <= 122)) | _BEYOND
_MARK = ~(_LETTER | _DIGIT | SPACED) & (_C > 32) & (_C < 127)
_NEWLINE = _C == 10


#: A capital counts 1 in the lower half of a number, any letter 1 in the upper half.
_CASE = _UPPER + (_LETTER.astype(np.int64) << 32)


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float64)


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 256): how often each byte stands in each text."""
    out = np.zeros((len(offsets) - 1, 256))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a < b:
            out[i] = np.bincount(data[a:b], minlength=256)
    return out


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many different hashes, and how often the most common one stands. Hashes give up the bits
    that the number of the text takes, so that one sort does."""
    texts = len(first) - 1
    bits = np.uint64(max(1, texts).bit_length())
    owner = np.repeat(np.arange(texts, dtype=np.uint64), np.diff(first))
    key = np.sort((owner << (np.uint64(64) - bits)) | (hashes >> bits))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([starts, [len(key)]]))
    own = (key[starts] >> (np.uint64(64) - bits)).astype(np.int64)
    top = np.zeros(texts)
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    if len(own):
        top[own[heads]] = np.maximum.reduceat(runs, heads)
    return np.bincount(own, minlength=texts).astype(np.float64), top


def dense_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)); an empty text is all zeros."""
    words = words_of(data, offsets, SPACED)
    lines = words_of(data, offsets, _NEWLINE)
    n_bytes = np.maximum(1, np.diff(offsets)).astype(np.float64)
    n_words = np.diff(words.first).astype(np.float64)
    per_word, n_lines = np.maximum(1, n_words), np.diff(lines.first).astype(np.float64)
    length = words.end - words.start
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.first[:-1][np.diff(words.first) > 0]] = False
    case = np.concatenate([[0], np.cumsum(_CASE[data])])
    case = case[words.end] - case[words.start]
    ups, letters = case & (2**32 - 1), case >> 32
    last = data[words.end - 1] if len(words.end) else data
    doubled = (length > 2) & _MARK[last] & (data[np.maximum(words.end - 2, 0)] == last) if len(words.end) else np.zeros(0, bool)
    distinct, top = _distinct(words.hashes, words.first)
    distinct_lines, _ = _distinct(lines.hashes, lines.first)
    counts = byte_counts(data, offsets)
    by = lambda f: counts @ f / n_bytes
    letters_of = np.maximum(1, counts @ _LETTER)
    columns = [
        np.log1p(n_words), _per(length, words.first) / per_word, distinct / per_word, top / per_word, _per(same, words.first) / per_word,
        _per(length > 20, words.first) / per_word, _per((ups > 1) & (ups == letters), words.first) / per_word, _per(doubled, words.first) / per_word,
        counts @ _UPPER / letters_of, by(_DIGIT), by(SPACED), by(_BEYOND), by(_MARK),
        by(_C == 33), by(_C == 124), by(_C == 46), np.log1p(n_lines), distinct_lines / np.maximum(1, n_lines), np.log1p(n_words / np.maximum(1, n_lines)),
    ]
    out = np.stack(columns, axis=1)
    out[np.diff(offsets) == 0] = 0
    return out

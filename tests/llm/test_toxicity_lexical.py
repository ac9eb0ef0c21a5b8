import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm.stats import NAMES, dense_stats
from lakeloom.llm.toxicity import LONGEST, NEAR, SECOND, SEED_WORDS, STEM, Lexicon, matrix
from lakeloom.llm.words import span_hashes, text_bytes, word_hash, words_of

LEXICON = Lexicon({"bogus": 3.0, "mild": 0.7, "größe": 1.5}, {"bogus": 2.0, "schlu": 0.9})
MASKS = str.maketrans("@$!013457", "asioieast")


def plain(text):
    """The same figures, text by text, with regular expressions."""
    data = text.encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", data)]
    n, distinct = max(1, len(words)), max(1, len(set(re.findall(rb"[^\x20\x09-\x0d]+", data.lower()))))
    known = {w.encode(): v for w, v in LEXICON.words.items()}
    seeds, second = {w.encode() for w in SEED_WORDS}, {w.encode() for w in SECOND}
    insults = seeds | {w for w, v in known.items() if v > 1}
    at = [i for i, w in enumerate(words) if w in insults]
    near = sum(any(w in second for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    weights = sorted((known[w] for w in set(words) if w in known), reverse=True)
    stems = sorted((LEXICON.stems[s] for s in {w[:STEM].decode("utf-8", "surrogateescape") for w in words if len(w) > STEM} if s in LEXICON.stems), reverse=True)
    masked = [m for m in re.findall(r"[A-Za-z0-9@$!*#]+", text) if re.search(r"[0-9@$!*#][A-Za-z]", m)]
    spelled = [m.group() for m in re.finditer(r"(?<![A-Za-z0-9\x80-\U0010ffff])(?:[A-Za-z][ .\-]){3,}[A-Za-z](?![A-Za-z0-9\x80-\U0010ffff])", text)]
    insult = lambda w: w.encode() in insults
    return [
        len(at) / n, len(set(words) & seeds), len(set(words) & seeds) / distinct, sum(weights) / distinct, max(weights, default=0), sum(weights[:5]),
        sum(stems) / distinct, max(stems, default=0), sum(stems[:5]), len(set(words) & second), near / n, near / max(1, len(at)),
        len(masked) / n, sum(insult(m.rstrip("!*#").lower().translate(MASKS)) for m in masked if len(m) <= LONGEST), sum(insult(re.sub(r"[ .\-]", "", m).lower()) for m in spelled), len(spelled) / n,
        len(re.findall(r"([A-Za-z])\1\1+", text)) / n,
    ]


def texts(seed):
    rng = random.Random(seed)
    pieces = ["you", "Idiot", "1d10t", "m0r@n!!", "i d i o t", "a-b.c d", "s.t.u.p.i.d", "x y", "größe", "Schluss", "bogus", "bogusly", "mild", "42nd", "3", "sooo", "AAAA", "é", "\n", "$$", "nice", "words", "!!!", "5", "9 a b c d", "a b c d 9", "ab3c", "d"]
    out = ["".join(rng.choice(pieces) + rng.choice([" ", " ", ".", "-", ""]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    return [*out, "", "a", "7", "aaa", "1a", "a1a" * 100]


@pytest.mark.parametrize("seed", [0, 1])
def test_all_at_once_equals_one_by_one(seed):
    every = texts(seed)
    data, offsets = text_bytes(pa.array(every))
    got = LEXICON.lexical(data, offsets, dense_stats(data, offsets))
    for text, row in zip(every, got, strict=True):
        assert np.allclose(row, plain(text), rtol=1e-12), (text, row, plain(text))
        assert np.array_equal(row, LEXICON.features(text))


@pytest.mark.parametrize("text", ["a" * 5_000_000, "1" * 5_000_000, "a1" * 2_500_000, "a " * 2_500_000, "!a" * 2_500_000, "é" * 2_500_000])
def test_one_long_text_takes_seconds(text):
    start = time.perf_counter()
    x = matrix(LEXICON, pa.array([text]))
    assert x.shape[1] == len(NAMES) + 17 and np.isfinite(x).all() and time.perf_counter() - start < 20


def test_word_hashes_see_every_byte_and_length():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab\0\1") for _ in range(rng.randint(1, 20))) for _ in range(3000)} | {b"a" * n for n in range(1, 60)})
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    assert len(np.unique(span_hashes(data, end - [len(w) for w in words], end))) == len(words)
    data, offsets = text_bytes(pa.array(["Some words", "words SOME  größe"]))
    assert words_of(data, offsets).hashes.tolist() == [word_hash(w) for w in ("some", "words", "words", "some", "größe")]
    # Equal bytes two to the twentieth places apart may not change places unseen.
    long = bytearray(b"x" * (1 << 20) + b"y" * 16)
    other = long.copy()
    other[0], other[1 << 20] = other[1 << 20], other[0]
    both = np.frombuffer(bytes(long + other), np.uint8)
    a, b = span_hashes(both, np.array([0, len(long)]), np.array([len(long), 2 * len(long)]))
    assert a != b

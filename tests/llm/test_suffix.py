import random

import numpy as np
import pytest

from brute import cut_passages
from lakeloom.llm import suffix
from lakeloom.llm.suffix import common_prefixes, repeated_passages, suffix_array


def corpus(seed=1):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcde é\n") for _ in range(n))
    passages = [make(n) for n in (49, 50, 51, 60, 75, 120, 400)]
    docs = [make(rng.randint(0, 300)) for _ in range(30)]
    for _ in range(60):
        parts = [make(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            parts += [p[a : len(p) - rng.randint(0, 5)], make(rng.randint(0, 30))]
        docs.append("".join(parts))
    docs += [docs[3], docs[70], "z" * 500, "z" * 49, "z" * 50, "ab" * 300, "\0" * 120, "\0" * 60 + "q", "", None, passages[4], passages[4] + passages[5]]
    return docs


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, chunk int, doc string").repartition(3)


def as_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_those_of_all_windows(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix, "BUCKET_ANCHORS", 300)
    monkeypatch.setattr(suffix, "BUCKET_CONTEXTS", 20)
    docs = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(docs)
    want = cut_passages(docs, 50)
    assert sum(r[2] for r in want) > 3000
    assert as_rows(repeated_passages(frame(spark, docs))) == sorted(want, key=repr)


def test_other_lengths(spark):
    docs = list(enumerate(corpus(3)))
    for n in (40, 77):
        assert as_rows(repeated_passages(frame(spark, docs), length=n)) == sorted(cut_passages(docs, n), key=repr)
    with pytest.raises(ValueError):
        repeated_passages(frame(spark, docs), length=20)


def test_equal_and_null_ids_and_empty_tables(spark):
    text = "The quick brown fox jumps over the lazy dog, and then it does so again and again."
    rows = [(2, text), (2, text), (1, "x" + text), (None, text[:60]), (3, text * 3)]
    got = as_rows(repeated_passages(frame(spark, rows)))
    want = [(None if r[0] == -1 else r[0], *r[1:]) for r in cut_passages([(-1 if i is None else i, t) for i, t in rows], 50)]
    assert got == sorted(want, key=repr)
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_borders_are_those_of_common_prefixes():
    rng = np.random.default_rng(6)
    for n, letters in ((60, 2), (400, 3), (200, 1)):
        codes = np.concatenate([rng.integers(1, letters + 1, n), [0]])
        order = suffix_array(codes, 4)
        suffixes = [codes[i:].tolist() for i in order]
        assert suffixes == sorted(suffixes)
        for length in (1, 2, 5, 30):
            want = [True] + [a[:length] != b[:length] or min(len(a), len(b)) < length for a, b in zip(suffixes, suffixes[1:], strict=False)]
            assert common_prefixes(codes, order, length).tolist() == want


@pytest.mark.parametrize("hot", [2, 1024])
def test_common_k_grams_in_steps(monkeypatch, hot):
    """The smallest doc of every window, by brute force, with and without the steps for common k-grams."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(hot)
    length, before = 50, 50 - suffix.GRAM
    lines = ["".join(rng.choice("ab") for _ in range(before)) for _ in range(3)]
    contexts = set()
    for _ in range(400):
        n = rng.choice([0, 1, 2, 3, 5, 9, before])
        left = ("".join(rng.choice("xy") for _ in range(before)) + rng.choice(lines))[-before - n :][:before] if rng.random() < 0.5 else "".join(rng.choice("xy") for _ in range(before - 8)) + rng.choice(["pqrstuvw", "pqrstuvz"])
        right = rng.choice(lines)[: rng.choice([before, before, 20, 7])]
        right += "".join(rng.choice("xy") for _ in range(before - len(right)))
        contexts.add((rng.randint(0, 1), left, right, rng.choice([before, before, 12, 0]), rng.choice([length, length, 40])))
    contexts = sorted(contexts)
    gram = np.array([c[0] for c in contexts], np.int64)
    rows = np.zeros((len(contexts), before + length), np.uint8)
    for i, (g, left, right, a, b) in enumerate(contexts):
        text = (left + "GH"[g] * suffix.GRAM + right).encode()
        rows[i] = np.frombuffer(text, np.uint8)
        rows[i, : before - a] = 0
        rows[i, before + b :] = 0
    left, right = np.array([c[3] for c in contexts]), np.array([c[4] for c in contexts])
    docs = np.array(rng.sample(range(1000), len(contexts)), np.int64)
    least: dict = {}
    for i in range(len(contexts)):
        for j in range(before + 1):
            if j >= before - left[i] and j + length <= before + right[i]:
                w = rows[i, j : j + length].tobytes()
                least[w] = min(least.get(w, 10**9), docs[i])
    got = suffix._least_docs(rows, left, right, docs, gram, length)
    for i in range(len(contexts)):
        for j in range(before + 1):
            real = j >= before - left[i] and j + length <= before + right[i]
            assert got[i, j] == (least[rows[i, j : j + length].tobytes()] if real else suffix._FAR), (i, j)

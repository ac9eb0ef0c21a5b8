"""K-grams with more contexts than one task should compare."""

import random

import numpy as np
import pytest

from brute import cut_passages
from lakeloom.llm import suffix
from lakeloom.llm.suffix import repeated_passages


def crowded(seed):
    """Lines in most texts, with much that differs before, behind and on both sides of them."""
    rng = random.Random(seed)
    make = lambda n, of="xyz": "".join(rng.choice(of) for _ in range(n))
    line, phrase = "Copyright of all the authors, reserved. ", "in the united states "
    before, behind = [make(34) for _ in range(6)], [make(34) for _ in range(6)]
    out = []
    for i in range(250):
        a, b = rng.choice(before)[rng.randint(0, 30) :], rng.choice(behind)[: rng.randint(0, 34)]
        out.append((i, make(rng.randint(0, 5)) + a + rng.choice([line, phrase, phrase[3:], line[:20]]) + b + make(rng.randint(0, 5))))
    out += [(300 + i, t) for i, (_, t) in enumerate(out[:5])] + [(7, out[9][1]), (None, line * 3), (400, None), (401, "x" * 300)]
    return out


@pytest.mark.parametrize("crowd, hot", [(3, 2), (3, 1024), (10**6, 2), (40, 20)])
def test_bytes_equal_those_of_all_windows(spark, monkeypatch, crowd, hot):
    for name, value in (("CROWD", crowd), ("HOT", hot), ("CHUNK_BYTES", 1500), ("BUCKET_ANCHORS", 200), ("BUCKET_CONTEXTS", 20)):
        monkeypatch.setattr(suffix, name, value)
    docs = crowded(crowd + hot)
    random.Random(1).shuffle(docs)
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = [(None if r[0] == -1 else r[0], *r[1:]) for r in cut_passages([(-1 if i is None else i, t) for i, t in docs], 50)]
    assert sum(r[2] for r in want) > 1000
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_reaches_are_each_in_one_part():
    for before in range(24, 105):
        parts = suffix._reaches(before)
        assert [r for low, high in parts for r in range(low, high + 1)] == list(range(before + 1))
        assert parts[0] == (0, 0) and parts[-1] == (before, before)


def test_a_crowd_is_dealt_by_more_than_its_k_gram():
    """Contexts of one k-gram, in a part of their reaches: keys differ, or what they are cut to is equal."""
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 123, (5000, 84), np.uint8)
    rows[:, 34:] = rows[0, 34:]  # a line begins here
    near = suffix.Contexts(rows, np.full(5000, 34), np.full(5000, 34), np.arange(5000), 0, 34)
    assert len(np.unique(near.keys())) == 1 and len(near.distinct()[0]) == 5000
    for low, high in suffix._reaches(34):
        part, at = near.narrow(low, high)
        assert len(at) == 5000
        lead = part.distinct()[0]
        most = np.unique(part.take(lead).keys(), return_counts=True)[1].max()
        assert most <= 1000, (low, high, most)

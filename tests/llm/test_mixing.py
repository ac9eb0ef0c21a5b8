import random
import re

import pytest

from lakeloom.llm.mixing import mix_sources, mixed_documents


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        new = {s for s in rest if level * weight[s] >= cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= new


def corpus(seed=0, n=600):
    rng = random.Random(seed)
    names = ["a", "B", "ä", "z", "\U0001f600", "￮", None]
    docs = []
    for i in range(n):
        s = "a" if i % 3 == 0 else rng.choice(names)
        docs.append((i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), s))
    docs += [(n, "solo one two", "tiny"), (n + 1, None, "empty"), (n + 2, "", "a"), (n + 3, "   x\ty", "B")]
    return docs


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_what_is_taken(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, source string, size int, copies string").repartition(4)
    rows = mix_sources(df).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    assert len(rows) == len(docs)
    taken, smallest = {}, {}
    for r in rows:
        assert r.size == words(dict((i, t) for i, t, _ in docs)[r.doc_id]) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        if r.size:
            smallest.setdefault(r.source, []).append(r.size)
    for s, target in want.items():
        # What is missed is about a small document.
        near = sorted(smallest.get(s, [0]))[min(3, len(smallest.get(s, [0])) - 1)]
        assert abs(taken[s] - target) <= max(2 * near, 0.02 * target), (s, taken[s], target)
    assert sorted((r.doc_id, r.copies) for r in mix_sources(df.repartition(7)).collect()) == sorted((r.doc_id, r.copies) for r in rows)


def test_chances_follow_the_rates(spark):
    docs = [(i, "w " * (3 + i % 5), "s" if i < 400 else "t") for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    first = mix_sources(df, weights=(3, 1)).collect()
    rate = {r.source: r.rate for r in first}
    for s in ("s", "t"):
        own = [r.copies for r in first if r.source == s]
        assert set(own) <= {int(rate[s]), int(rate[s]) + 1}
        by_size = {n: [r.copies for r in first if r.source == s and r.size == n] for n in range(3, 8)}
        for copies in by_size.values():
            assert abs(sum(copies) / len(copies) - rate[s]) < 0.25
    assert {r.doc_id: r.copies for r in mix_sources(df, weights=(3, 1), seed=9).collect()} != {r.doc_id: r.copies for r in first}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "other text here now", "y"), (None, "p q", "x"), (None, "p q r", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df).collect()
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), words(t)) for i, t, _ in rows)
    empty = df.where("false")
    assert mix_sources(empty).count() == 0 and mixed_documents(empty).count() == 0
    assert {r.target for r in mix_sources(spark.createDataFrame([(1, None, "x"), (2, "", None)], "doc_id long, text string, source string")).collect()} == {0.0}


def test_documents_come_as_often_as_they_are_taken(spark):
    docs = corpus(2, 200) + [(5, "again", "z"), (5, "again", "z")]
    df = spark.createDataFrame([(i, t, s, i, "k", 1) for i, t, s in docs], "doc_id long, text string, source string, n long, _key string, _occ int")
    want = {}
    for r in mix_sources(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}

import random

import pytest

from brute import leaks
from lakeloom.llm import decontaminate
from lakeloom.llm.decontaminate import ItemIndex, drop_leaks, find_leaks


def data(seed=3):
    rng = random.Random(seed)
    make = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(8, 45)))) for i in range(30)] + [(40, "two words"), (41, "Single"), (42, ""), (43, None), (44, "a b a b a b a b a b a b a b a b")]
    items.append((45, items[0][1]))
    docs = [" ".join(make(rng.randint(5, 200))) for _ in range(40)]
    for i, t in items[:30]:
        w = t.split()
        docs.append(" ".join(make(30)) + " " + t.upper() + " " + " ".join(make(30)))
        docs.append(", ".join(w) + ".")
        docs.append(" ".join(w[1:] + make(5)))
        edited = list(w)
        edited[len(w) // 2] = "zzz"
        docs.append(" ".join(make(10) + edited + make(3)))
    docs += [None, "", "   ", "Two, words!", "single", "it has two words in it", "b a b a b a b a b a b a b a b a b a", ("long " + items[3][1] + " ") * 40 + "x" * 100_000]
    return items, docs


def run(spark, items, docs):
    b = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    d = spark.createDataFrame([(i, t, "en", 3) for i, t in enumerate(docs)], "doc_id long, text string, item_id string, similarity int").repartition(3)
    return d, b


def test_same_items_as_every_window_of_every_text(spark):
    items, docs = data()
    want = leaks(docs, items, 5, 0.8)
    d, b = run(spark, items, docs)
    got = {r.doc_id: r for r in find_leaks(d, b).collect()}
    assert len(got) == len(docs) and {i for i, r in got.items() if r.contaminated} == set(want)
    for i, found in want.items():
        assert got[i].item_ids == sorted(found)
        best = max(found.values())
        assert abs(got[i].similarity - best) < 1e-12 and got[i].best_item == min(k for k, v in found.items() if v == best)
    clean = drop_leaks(d, b)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(docs)) if i not in want]


def test_several_blocks_of_items_give_the_same(spark, monkeypatch):
    items, docs = data(4)
    d, b = run(spark, items, docs)
    columns = ("doc_id", "item_ids", "best_item", "similarity", "contaminated")
    one = sorted(tuple(r) for r in find_leaks(d, b).select(*columns).collect())
    monkeypatch.setattr(decontaminate, "ITEMS", 9)
    assert sorted(tuple(r) for r in find_leaks(d, b).select(*columns).collect()) == one
    assert drop_leaks(d, b).count() == sum(not r[-1] for r in one)


@pytest.mark.parametrize("items", [[], [(None, "a b c d e f")], [(1, None)]])
def test_nothing_to_find(spark, items):
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(1, "a b c d e f"), (None, None), (1, "a b c d e f")], "doc_id long, text string")
    assert [r.contaminated for r in find_leaks(d, b).collect()] == [False] * 3 and drop_leaks(d, b).count() == 3
    assert find_leaks(d.where("false"), b).count() == 0


def test_index_finds_everything_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(5)
    index = ItemIndex([0], ["a b c d e f"], 5)
    index.prints = rng.integers(0, 65536, (3000, decontaminate.BLOCKS)).astype(np.uint16)
    index.order = np.argsort(index.prints, axis=0, kind="stable")
    index.sorted = np.take_along_axis(index.prints, index.order, axis=0)
    for _ in range(20):
        probe = index.prints[rng.integers(3000)].copy()
        for bit in rng.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False):
            probe[bit // 16] ^= np.uint16(1 << (bit % 16))
        want = np.flatnonzero(np.bitwise_count(index.prints ^ probe).sum(axis=1) <= decontaminate.RADIUS)
        assert index.within(probe).tolist() == want.tolist() and len(want)

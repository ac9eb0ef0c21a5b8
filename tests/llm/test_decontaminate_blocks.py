import random

import numpy as np
import pytest

from brute import leaks
from lakeloom.llm import decontaminate
from lakeloom.llm.decontaminate import ItemIndex, drop_leaks, find_leaks
from lakeloom.llm.words import text_bytes

import pyarrow as pa


def corpus(seed, n_items=60):
    rng = random.Random(seed)
    make = lambda n: [f"v{rng.randrange(700)}" for _ in range(n)]
    common = make(30)
    items = [(f"item-{i}", " ".join(make(rng.randint(6, 30)) + (common if i % 3 == 0 else []))) for i in range(n_items)]
    docs = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        if i % 2:
            w[len(w) // 2] = "changed"
        docs.append(" ".join(make(rng.randint(0, 40)) + w + make(rng.randint(0, 40))))
    return items, docs + [" ".join(make(50) + common + make(50)) for _ in range(20)]


@pytest.mark.parametrize("per_block", [7, 20_000])
def test_text_ids_blocks_and_shuffled_rows(spark, monkeypatch, per_block):
    """Items with text ids in one and in many blocks; documents after a shuffle that adaptive plans may deal anew."""
    monkeypatch.setattr(decontaminate, "ITEMS", per_block)
    items, docs = corpus(1)
    want = leaks(docs, items, 5, 0.8)
    b = spark.createDataFrame(items, "item_id string, text string")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] * 2, "doc_id long, text string").repartition(6).groupBy("doc_id", "text").count().drop("count")
    rows = {r.doc_id: r for r in find_leaks(d, b).collect()}
    assert {i: r.item_ids for i, r in rows.items() if r.contaminated} == {i: sorted(f) for i, f in want.items()}
    for i, found in want.items():
        best = max(found.values())
        assert rows[i].best_item == min(k for k, v in found.items() if v == best) and abs(rows[i].similarity - best) < 1e-12
    assert sorted(r.doc_id for r in drop_leaks(d, b).collect()) == [i for i in range(len(docs)) if i not in want]


def test_a_shingle_of_every_item_takes_no_more_memory():
    """Twenty thousand items that share a text, and a document that repeats it: no pair of occurrence and item is made."""
    shared = " ".join(f"s{i}" for i in range(12))
    items = [f"{shared} own {i} words {i % 7} here {i * 31}" for i in range(20_000)]
    index = ItemIndex(list(range(len(items))), items, 5)
    import tracemalloc

    data, offsets = text_bytes(pa.array([(shared + " ") * 3000, items[77]]))
    tracemalloc.start()
    found = index.find(data, offsets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 77 in found[1] and found[1][77] == 1.0 and peak < 200 << 20


def test_one_very_long_text(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 600_000)]
    item = [f"q{i}" for i in range(40)]
    text = " ".join(words[:300_000] + item + words[300_000:])
    d = spark.createDataFrame([(1, text), (2, "x" * 4_000_000)], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(item)), (10, " ".join(words[-35:]))], "item_id int, text string")
    got = {r.doc_id: (r.item_ids, r.similarity) for r in find_leaks(d, b).collect()}
    assert got == {1: ([9, 10], 1.0), 2: ([], 0.0)}

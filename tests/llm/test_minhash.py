import random

import numpy as np
import pytest

from brute import near_groups, shingles
from lakeloom.llm import minhash
from lakeloom.llm.minhash import drop_near_duplicates, near_duplicates
from lakeloom.llm.words import shingle_sets, text_bytes, words_of

import pyarrow as pa


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [" ".join(make(rng.randint(1, 120))) for _ in range(60)]
    for base in list(docs[:25]):
        for edits in (0, 1, 2, 4, 8):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w))
    # A chain: each is near the next one, the ends are not.
    w = make(200)
    for _ in range(12):
        w = list(w)
        for p in rng.sample(range(200), 4):
            w[p] = rng.choice(vocabulary)
        docs.append(" ".join(w))
    docs += ["a b c", "A b\tC", "a b c d", "a b c d", "one", "One", "", "  \n", "Ä b c", "ä b c", "x " * 3000]
    return docs


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, n long").repartition(3)


def test_words_and_shingles():
    docs = [*corpus(), "\x0b\x1cx\x00 y z q", "ß ẞ İ"]
    data, offsets = text_bytes(pa.array([*docs, None]))
    for k in (1, 4, 5):
        sets = shingle_sets(words_of(data, offsets), k)
        assert [len(s) for s in sets] == [len(shingles(t, k)) for t in [*docs, None]]


@pytest.mark.parametrize("k", [4, 5])
def test_groups_equal_those_of_all_pairs(spark, k):
    docs = [(i * 3 + 1, t) for i, t in enumerate(corpus())] + [(5000, None)]
    random.Random(0).shuffle(docs)
    want = near_groups(docs, k)
    got = near_duplicates(frame(spark, docs), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(docs)


def test_large_groups_in_small_blocks(spark, monkeypatch):
    """Blocks of a few rows: hot bands, levels of heads and the comparison of what is left over."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = []
    for i in range(90):
        w = list(base)
        for p in rng.sample(range(150), rng.choice([1, 2, 3, 4, 9])):
            w[p] = f"w{rng.randrange(500)}"
        docs.append((i, " ".join(w)))
    want = near_groups(docs, 5)
    assert len({c for _, c in want.values()}) > 1
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = near_duplicates(frame(spark, docs), k=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_bands_of_a_hot_key_in_process(monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(0)
    m = 200
    sketch = rng.integers(0, 2**63, (4, minhash._SKETCH_WORDS), dtype=np.uint64)[rng.integers(0, 4, m)]
    owner = [s.tobytes() for s in sketch]
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * 50), pa.array(range(a, a + 50)), pa.array([100] * 50), pa.array([s.tobytes() for s in sketch[a : a + 50]], pa.binary())], ["band", "node", "n", "sketch"]) for a in range(0, m, 50)]
    pairs = [(a, b) for out in minhash._band_edges(0.8)(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    parent = list(range(m))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert len({(find(i), owner[i]) for i in range(m)}) == 4 == len({find(i) for i in range(m)})


def test_signatures_agree_like_the_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    sig = minhash.signatures([a, b])
    jaccard = 1500 / 2500
    assert abs((sig[0] == sig[1]).mean() - jaccard) < 0.12
    assert abs(minhash._agreement(minhash.sketches_of(sig)[:1], minhash.sketches_of(sig)[1:])[0, 0] - (1 + jaccard) / 2) < 0.12
    assert minhash.PERMS * 2 == minhash.BANDS * minhash.ROWS


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "solo text here now ok"), (2, None), (2, ""), (3, "zz yy xx ww vv"), (3, "totally other words in here")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (2, 2, True), (2, 2, True), (3, 3, True), (3, 3, True)], key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays_with_its_columns(spark):
    docs = [(i, t) for i, t in enumerate(corpus(2))]
    extra = [(0, docs[0][1]), (700, None), (701, ""), (701, "")]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", "k") for i, t in docs + extra], "doc_id long, text string, lang string, source string, _key string").repartition(4)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    want = sorted(i for i, (n, c) in near_groups(docs, 5).items() if i == c or not n) + [700, 701, 701]
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)

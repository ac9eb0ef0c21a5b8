"""Pivotal steps settle small sources too, keep means, and no id or row is a hot key."""

import math
import re

from pyspark.sql import functions as F

from lakeloom.llm import mixing
from lakeloom.llm.mixing import mix_sources, mixed_documents, round_copies


def sources(n_sources, n_docs):
    """Every source has the same sizes; so a place in it has a mean over sources."""
    return [(s * n_docs + i, "w " * (5 + 7 * i % 90 + (400 if i == 0 else 0)), f"s{s:03d}", i) for s in range(n_sources) for i in range(n_docs)]


def test_blocks_settle_nearly_all_rows_of_small_sources(spark):
    docs = sources(20, 50)
    items = spark.createDataFrame([(str(i), s, len(t.split()), 0.37, 50) for i, t, s, _ in docs], "id string, source string, size long, rate double, count long")
    seen = []
    cut = mixing.cut
    mixing.cut = lambda df, name, *a: seen.append(cut(df, name, *a)) or seen[-1]
    try:
        ups = {r.id: r.up for r in round_copies(items).collect()}
    finally:
        mixing.cut = cut
    in_blocks = sum(t.select(F.sum(F.size("r.done"))).first()[0] for t in seen)
    assert len(ups) == len(docs) and in_blocks >= 0.9 * len(docs) and in_blocks >= len(docs) - 20
    # Each source takes what it should, but for its last document.
    sizes = {str(i): (s, len(t.split())) for i, t, s, _ in docs}
    for s in {s for _, _, s, _ in docs}:
        own = [(n, ups[i]) for i, (x, n) in sizes.items() if x == s]
        assert abs(sum(n * u for n, u in own) - 0.37 * sum(n for n, _ in own)) <= max(n for n, _ in own)


def test_means_follow_the_rates(spark):
    docs = sources(240, 50)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, place int").repartition(4)
    rows = mix_sources(df.drop("place")).collect()
    place, by = {i: p for i, _, _, p in docs}, {}
    rate = {r.source: r.rate for r in rows}
    for r in rows:
        by.setdefault((round(rate[r.source], 9), place[r.doc_id]), []).append(r.copies)
    far = []
    for (own, p), copies in by.items():
        frac = own - math.floor(own)
        sigma = math.sqrt(max(frac * (1 - frac), 1e-3) / len(copies))
        if abs(sum(copies) / len(copies) - own) > 3 * sigma + 0.02:
            far.append((own, p, sum(copies) / len(copies), sigma))
    assert len(far) <= 0.02 * len(by), far
    taken = {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    # Within a document of mean size.
    assert all(abs(taken[r.source] - r.target) <= r.source_size / 50 for r in rows)


def test_a_hot_row_without_an_id(spark):
    """A third of all rows is one row with a null id, and one text has three megabytes."""
    docs = [(None, "the same row very often", "a")] * 400 + [(i, f"word {i} and more", "ab"[i % 2]) for i in range(700)] + [(5000, "x" * 3_000_000, "c"), (5001, "y " * 500_000, "c")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, _row int, copies int")
    rows = mix_sources(df.repartition(3)).collect()
    assert len(rows) == len(docs) and sorted(r.occ for r in rows if r.doc_id is None) == list(range(400))
    again = mix_sources(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.occ, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixed.where("doc_id IS NULL").count() == sum(r.copies for r in rows if r.doc_id is None)
    assert {r.size for r in rows if r.source == "c"} == {1, 500_000}
    assert len(re.findall(r"y", next(t for i, t, _ in docs if i == 5001))) == 500_000

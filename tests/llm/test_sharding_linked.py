from collections import Counter, defaultdict

import pytest

from lakeloom.llm.sharding import assign_shards


def dealt(spark, docs, shards):
    """Numbers of shards that the groups are in, by text."""
    rows = assign_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shards=shards).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in docs]
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1
    text, where = dict(docs), defaultdict(set)
    for r in rows:
        where[text[r.doc_id]].add(r.shard)
    return [len(s) for s in where.values()]


@pytest.mark.parametrize("members", [2, 10])
def test_groups_are_whole_without_unlinked_rows(spark, members):
    assert max(dealt(spark, [(i, f"group {i // members}") for i in range(400)], 10)) == 1


def test_few_unlinked_rows_and_mixed_sizes(spark):
    sizes = [2 + g % 7 for g in range(90)]
    docs = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"single {i}" for i in range(3)]
    got = dealt(spark, list(enumerate(docs)), 8)
    assert sum(n > 1 for n in got) <= 7 and max(got) <= 2

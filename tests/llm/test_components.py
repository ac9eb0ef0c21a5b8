import random

import pytest

from lakeloom.llm.common import components


@pytest.mark.parametrize("order", ["shuffled", "descending"])
def test_long_chain_is_one_component(spark, order):
    n = 3000
    ids = list(range(n, 0, -1))
    if order == "shuffled":
        random.Random(1).shuffle(ids)
    edges = list(zip(ids[:-1], ids[1:], strict=True))
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert sorted(r.node for r in got) == list(range(1, n + 1)) and {r.component for r in got} == {1}


def test_same_components_as_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400) - 50, rng.randrange(400) - 50) for _ in range(230)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (3000, 3001), (3001, 3000)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

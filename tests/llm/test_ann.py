import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import ann


def brute(vectors, query_ids, k):
    out = {}
    for q, x in vectors:
        if q in query_ids:
            found = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, v in vectors if i != q)[:k]
            out[q] = [(i, d) for d, i in found]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(int(i), [float(a) for a in v], "x", 3) for i, v in vectors], "vec_id long, embedding array<float>, cell string, rank int")


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).astype(np.float32).astype(float)) for i in range(350)] + [(1000 + i, np.ones(6)) for i in range(60)]
    want = brute(vectors, {0, 100, 200, 300, 1000}, 10)
    found = got(ann.search(frame(spark, vectors)))
    assert set(found) == set(want)
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([d for _, d in found[q]], [d for _, d in want[q]], rtol=1e-12)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 2.0]), (100, [2.0, 2.0]), (1, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = got(ann.search(df))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {0: [1, 100, 1], 100: [1, 0, 1]}
    assert found[0][0][1] == 1.0


def test_empty_and_one_dimension(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    df = spark.createDataFrame([(i, [float(i + 1)]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [i for i, _ in got(ann.search(df))[0]] == [1, 2, 3, 4]
    assert ann.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_recall_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_ROWS", 300)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 20)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    vectors = [(i, centers[i % 30] + 0.4 * rng.normal(size=16)) for i in range(2500)] + [(5000 + i, centers[0]) for i in range(1200)]
    vectors = [(i, v.astype(np.float32).astype(float)) for i, v in vectors]
    queries = {i for i, _ in vectors if i % 50 == 0}
    want = brute(vectors, queries, 10)
    found = got(ann.search(frame(spark, vectors), is_query=F.col("id") % 50 == 0, share=0.3, least=200, centroids=32))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert set(found) == queries and all(len(v) == 10 for v in found.values())
    assert hits >= 0.9 * 10 * len(queries)
    assert all(np.isclose(d, np.sqrt(((dict(vectors)[q] - dict(vectors)[i]) ** 2).sum()), rtol=1e-12) for q in list(found)[:5] for i, d in found[q])


def test_traversal_goes_by_summed_distance():
    rng = np.random.default_rng(3)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 4, 63)
    cells = ann.traverse(a, b, counts, 10**9)
    want = [c for c in heapq.nsmallest(63, range(63), key=lambda c: a[c // 7] + b[c % 7]) if counts[c]]
    assert cells == want
    assert sum(counts[c] for c in ann.traverse(a, b, counts, 12)) >= 12


def test_unequal_numbers_of_centroids():
    assert sorted(ann.traverse(np.array([1.0]), np.array([2.0, 0.5, 1.0]), np.array([1, 1, 1]), 99)) == [0, 1, 2]


@pytest.mark.parametrize("k", [1, 3])
def test_kmeans_of_few_points(k):
    assert len(ann.kmeans(np.array([[1.0], [1.0], [2.0]]), k)) == min(k, 2)


def test_rows_that_share_an_id_are_queries_and_candidates_each(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == sorted([(100, 1, 3, 0.1), (100, 2, 4, round((0.9**2 + 1) ** 0.5, 6)), (100, 3, 100, round(2**0.5, 6)), (100, 1, 4, 0.1), (100, 2, 3, round((0.9**2 + 1) ** 0.5, 6)), (100, 3, 100, round(2**0.5, 6))])

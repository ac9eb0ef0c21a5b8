"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, ship

#: Vectors the codebooks are fitted on, and centroids of each half at most.
FIT_ROWS, CENTROIDS = 20_000, 128
#: Vectors that meet in one task, and queries that meet them there.
GROUP_ROWS, GROUP_QUERIES = 4096, 4096
#: Tasks that find the cells of the queries, at least, where there are queries enough.
PROBE_TASKS = 32


@dataclass
class Codebooks:
    """Centroids of either half of the vectors."""

    first: np.ndarray
    second: np.ndarray
    split: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to the centroids."""
        halves = (x[:, : self.split], self.first), (x[:, self.split :], self.second)
        return tuple(((h**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * h @ c.T) for h, c in halves)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    distinct = np.unique(x, axis=0) if x.shape[1] else x[:1]
    if len(distinct) <= k:
        return distinct
    centers = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = ((centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centers)
    return centers


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells in order of a[i] + b[j], until those taken hold `want` vectors.

    A heap holds the border of the pairs taken so far; a pair enters once the ones before it in
    its row and column are out, so each step costs the logarithm of the border.
    """
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[order_a], b[order_b]
    heap, out, got = [(a[0] + b[0], 0, 0)], [], 0
    done = np.full(len(a), -1)
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        done[i] = j
        cell = int(order_a[i]) * len(b) + int(order_b[j])
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
        if i + 1 < len(a) and (j == 0 or done[i + 1] == j - 1):
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] >= j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def _vectors(batch, column="vec") -> np.ndarray:
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _assign(books):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "vec")], pa.array(books.value.cell(_vectors(batch)).astype(np.int32))], ["row", "id", "vec", "cell"])

    return run


def _probe(books, counts: np.ndarray, base: np.ndarray, chunks: np.ndarray, want: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = books.value.distances(_vectors(batch))
            q, vec, grp, cells = [], [], [], []
            rows, vecs = batch.column("row").to_pylist(), batch.column("vec").to_pylist()
            for r in range(batch.num_rows):
                by: dict[int, list[int]] = {}
                for c in traverse(a[r], b[r], counts, want):
                    for g in range(base[c], base[c] + chunks[c]):
                        by.setdefault(g, []).append(c)
                q += [rows[r]] * len(by)
                vec += [vecs[r]] * len(by)
                grp += list(by)
                cells += list(by.values())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(vec, pa.list_(pa.float64())), pa.array(grp, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["q", "vec", "grp", "cells"])

    return run


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares summed from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - y[:, j]
        total += d * d
    return np.sqrt(total)


def nearest(q_row, q, allowed, v_row, v_id, v, v_cell, k: int):
    """The k nearest allowed vectors of each query, exactly: (query's row, vector id, distance).

    allowed: sets of cells, one per query. Squared distances by a matrix product choose; distances
    of what could be among the k are then taken from differences.
    """
    order = np.lexsort((v_row, v_id, *v.T[::-1])) if len(v) else np.zeros(0, np.int64)
    # Of equal vectors only k + 1 can matter: the smallest ids and the query itself.
    if len(order):
        same = np.concatenate([[False], (v[order[1:]] == v[order[:-1]]).all(axis=1) & (v_cell[order[1:]] == v_cell[order[:-1]])])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        order = order[np.arange(len(order)) - start <= k]
        v_row, v_id, v, v_cell = v_row[order], v_id[order], v[order], v_cell[order]
    cells, local = np.unique(v_cell, return_inverse=True)
    place = {int(c): i for i, c in enumerate(cells)}
    out_q, out_v, out_d = [], [], []
    norm = (v**2).sum(axis=1)
    for at in range(0, len(q), 256):
        x, own_row = q[at : at + 256], q_row[at : at + 256]
        open_to = np.zeros((len(x), len(cells)), bool)
        for r, cs in enumerate(allowed[at : at + 256]):
            open_to[r, [place[c] for c in cs if c in place]] = True
        mask = open_to[:, local] & (own_row[:, None] != v_row[None, :])
        own = (x**2).sum(axis=1)
        square = np.where(mask, own[:, None] + norm[None, :] - 2 * x @ v.T, np.inf)
        kth = np.partition(square, k - 1, axis=1)[:, k - 1] if square.shape[1] > k else np.full(len(x), np.inf)
        slack = 1e-9 * (own + (norm.max() if len(norm) else 0) + 1)
        r, c = np.nonzero(mask & (square <= (kth + slack)[:, None]))
        d = distance(x[r], v[c])
        rank = np.lexsort((v_id[c], d, r))
        r, c, d = r[rank], c[rank], d[rank]
        first = np.searchsorted(r, np.arange(len(x)))
        keep = np.arange(len(r)) - first[r] < k
        out_q.append(own_row[r[keep]]), out_v.append(v_id[c[keep]]), out_d.append(d[keep])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_v, np.int64), cat(out_d, np.float64)


def _rerank(k: int):
    def run(queries, vectors):
        q, v, d = nearest(queries.column("q").to_numpy(), _vectors(queries), queries.column("cells").to_pylist(), vectors.column("row").to_numpy(), vectors.column("id").to_numpy(), _vectors(vectors), vectors.column("cell").to_numpy(), k) if len(queries) and len(vectors) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.float64())})

    return run


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part, all of the most common length."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def search(vectors: DataFrame, is_query: Column | None = None, k: int = 10, share: float = 0.4, least: int = 2000, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each query: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Queries are
    the rows for which is_query (over `id`) holds, by default ids divisible by 100; candidates are
    all rows but the query's own. Null, zero and non-finite vectors, null ids and vectors
    of another than the most common length, which have no distance to the others, take no part. Rows that repeat
    an id are candidates each, of each other too, and each is a query with ranks of its own if its id is. Other
    columns are dropped; an empty table gives an empty result.

    The vectors' halves are quantised by codebooks fitted on up to fit_rows vectors; every vector is
    filed under its pair of centroids. A query takes cells in order of summed distance until they
    hold `share` of all vectors, and `least` at any rate; their vectors are ranked exactly. Small
    cells share a group and large ones are dealt over several, so a task meets about GROUP_ROWS
    vectors and GROUP_QUERIES queries, however common a vector is.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable_vectors(vectors, id_col, vec_col)
    is_query = F.col("id") % 100 == 0 if is_query is None else is_query
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").collect()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    split = sample.shape[1] // 2
    books = spark.sparkContext.broadcast(Codebooks(kmeans(sample[:, :split], centroids) if split else np.zeros((1, 0)), kmeans(sample[:, split:], centroids), split))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    filed = cut(numbered.mapInArrow(_assign(books), "row long, id long, vec array<double>, cell int"), "ann-filed")
    n_cells = len(books.value.first) * len(books.value.second)
    counts = np.zeros(n_cells, np.int64)
    for r in filed.groupBy("cell").count().collect():  # centroids ** 2 at most
        counts[r["cell"]] = r["count"]
    base, chunks, at, room = np.zeros(n_cells, np.int64), np.ones(n_cells, np.int64), 0, GROUP_ROWS
    for c in range(n_cells):
        if counts[c] > GROUP_ROWS:
            base[c], chunks[c] = at + 1, -(-counts[c] // GROUP_ROWS)
            at, room = at + 1 + int(chunks[c]), GROUP_ROWS
        else:
            at, room = (at + 1, GROUP_ROWS) if counts[c] > room else (at, room)
            base[c], room = at, room - counts[c]
    want = max(least, int(np.ceil(share * counts.sum())))
    asking = cut(filed.where(is_query).select("row", "id", "vec"), "ann-queries")
    # Queries are few and each probe costs a while: they are dealt evenly, by number.
    tasks = min(asking.count() // 16 + 1, max(PROBE_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    probes = cut(asking.repartition(tasks, "row").mapInArrow(_probe(books, counts, base, chunks, want), "q long, vec array<double>, grp long, cells array<int>"), "ann-probes")
    where = spark.createDataFrame(pd.DataFrame({"cell": np.arange(n_cells, dtype=np.int32), "base": base, "chunks": chunks}))  # centroids ** 2 rows at most
    placed = filed.join(F.broadcast(where), "cell").withColumn("grp", F.col("base") + F.pmod(F.xxhash64("row"), F.col("chunks"))).drop("base", "chunks")
    blocks = probes.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).alias("blocks"))
    placed = placed.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    asked = probes.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks"))).drop("blocks")
    found = asked.groupBy("grp", "block").cogroup(placed.groupBy("grp", "block")).applyInArrow(_rerank(k), "q long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asking.select(F.col("row").alias("q"), F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")

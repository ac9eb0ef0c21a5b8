"""Queries against their SQL on the smallest tables, and fitted models against plain re-scoring."""

import os

import numpy as np
import pytest

from lakeloom.llm.quality import _sigmoid, fit_pu
from lakeloom.llm.sharding import assign_shards
from lakeloom.llm.toxicity import ToxicityModel, Lexicon, fit_isotonic, fit_trees

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["op4_nearest", "op7_repeated_passages", "op8_near_duplicates", "op9_decontaminate"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    relation = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [list(relation.columns).index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in relation.fetchall())


def test_trees_and_calibration_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * (rng.random((400, 6)) < 0.7)
    y = ((x[:, 0] + x[:, 1] > 0.3) ^ (rng.random(400) < 0.05)).astype(float)
    trees = fit_trees(x[:300], y[:300], rounds=20)
    knots = fit_isotonic(trees.margin(x[300:]), y[300:])
    got = ToxicityModel(Lexicon(), trees, knots).score(x)
    for row, score in zip(x, got, strict=True):
        margin = trees.base
        for column, cut_at, leaf in trees.trees:
            node = 0
            while column[node] >= 0:
                j = column[node]
                node = 2 * node + 1 + (sum(e <= row[j] for e in trees.edges[j]) > cut_at[node])
            margin += trees.rate * leaf[node]
        xs, ps = knots
        after = int(np.searchsorted(xs, margin, "right"))
        if after == 0 or after == len(xs):
            p = ps[0] if after == 0 else ps[-1]
        else:
            a, b = xs[after - 1], xs[after]
            p = ps[after - 1] + (ps[after] - ps[after - 1]) * ((margin - a) / (b - a) if b > a else 0)
        assert abs(score - np.clip(0.98 * p + 0.02 / (1 + np.exp(-margin)), 0, 1)) < 1e-9


def test_network_row_by_row():
    rng = np.random.default_rng(2)
    model = fit_pu(rng.normal(1, 1, (80, 4)), rng.normal(0, 1, (90, 4)), 0.4, rounds=50)
    for row in rng.normal(0, 3, (20, 4)):
        z = [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        hidden = [np.tanh(sum(z[i] * model.w1[i, k] for i in range(4)) + model.b1[k]) for k in range(len(model.b1))]
        assert abs(model.score(row[None])[0] - _sigmoid(np.array(sum(h * w for h, w in zip(hidden, model.w2, strict=True)) + model.b2))) < 1e-9


def test_laws_of_shards_and_what_is_gathered(spark):
    """Counts, slots, and edges between equal texts that stay within a shard, against the deal by hash."""
    docs = [(i, f"hot text {i % 2}") for i in range(300)] + [(1000 + i, f"group {i // 4}") for i in range(400)] + [(5000 + i, f"alone {i}") for i in range(250)] + [(None, None), (None, ""), (9, ""), (9, "é" * 300_000)]
    rows = assign_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shards=7).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"rows"}
    by = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(7)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(s == list(range(len(s))) for s in by.values())
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.text_crc32, r["size"]), []).append(r.shard)
    small = [s for s in groups.values() if 1 < len(s) <= 10]
    whole = sum(len(set(s)) == 1 for s in small)
    assert len(small) >= 100 and whole >= 0.9 * len(small)
    hot = [s for s in groups.values() if len(s) > 100]
    assert len(hot) == 2 and all(len(set(s)) <= 3 for s in hot)  # a shard holds 136 rows

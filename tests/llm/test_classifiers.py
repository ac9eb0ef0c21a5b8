import random
import zlib

import numpy as np
import pytest

from lakeloom.llm.quality import fit_pu, score_quality
from lakeloom.llm.stats import NAMES, dense_stats
from lakeloom.llm.toxicity import Lexicon, drop_toxic, fit_isotonic, fit_trees, score_toxicity
from lakeloom.llm.words import text_bytes

import pyarrow as pa


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(len(s))
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n1 = (y == 1).sum()
    return (ranks[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def corpus(kind, n=500, seed=0):
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in ("th", "er", "on", "an", "re", "he") for b in ("a", "in", "ed", "es", "ly", "or", "at")]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(20, 150))]
        bad = rng.random() < 0.2
        if bad and kind == "quality":
            w = [x + "$$$" for x in w] if i % 2 else [x for x in w[:10] for _ in range(12)]
        if bad and kind == "toxic":
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "you moron", "bogkrast", "bogkrull", "l0ser"]))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, int(not bad), int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "en", "s", 0.5, "x") for i, t in docs], "doc_id long, text string, lang string, source string, score double, _fold string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("kind", "score", "folds", "held", "column"), [("quality", score_quality, 4, 2, 1), ("toxic", score_toxicity, 5, 0, 2)])
def test_held_out_accuracy_and_odd_rows(spark, kind, score, folds, held, column):
    docs, labels = corpus(kind)
    extra = [(9000, None), (9001, ""), (None, "idiot"), (9002, "word " * 60_000), (1, docs[1][1])]
    d, lab = frames(spark, docs + extra, labels + [(1, None, None), (None, 1, 1), (77777, 1, 0), labels[0]])
    rows = score(d, lab).collect()
    assert len(rows) == len(docs) + len(extra) and rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    limit = 0.7 if kind == "quality" else 0.5
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % folds == held)
    truth = {x[0]: x[column] for x in labels}
    own = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    y, s, p = (np.array(x) for x in zip(*own, strict=True))
    assert auc(y, s) > 0.93 and (y == p).mean() > 0.9


def test_scores_see_texts_only(spark):
    """Other ids, languages and sources, the same texts and labels of the training fold: held-out labels turned over."""
    docs, labels = corpus("toxic", 200)
    d, lab = frames(spark, docs, labels)
    turned = [(i, 1 - q, 1 - x) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, x) for i, q, x in labels]
    first = {r.doc_id: r.score for r in score_toxicity(d, lab).collect()}
    second = {r.doc_id: r.score for r in score_toxicity(d.selectExpr("doc_id", "text", "'fr' AS lang", "'t' AS source"), frames(spark, docs, turned)[1]).collect()}
    assert first == second
    turned = [(i, 1 - q, 1 - x) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, x) for i, q, x in labels]
    quality = [{r.doc_id: round(r.score, 9) for r in score_quality(d, own).collect()} for own in (lab, frames(spark, docs, turned)[1])]
    assert quality[0] == quality[1]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 1), (3, 0, 1)]])
def test_few_labels_and_empty_tables(spark, labels):
    d, lab = frames(spark, [(1, "you idiot"), (2, "fine words"), (3, None)], labels)
    for score in (score_quality, score_toxicity):
        assert all(0 <= r.score <= 1 for r in score(d, lab).collect())
        assert score(d.where("false"), lab).count() == 0
    assert drop_toxic(d.where("false"), lab).count() == 0


def test_toxic_documents_go_and_columns_stay(spark):
    docs, labels = corpus("toxic", 400)
    d, lab = frames(spark, docs, labels)
    kept = drop_toxic(d, lab)
    assert kept.columns == d.columns
    scores = {r.doc_id: r.predicted for r in score_toxicity(d, lab).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in scores.items() if not p)


def test_stats_of_known_texts():
    x = dense_stats(*text_bytes(pa.array(["Ab ab cd!!\nAB 12|", "", None, "\x0b\t "])))
    by = {n: x[0, i] for i, n in enumerate(NAMES)}
    assert x.shape == (4, len(NAMES)) and not x[1].any() and not x[2].any()
    assert np.isclose(np.expm1(by["words"]), 5) and np.isclose(by["distinct"], 3 / 5) and np.isclose(by["top_word"], 3 / 5) and np.isclose(by["repeats"], 1 / 5)
    assert np.isclose(by["caps_words"], 1 / 5) and np.isclose(by["doubled_marks"], 1 / 5) and np.isclose(np.expm1(by["lines"]), 2)


def test_lexical_features():
    lexicon = Lexicon({"bogus": 3.0}, {"bogus": 2.0})
    plain, near = lexicon.features("nice words only"), lexicon.features("you idiot, 1d10t and m0ron! i d i o t")
    assert not any(plain) and near[1] == 1 and near[10] > 0 and near[13] == 2 and near[14] == 1


def test_trees_isotonic_and_risk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = fit_trees(x[:1000], y[:1000])
    assert auc(y[1000:], trees.margin(x[1000:])) > 0.97
    knots, p = fit_isotonic(trees.margin(x[:1000]), y[:1000])
    assert (np.diff(p) >= 0).all() and (np.diff(knots) >= 0).all()
    m = np.array([3.0, 1.0, 2.0, 4.0])
    assert np.interp(m, *fit_isotonic(m, np.array([0.0, 0.0, 1.0, 1.0]))).tolist() == [0.5, 0.0, 0.5, 1.0]
    # Positives alone and a mixture: the risk finds the negatives without having seen one labelled.
    positive, negative = rng.normal(1.5, 1, (600, 3)), rng.normal(-1.5, 1, (600, 3))
    mixed = np.concatenate([positive[300:], negative[:300]])
    model = fit_pu(positive[:300], mixed, 0.5)
    assert (model.score(negative[300:]) < 0.5).mean() > 0.95 and (model.score(rng.normal(1.5, 1, (300, 3))) > 0.5).mean() > 0.95

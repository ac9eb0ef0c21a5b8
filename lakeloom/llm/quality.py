"""Quality classifier: positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, discard, ship, uniform
from lakeloom.llm.stats import NAMES, dense_stats
from lakeloom.llm.words import steps, text_bytes

#: Documents of each kind, trusted positive and unlabelled, that the model is fitted on.
FIT_ROWS = 8_000
#: Parts, rounds and least share of positives above a threshold, for the estimate of the class prior.
PRIOR_PARTS, PRIOR_ROUNDS, PRIOR_SHARE = 2, 300, 0.8


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class PuModel:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return _sigmoid(hidden @ self.w2 + self.b2)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, rounds: int = 1500, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> PuModel:
    """Minimise prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss l.

    The second part estimates the risk on negatives without having any. Where it falls below 0 the
    model has begun to fit the sample of positives, and a step is made to raise it again.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    x = np.concatenate([p, u])
    n_p, n_u = len(p), len(u)
    for t in range(1, rounds + 1):
        h = np.tanh(x @ theta[0] + theta[1])
        f = h @ theta[2] + theta[3]
        sig = _sigmoid(f)
        soft = np.logaddexp(0, f)
        negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
        g = np.empty(len(x))
        if negative >= 0:
            g[:n_p] = prior * ((sig[:n_p] - 1) - sig[:n_p]) / n_p
            g[n_p:] = sig[n_p:] / n_u
        else:
            g[:n_p] = prior * sig[:n_p] / n_p
            g[n_p:] = -sig[n_p:] / n_u
        back = np.outer(g, theta[2]) * (1 - h * h)
        grads = [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]
        for i, d in enumerate(grads):
            d = d + decay * theta[i]
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return PuModel(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled rows, from trusted positives alone.

    Above any threshold of a score, unlabelled rows are at least as many as their positives: so the share of them
    there, over the share of trusted positives there, is no less than the prior, and about the prior where hardly
    a negative is. That is the least such ratio; among thresholds that few rows are above, a margin for chance
    keeps it from being lucky. Rows are scored by models that were fitted without them.
    """
    scores = [np.zeros(len(positive)), np.zeros(len(unlabelled))]
    parts = [np.arange(len(s)) % PRIOR_PARTS for s in scores]
    for k in range(PRIOR_PARTS):
        model = fit_pu(positive[parts[0] != k], unlabelled[parts[1] != k], 0.5, rounds=PRIOR_ROUNDS)
        for s, x, part in zip(scores, (positive, unlabelled), parts, strict=True):
            s[part == k] = model.score(x[part == k])
    p, u = (np.sort(s) for s in scores)
    levels = np.unique(np.concatenate([p, u]))
    above_p, above_u = (1 - np.searchsorted(s, levels) / len(s) for s in (p, u))
    margin = sum(np.sqrt(np.log(40) / 2 / len(s)) for s in (p, u))
    at = np.flatnonzero(above_p >= PRIOR_SHARE)
    best = at[np.argmin((above_u[at] + margin) / above_p[at])]
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _features(keep: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                x = dense_stats(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(list(x), pa.list_(pa.float64()))], [*keep, "x"])

    return run


def _scores(model, keep: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                x = dense_stats(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(model.score(x))], [*keep, "score"])

    return run


def fold(id_col: str, folds: int) -> Column:
    """The remainder of an id's crc32, as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def labelled_sample(labels: DataFrame, label: str, id_col: str, folds: int, held: int, rows: int, where: str = "true") -> DataFrame:
    """Up to `rows` labelled ids (id, y) outside of the held-out fold, chosen by hash; an id with several
    labels counts as the largest."""
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held))
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y")).where(where)
    return own.orderBy(F.xxhash64("id"), "id").limit(rows)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Quality of every document: id_col, held_out, score, predicted.

    The model learns from up to fit_rows trusted positives (label 1) and as many documents without
    any label, both outside of the held-out fold, and from a class prior that is estimated from
    these two alone (see class_prior()): a label of 0 is never learned from. If nearly every document
    has a label, unlabelled text is a sample of all documents outside the fold. Only features of whole
    texts go in: never ids, labels or other columns. They are computed for batches of texts in time
    linear in their bytes, however long one is. Null and empty texts have all features 0 and get that
    score. Null ids count as the empty text for the fold. Without positives or unlabelled text the score
    is the share of 1 among the labels outside of the fold, or 1 without labels. Every row gives one row;
    other columns are dropped.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), fold(id_col, folds).alias("_fold"), F.col(text_col).alias("text"))
    trusted = labelled_sample(labels, label_col, id_col, folds, held, fit_rows, "y = 1")
    # Unlabelled text: about fit_rows documents by hash, of which those with a label go.
    total = docs.count()
    some = rows.where((F.col("_fold") != held) & F.col("_id").isNotNull() & (uniform(F.col("_id"), seed=5) * max(1, total) < 3 * fit_rows))
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    marked = some.join(known.withColumn("_known", F.lit(1)), "_id", "left").select(F.xxhash64("_id", F.lit(6)).alias("draw"), F.coalesce("_known", F.lit(0)).alias("kind"), "text")
    chosen = rows.join(F.broadcast(trusted.select(F.col("id").alias("_id"))), "_id").select(F.xxhash64("_id", F.lit(6)).alias("draw"), F.lit(2).alias("kind"), "text")
    sample = cut(chosen.unionByName(marked).mapInArrow(_features(("draw", "kind")), "draw long, kind int, x array<double>"), "quality-sample")
    # Drawn by id: equal texts are as many in the sample as they are in the corpus.
    take = lambda *kinds: np.array([r["x"] for r in sample.where(F.col("kind").isin(*kinds)).orderBy("draw", "x").limit(fit_rows).select("x").collect()]).reshape(-1, len(NAMES))
    positive, unlabelled = take(2), take(0)
    if len(unlabelled) < max(50, len(positive) // 20):
        unlabelled = take(0, 1)
    discard(sample)
    if len(positive) >= PRIOR_PARTS and len(unlabelled) >= PRIOR_PARTS:
        model = fit_pu(positive, unlabelled, class_prior(positive, unlabelled))
        scored = rows.mapInArrow(_scores(model, ("_id", "_fold")), f"_id {dict(rows.dtypes)['_id']}, _fold long, score double")
    else:
        usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held))
        share = usable.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
        scored = rows.select("_id", "_fold", F.lit(1.0 if share is None else float(share)).alias("score"))
    return scored.select(F.col("_id").alias(id_col), (F.col("_fold") == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, discard, ship
from lakeloom.llm.quality import fold, labelled_sample
from lakeloom.llm.stats import NAMES, dense_stats
from lakeloom.llm.words import LOWER, runs_of, span_hashes, steps, text_bytes, word_hash, words_of

#: Labelled documents that lexicon, trees and calibration are fitted on; entries of a learned lexicon.
FIT_ROWS, TERMS = 12_000, 1_000
#: Documents of either label that the calibration's quarter must have to be kept back.
CALIBRATE = 20
#: Tasks that compute the features of the fitted documents.
SPREAD = 32
#: Letters of a word's stem, and words between an insult and a second person that count as near.
STEM, NEAR = 5, 4
#: Insults that count before anything is learned.
SEED_WORDS = frozenset("arsehole asshole bastard bitch clown coward creep cretin crap damn dimwit disgusting dumb dumbass dunce fool freak garbage idiot idiotic imbecile jackass jerk liar loser lowlife maggot moron moronic nitwit numbskull parasite pathetic pig rat scum scumbag shit shut stupid trash twat ugly useless vermin weirdo worthless wretch".split())
#: Second persons in English, French, German and Spanish.
SECOND = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros".split())
#: Bytes of a masked word at most; longer ones are counted but never looked up, since no word is so long.
LONGEST = 64
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
_C = np.arange(256)
_ASCII_LETTER = ((_C | 32) >= 97) & ((_C | 32) <= 122)
_LETTER = _ASCII_LETTER | (_C >= 128)
_DIGIT = (_C >= 48) & (_C <= 57)
_MARK, _JOINT, _TRAIL = _DIGIT.copy(), np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in "@$!*#"]] = True
_JOINT[[ord(c) for c in " .-"]] = True
_TRAIL[[ord(c) for c in "!*#"]] = True
#: What the marks of a masked word stand for.
_PLAIN = LOWER.copy()
_PLAIN[[ord(c) for c in "@$!013457"]] = [ord(c) for c in "asioieast"]


def _top(texts: int, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's weights: the sum, the greatest and the sum of the five greatest."""
    order = np.lexsort((-weight, owner))
    owner, weight = owner[order], weight[order]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    some = lambda k: np.bincount(owner[nth < k], weight[nth < k], texts)
    return np.bincount(owner, weight, texts), some(1), some(5)


class _Table:
    """Hashes of words, sorted, behind a filter of 2 ** 16 bits."""

    def __init__(self, words: list[str]):
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes, self.seen = hashes[self.order], np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those that are words of the table, and which."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        row = np.searchsorted(self.hashes, hashes[at])
        same = row < len(self.hashes)
        same[same] = self.hashes[row[same]] == hashes[at][same]
        return at[same], self.order[row[same]]


@dataclass
class Lexicon:
    """Weights of words and stems, learned from labelled texts."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    @cached_property
    def _known(self) -> tuple[_Table, np.ndarray, np.ndarray, np.ndarray]:
        every = sorted({*self.words, *SEED_WORDS, *SECOND})
        column = lambda f, kind: np.array([f(w) for w in every], kind)
        return _Table(every), column(lambda w: self.words.get(w, 0.0), float), column(SEED_WORDS.__contains__, bool), column(SECOND.__contains__, bool)

    @cached_property
    def _known_stems(self) -> tuple[_Table, np.ndarray]:
        every = sorted(self.stems)
        return _Table(every), np.array([self.stems[s] for s in every])

    def features(self, text: str) -> list[float]:
        data, offsets = text_bytes(pa.array([text]))
        return self.lexical(data, offsets, dense_stats(data, offsets))[0].tolist()

    def lexical(self, data: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """A row of figures per text, all texts at once and in time that is linear in their bytes, whatever they
        hold. Words are runs of letters and of what is beyond ASCII, A-Z lower-cased. dense: their dense_stats()."""
        texts = len(offsets) - 1
        count = lambda owner: np.bincount(owner, minlength=texts).astype(np.float64)
        words = words_of(data, offsets, ~_LETTER)
        n, distinct = np.maximum(1, np.diff(words.first)), np.maximum(1, np.rint(np.expm1(dense[:, 0]) * dense[:, 2]))
        table, weight, seed, second = self._known
        insult = seed | (weight > 1)
        at, row = table.find(words.hashes)
        owner = np.searchsorted(words.first, at, "right") - 1
        # Insults, and those near to a second person.
        sofar = np.zeros(len(words.hashes) + 1, np.int32)
        sofar[at[second[row]] + 1] = 1
        sofar = np.cumsum(sofar)
        hit, of = at[insult[row]], owner[insult[row]]
        hits = count(of)
        near = count(of[sofar[np.minimum(words.first[of + 1], hit + NEAR + 1)] > sofar[np.maximum(words.first[of], hit - NEAR)]])
        own, row = np.divmod(np.unique(owner * len(weight) + row), len(weight))
        seeds, seconds, learned = count(own[seed[row]]), count(own[second[row]]), weight[row] > 0
        total, most, five = _top(texts, own[learned], weight[row[learned]])
        stem_table, stem_weight = self._known_stems
        long = np.flatnonzero(words.end - words.start > STEM)
        at, row = stem_table.find(span_hashes(LOWER[data], words.start[long], words.start[long] + STEM))
        own, row = np.divmod(np.unique((np.searchsorted(words.first, long[at], "right") - 1) * max(1, len(stem_weight)) + row), max(1, len(stem_weight)))
        stem_total, stem_most, stem_five = _top(texts, own, stem_weight[row])
        # Masked words: runs of letters and marks in which a letter follows a mark.
        start, end = runs_of((_ASCII_LETTER | _MARK)[data], offsets)
        turns = np.flatnonzero(_MARK[data[:-1]] & _ASCII_LETTER[data[1:]])
        masked = np.searchsorted(turns, start) < np.searchsorted(turns, end - 1)
        start, end = start[masked], end[masked]
        masks = count(np.searchsorted(offsets, start, "right") - 1)
        start, end = start[end - start <= LONGEST], end[end - start <= LONGEST]
        for _ in range(LONGEST):
            trailing = _TRAIL[data[end - 1]]
            if not trailing.any():
                break
            end = end - trailing  # a letter is left in any case
        at, row = table.find(span_hashes(_PLAIN[data], start, end))
        unmasked = count(np.searchsorted(offsets, start[at[insult[row]]], "right") - 1)
        # Spelled words: four or more single letters with one joint between each two.
        start, end = words.start, words.end
        digit, bound = np.zeros(len(data) + 2, bool), np.zeros(len(data) + 1, bool)
        digit[1:-1], bound[offsets] = _DIGIT[data], True
        single = (end - start == 1) & ~(digit[start] & ~bound[start]) & ~(digit[end + 1] & ~bound[end])  # no digit before or after
        i = np.flatnonzero(single[:-1] & single[1:])
        i = i[start[i + 1] == start[i] + 2]
        i = i[_JOINT[data[start[i] + 1]] & (np.searchsorted(offsets, start[i], "right") == np.searchsorted(offsets, start[i + 1], "right"))]
        breaks = np.flatnonzero(np.diff(i) != 1)
        head, tail = (i[np.concatenate([[0], breaks + 1])], i[np.concatenate([breaks, [len(i) - 1]])] + 1) if len(i) else (i, i)
        head, tail = head[tail - head >= 3], tail[tail - head >= 3]
        spelled = count(np.searchsorted(words.first, head, "right") - 1)
        head, tail = head[tail - head < LONGEST], tail[tail - head < LONGEST]
        letters = tail - head + 1
        ends = np.cumsum(letters)
        flat = LOWER[data[start[np.repeat(head, letters) + np.arange(letters.sum()) - np.repeat(ends - letters, letters)]]]
        at, row = table.find(span_hashes(flat, ends - letters, ends))
        spelled_hits = count(np.searchsorted(words.first, head[at[insult[row]]], "right") - 1)
        # Runs of three and more of a letter.
        same = (data[1:] == data[:-1]) & _ASCII_LETTER[data[1:]]
        same[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
        runs = same[1:] & same[:-1]
        runs[1:] &= ~same[:-2]
        stretched = count(np.searchsorted(offsets, np.flatnonzero(runs), "right") - 1)
        return np.stack([
            hits / n, seeds, seeds / distinct, total / distinct, most, five,
            stem_total / distinct, stem_most, stem_five,
            seconds, near / n, near / np.maximum(1, hits),
            masks / n, unmasked, spelled_hits, spelled / n, stretched / n,
        ], axis=1)


N_FEATURES = len(Lexicon().features("")) + len(NAMES)


@dataclass
class Trees:
    """Boosted trees of depth 3 over binned features, for the logistic loss."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    rate: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column, cut_at, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = column[node] >= 0
                if not inner.any():
                    break
                right = bins[rows, np.maximum(column[node], 0)] > cut_at[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += self.rate * leaf[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 4.0) -> Trees:
    edges = [np.unique(np.quantile(c[c != 0] if (c != 0).sum() > bins else c, np.linspace(0, 1, bins))) if len(c) else np.zeros(0) for c in x.T]
    edges = [np.unique(np.concatenate([[1e-12], e])) for e in edges]
    binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        column, cut_at, leaf = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for at in range(size):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            leaf[at] = -gs / (hs + l2)
            if at >= 2**depth - 1:
                continue
            flat = (np.arange(x.shape[1]) * width + binned[own]).ravel()
            gh = np.bincount(flat, np.repeat(g[own], x.shape[1]), minlength=width * x.shape[1]).reshape(-1, width).cumsum(axis=1)
            hh = np.bincount(flat, np.repeat(h[own], x.shape[1]), minlength=width * x.shape[1]).reshape(-1, width).cumsum(axis=1)
            gain = gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
            gain[(hh < least / 4) | (hs - hh < least / 4)] = -1
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, b] <= 1e-6:
                continue
            column[at], cut_at[at] = j, b
            node[own] = 2 * at + 1 + (binned[own, j] > b)
        done = Trees(edges, [(column, cut_at, leaf)], 0.0, rate)
        margin = margin + done.margin(x)
        trees.append((column, cut_at, leaf))
    return Trees(edges, trees, base, rate)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from margin to probability."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    x = np.array([[b[2], b[3]] for b in blocks]).ravel()
    p = np.repeat([b[0] / b[1] for b in blocks], 2)
    return x, p


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        # A little of the uncalibrated score keeps the order inside of the map's level parts.
        return np.clip(0.98 * np.interp(margin, *self.knots) + 0.02 / (1 + np.exp(-margin)), 0, 1)


def matrix(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    dense = dense_stats(data, offsets)
    return np.concatenate([lexicon.lexical(data, offsets, dense), dense], axis=1)


def _scores(model, keep: tuple[str, ...]):
    def run(batches):
        own = model.value
        for batch in batches:
            for part in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(own.score(matrix(own.lexicon, part.column("text"))))], [*keep, "score"])

    return run


def _terms(batches):
    """Each different word and stem of a text, once."""
    for batch in batches:
        kind, term, y, half = [], [], [], []
        for text, label, h in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), batch.column("half").to_pylist(), strict=True):
            distinct = set(_WORD.findall((text or "").encode().lower()))
            own = [(0, w) for w in distinct if len(w) < LONGEST] + [(1, s) for s in {w[:STEM] for w in distinct if len(w) > STEM}]
            kind += [k for k, _ in own]
            term += [t for _, t in own]
            y += [label] * len(own)
            half += [h] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(term, pa.binary()), pa.array(y, pa.int32()), pa.array(half, pa.int32())], ["kind", "term", "y", "half"])


def _learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Lexicons of the sample's first half, second half and whole: at most TERMS words and stems each."""
    counts = sample.mapInArrow(_terms, "kind int, term binary, y int, half int").groupBy("kind", "term").agg(
        *[F.count(F.when((F.col("y") == y) & (F.col("half") == h), 1)).cast("double").alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)]
    )
    counts = cut(counts.where("n10 + n11 >= 3"), "toxicity-terms")
    sizes = {(r["y"], r["half"]): r["count"] for r in sample.groupBy("y", "half").count().collect()}
    out = []
    for halves in ((0,), (1,), (0, 1)):
        n0, n1 = (sum(sizes.get((y, h), 0) for h in halves) for y in (0, 1))
        t0, t1 = (sum((F.col(f"n{y}{h}") for h in halves), F.lit(0.0)) for y in (0, 1))
        # Log odds with half a text added on either side, less what few texts would show by chance.
        weight = F.log((t1 + 0.5) / (n1 + 1) / ((t0 + 0.5) / (n0 + 1))) - 1 / F.sqrt(t1 + 0.01)
        rows = counts.where(t1 >= 3).select("kind", "term", weight.alias("w")).where("w > 0.5")
        rows = [r for k in (0, 1) for r in rows.where(F.col("kind") == k).orderBy(F.desc("w"), "term").limit(TERMS).collect()]
        text = lambda term: bytes(term).decode("utf-8", "surrogateescape")  # noqa: E731  a stem may end within a character
        out.append(Lexicon({text(r["term"]): r["w"] for r in rows if r["kind"] == 0}, {text(r["term"]): r["w"] for r in rows if r["kind"] == 1}))
    discard(counts)
    return out


def _fit_features(lexicons):
    def run(batches):
        own = lexicons.value
        for batch in batches:
            for part in steps(batch, "text"):
                # A text's own half has not seen its label, nor has any lexicon seen those of the calibration.
                half, pick = (part.column(c).to_numpy() for c in ("half", "pick"))
                which = np.where(pick == 0, 2, 1 - half)
                x = np.zeros((part.num_rows, N_FEATURES))
                for w in np.unique(which):
                    x[which == w] = matrix(own[w], part.column("text").filter(pa.array(which == w)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("y", "pick", "part")], pa.array(list(x), pa.list_(pa.float64()))], ["y", "pick", "part", "x"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """A model learned from up to fit_rows labelled documents outside of the held-out fold; None
    where they don't show both labels. Of several rows with an id, one text counts, chosen by its hash.

    A quarter is kept for the calibration and no lexicon sees its labels, so it is scored as new texts are; where that
    quarter has hardly any of a label, all are fitted on, and calibrated on by trees fitted without their quarter. The halves of the rest are given each other's lexicon, so the trees never see one that knew their labels."""
    spark = docs.sparkSession
    ship(spark)
    chosen = labelled_sample(labels, label_col, id_col, folds, held, fit_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    sample = cut(sample.select("text", "y", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("half"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)).cast("int").alias("pick")).withColumn("part", F.col("pick")), "toxicity-sample")
    shown = {(r["y"], r["kept"]): r["count"] for r in sample.groupBy("y", (F.col("pick") == 0).alias("kept")).count().collect()}
    if not {0, 1} <= {y for y, _ in shown}:
        discard(sample)
        return None
    if min(shown.get((y, True), 0) for y in (0, 1)) < CALIBRATE or min(shown.get((y, False), 0) for y in (0, 1)) < CALIBRATE:
        sample = sample.withColumn("pick", F.lit(1))  # too few to keep any back
    lexicons = _learn_lexicons(sample.where("pick <> 0"))
    shared = spark.sparkContext.broadcast(lexicons)
    rows = sample.repartition(SPREAD).mapInArrow(_fit_features(shared), "y int, pick int, part int, x array<double>").collect()  # fit_rows at most
    rows.sort(key=lambda r: (r["part"], r["y"], r["x"]))
    x, y, pick, part = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], np.float64), np.array([r["pick"] for r in rows]), np.array([r["part"] for r in rows])
    fit = pick != 0
    trees = fit_trees(x[fit], y[fit])
    if fit.all():  # each part is scored by trees that were fitted on the others
        margin = np.concatenate([fit_trees(x[part != p], y[part != p]).margin(x[part == p]) if (part != p).any() else trees.margin(x) for p in np.unique(part)])
        knots = fit_isotonic(margin, y)
    else:
        knots = fit_isotonic(trees.margin(x[~fit]), y[~fit])
    shared.unpersist()
    discard(sample)
    return ToxicityModel(lexicons[2], trees, knots)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Toxicity of every document: id_col, held_out, score, predicted.

    Only features of whole texts go in: densities of insults (given ones and words and stems learned
    from labels outside the held-out fold), how many stand near a second person, capitals, punctuation
    and obfuscation. They are computed for batches of texts in time linear in their bytes, so a text of many
    megabytes, of one word even, takes as long as short ones of that size. Null and empty texts have all features 0 and get that score; a null id counts as
    the empty text for the fold and has no label. Where the labels don't show both classes, the score
    is the share of given insults among the words, 20 times. Every row gives one row, repeated ones
    too; other columns are dropped.
    """
    spark = docs.sparkSession
    model = fit_toxicity(docs, labels, folds, held, id_col=id_col, text_col=text_col, **options)
    rows = docs.select(F.col(id_col).alias("_id"), fold(id_col, folds).alias("_fold"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(model or _Plain())
    scored = rows.mapInArrow(_scores(shared, ("_id", "_fold")), f"_id {dict(rows.dtypes)['_id']}, _fold long, score double")
    return scored.select(F.col("_id").alias(id_col), (F.col("_fold") == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """The documents whose toxicity is below the threshold, with all of their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, text_col=text_col, **options) or _Plain())

    def run(batches):
        own = model.value
        for batch in batches:
            for part in steps(batch, text_col):
                yield part.filter(pa.array(own.score(matrix(own.lexicon, part.column(text_col))) < threshold))

    return docs.mapInArrow(run, docs.schema)


class _Plain:
    lexicon = Lexicon()

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, 20 * x[:, 0])

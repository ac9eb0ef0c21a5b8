import numpy as np
import pytest

from lakeloom.llm.quality import class_prior, score_quality


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_of_mixtures(share):
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    n = int(2000 * share)
    assert abs(class_prior(positive[:2000], np.concatenate([positive[2000 : 2000 + n], negative[: 2000 - n]])) - share) < 0.06


def test_labels_of_0_are_not_learned_from(spark):
    """Without any label of 0, and with others than the true ones, scores stay as they are."""
    good = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60))) for i in range(300)]
    bad = [(1000 + i, "$$ !! $$ ## " * (5 + i % 9)) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    ones = [(i, 1) for i, _ in good[:150]]
    frame = lambda zeros: spark.createDataFrame(ones + zeros, "doc_id long, quality int")
    some = [(1000 + i, 0) for i in range(0, 40)]
    # The same documents are without a label in both cases.
    first = {r.doc_id: r.score for r in score_quality(docs, frame(some)).collect()}
    second = {r.doc_id: r.score for r in score_quality(docs, frame([(i, None) for i, _ in some])).collect()}
    assert first == second
    assert min(first[i] for i, _ in good) > 0.7 > max(first[i] for i, _ in bad)


def test_one_group_of_copies_is_drawn_by_its_share(spark):
    """A third of all documents has one text; it is a third of the sample too, whatever its hash."""
    copies = [(10_000 + i, "same words in a good text, as many times as it takes to be a third of all") for i in range(200)]
    good = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60))) for i in range(200)]
    bad = [(5000 + i, "$$ !! $$ ## " * (5 + i % 9)) for i in range(200)]
    docs = spark.createDataFrame(good + copies + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[::2] + copies[::2]], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in score_quality(docs, labels, fit_rows=150).collect()}
    assert sum(got[i] for i, _ in good + copies) >= 390 and not any(got[i] for i, _ in bad)

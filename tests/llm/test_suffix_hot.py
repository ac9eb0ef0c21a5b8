"""Rows that repeat, long texts and odd ids."""

import random
import tracemalloc

import numpy as np
import pytest

from brute import cut_passages
from lakeloom.llm import suffix
from lakeloom.llm.suffix import Texts, repeated_passages


def as_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_one_row_is_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 3000)
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = make(70)
    rows = [(5, "start " + line + " the end")] * 60 + [(i, make(rng.randint(0, 60)) + line[rng.randint(0, 8) :] + make(9)) for i in range(60)] + [(7, line), (7, line + "x"), (7, line), (None, line), (None, line)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, copies int").repartition(4)
    want = [(None if r[0] == -1 else r[0], *r[1:]) for r in cut_passages([(-1 if i is None else i, t) for i, t in rows], 50)]
    assert as_rows(repeated_passages(df)) == sorted(want, key=repr)


def test_long_texts(spark):
    """Texts of some megabytes, one made of one letter, among short ones; chunks smaller than they are."""
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, 3_000_000, np.uint8).tobytes().decode()
    part = long[1_000_000:1_000_400]
    rows = [(1, long), (2, "a" * 2_000_000), (3, "before " + part + " after"), (4, "a" * 80), (5, long[:2_000_000]), (0, "b" + part[:60])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (61, 0, 0) and got[2] == (2_000_000, 0, 0)
    assert got[1] == (3_000_000, 60, 1) and got[3] == (413, 400, 1) and got[4] == (80, 80, 1) and got[5] == (2_000_000, 2_000_000, 1)


def test_memory_of_a_long_text():
    text = np.random.default_rng(4).integers(97, 123, 20_000_000, np.uint8).tobytes()
    tracemalloc.start()
    texts = Texts([text], np.array([1]), 50)
    texts.classes(7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts.place) > 1_000_000 and peak < 12 * len(text)


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_without_a_known_order_are_an_error(spark, kind):
    with pytest.raises(TypeError):
        repeated_passages(spark.createDataFrame([], f"doc_id {kind}, text string"))


def test_spans_that_touch_are_one_run():
    text = bytes(range(100))
    gone, runs, sha = suffix._kept(text, np.array([[50, 60], [0, 5], [5, 10], [55, 58], [70, 71]]))
    import hashlib

    assert (gone, runs, sha) == (21, 3, hashlib.sha256(text[10:50] + text[60:70] + text[71:]).hexdigest())


def test_packed_columns():
    arrays = [np.array([5, 5, 5]), np.array([-3, 2**62, 0]), np.array([1, 300, 70000])]
    assert [a.tolist() for a in suffix._read_columns(suffix._columns(*arrays), 3)] == [a.tolist() for a in arrays]
    assert [len(a) for a in suffix._read_columns(suffix._columns(*[np.zeros(0, np.int64)] * 3), 3)] == [0, 0, 0]
    assert len(suffix._columns(*[np.array([9])] * 4)) == 40

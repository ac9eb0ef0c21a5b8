import os
import re

import pytest

from brute import leaks, near_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sharding":
            assert docs.columns == columns
    texts = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in inputs.items()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").collect()}
    gone = {i for i, _ in texts["toxicity"]} - {i for i, _ in texts["near_dedup"]}
    assert gone and len(gone - toxic) < len(texts["toxicity"]) // 10
    groups = near_groups(texts["near_dedup"], 5)
    assert sorted(i for i, _ in texts["decontamination"]) == sorted(i for i, (n, c) in groups.items() if i == c or not n)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = leaks([t for _, t in texts["decontamination"]], items, 5, 0.8)
    assert sorted(i for i, _ in texts["mixing"]) == sorted(i for row, (i, _) in enumerate(texts["decontamination"]) if row not in found)
    assert {i for i, _ in texts["sharding"]} <= {i for i, _ in texts["mixing"]}
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows)
    assert abs(words(texts["sharding"]) - words(texts["mixing"])) < 0.05 * words(texts["mixing"])
    assert docs.count() == len(texts["sharding"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r.doc_id for r in docs.collect())


def test_odd_documents_pass_through(spark, tmp_path):
    sf = str(tmp_path)
    rows = [(1, "some plain words in a row here", "en", "a", 5, "x"), (1, "some plain words in a row here", "en", "a", 5, "x"), (None, "null id and some words", None, None, None, "y"), (2, None, "en", "b", 0, None), (3, "", "en", "b", 0, "z"), (4, "w " * 30_000, "en", "a", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nothing like the others at all in here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for frame in (docs, docs.where("false")):
        frame.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert (len(got) > 0) == (frame is docs)

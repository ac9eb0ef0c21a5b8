import gzip
import hashlib

import pytest

from lakeloom.llm.common import fresh
from lakeloom.llm.warc import open_fs, page_records, read_records, register, write_and_read

BIG = "é" * 600
PAGES = [(1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (5, "http://again/5", BIG), (None, "http://null/", BIG), (7, "http://s/", "small"), (8, "http://s/2", "small"), (9, "u", None), (10, "u\r\nX: y", ""), (11, "http://w/", "WARC/1.1\r\n\r\n" * 200), (12, "http://l/", "x" * 3_000_000)]
SCHEMA = "page_id long, url string, html string"


def brute(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        top = max(same) if len(data) >= 1000 and same else i
        visit = top != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", top if visit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, 1, "f") for p in PAGES], SCHEMA + ", payload int, file string").repartition(3)
    got = write_and_read(df)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(PAGES)


def test_empty_table(spark):
    assert write_and_read(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_filters_reach_the_reader(spark, compression):
    register(spark)
    path = fresh(spark, "warc-test")
    page_records(spark.createDataFrame(PAGES, SCHEMA)).coalesce(1).write.format("warc").option("compression", compression).mode("append").save(path)
    everything = spark.read.format("warc").load(path)
    assert everything.count() == len(PAGES)
    visits = everything.where("record_type = 'revisit'")
    assert {r.record_id for r in visits.collect()} == {"urn:page:1", "urn:page:3", "urn:page:null"}
    mixed = everything.where("record_type = 'revisit' AND target_uri LIKE 'http://a/%' AND payload_length > 3")
    left = mixed._jdf.queryExecution().executedPlan().toString().partition("Filter (")[2].partition("BatchScan")[0]
    assert "payload_length" in left and "record_type" not in left and "target_uri" not in left and mixed.count() == 1
    assert everything.where("target_uri LIKE 'http://s/%' AND record_type IN ('response', 'revisit')").count() == 2
    assert everything.where("target_uri IS NOT NULL AND payload_length > 2000000").select("payload_length").first()[0] == 3_000_000
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.where("payload IS NOT NULL").count() == 0 and bare.count() == len(PAGES)
    # Splits and offsets point at records.
    fs, folder = open_fs(path)
    for r in everything.select("file", "offset", "record_id").collect():
        with fs.open_input_file(r.file) as raw:
            _, headers, _ = next(read_records(raw, r.offset, r.offset + 1, lambda h: True, True, r.file.endswith(".gz")))
            assert headers["warc-record-id"] == f"<{r.record_id}>"


def test_foreign_archive_without_manifest(spark, tmp_path):
    register(spark)
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:y>\r\nWARC-Target-URI: http://y/\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record + other)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(other))
    got = spark.read.format("warc").load(str(tmp_path))
    assert sorted((r.record_id, bytes(r.payload)) for r in got.collect()) == [("urn:x", b"hello"), ("urn:x", b"hello"), ("urn:y", b""), ("urn:y", b"")]
    assert got.where("target_uri = 'http://y/'").count() == 2


def test_executors_attempts_that_do_not_count_are_not_read(spark):
    register(spark)
    path = fresh(spark, "warc-test")
    page_records(spark.createDataFrame(PAGES[:3], SCHEMA)).write.format("warc").mode("append").save(path)
    fs, folder = open_fs(path)
    with fs.open_output_stream(f"{folder}/part-of-a-lost-attempt.warc.gz") as out:
        out.write(b"cut off")
    assert spark.read.format("warc").load(path).count() == 3

import gzip
import io
import random

import pyarrow.fs as pafs
import pytest

from lakeloom.llm.warc import gzip_member, member_length, open_fs, page_records, read_records, record_bytes


def test_places(tmp_path):
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        fs, at = open_fs(path)
        assert isinstance(fs, pafs.LocalFileSystem) and at == str(tmp_path)
    for bad in ("dbfs:/x/y", "dbfs://x", "relative/path", "wasbs://a@b/c", "s3a:/bucket"):
        with pytest.raises(ValueError):
            open_fs(bad)
    assert open_fs("s3a://bucket/a?region=us-east-1")[1] == "bucket/a" == open_fs("s3://bucket/a?region=us-east-1")[1]


def test_payloads_are_not_shuffled_where_few_repeat(spark):
    rows = [(i, "u", "x" * 1500 if i < 40 else f"page {i} " * 200) for i in range(60)]
    records = page_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert records.where("record_type = 'revisit'").count() == 39


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.file, self.read_bytes = io.BytesIO(data), 0

    def read(self, n):
        out = self.file.read(n)
        self.read_bytes += len(out)
        return out

    def seek(self, at):
        return self.file.seek(at)

    def tell(self):
        return self.file.tell()


@pytest.mark.parametrize("gzipped", [True, False])
def test_unwanted_payloads_are_not_decoded(gzipped):
    """Their packed bytes may be nonsense; large ones aren't even read."""
    rng = random.Random(1)
    out, wanted = b"", []
    for i in range(40):
        text = bytes(rng.randrange(256) for _ in range(rng.choice([10, 3000, 400_000])))
        row = {"record_type": "response", "record_id": f"urn:{i}", "date": "2024-01-01T00:00:00Z", "target_uri": f"http://x/{i}", "payload_digest": "00" * 20, "payload_length": len(text), "payload": text, "refers_to": None}
        data = record_bytes(row)
        member = bytearray(gzip_member(data) if gzipped else data)
        if gzipped:
            assert member_length(bytes(member[:64])) == len(member) and gzip.decompress(bytes(member)) == data
        if i % 10 == 0:
            wanted.append((f"<urn:{i}>", text))
        elif gzipped and len(text) > 100_000:
            member[-50_000:-8] = b"\0" * 49_992
        out += bytes(member)
    file = Counted(out)
    got = [(h["warc-record-id"], p) for _, h, p in read_records(file, 0, len(out), lambda h: h["warc-record-id"] in {w for w, _ in wanted}, True, gzipped)]
    assert got == wanted and file.read_bytes < 0.7 * len(out)


def test_members_without_lengths_are_unpacked():
    records = [record_bytes({"record_type": "response", "record_id": f"urn:{i}", "date": "d", "target_uri": None, "payload_digest": "00" * 20, "payload_length": 5, "payload": b"x" * 200_000, "refers_to": None}) for i in range(3)]
    data = gzip.compress(records[0]) + gzip_member(records[1]) + gzip.compress(records[2])
    for wanted in (True, False):
        found = list(read_records(io.BytesIO(data), 0, len(data), lambda h: wanted or h["warc-record-id"] == "<urn:2>", False, True))
        assert [h["warc-record-id"] for _, h, _ in found] == (["<urn:0>", "<urn:1>", "<urn:2>"] if wanted else ["<urn:2>"])

"""WARC archives as a Python data source: written and read in parallel, with pushed-down filters."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from lakeloom.llm.common import cut, fresh, ship, spread_join

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "payload_length long, refers_to string, payload binary, file string, offset long"
)
#: Columns that are read from a record's headers alone.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "payload_length": "x-payload-length",
    "refers_to": "warc-refers-to",
}
MANIFEST = "_manifest.json"
#: Bytes of records between two places at which a file may be split.
SPLIT_BYTES = 8 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as an executor sees it: an absolute path of a file system that is mounted
    everywhere, file:, s3: (s3a: and s3n: are the same), gs:, and hdfs: where libhdfs is installed. Any other scheme is an
    error, and so is a path that depends on where a worker runs."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        if not path.startswith("/"):
            raise ValueError(f"not an absolute path: {path}")
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    known = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}
    if scheme not in known or not rest.startswith("//"):
        raise ValueError(f"WARC archives can't be kept at {path}: {scheme}: isn't among {', '.join(sorted(known))} and file:")
    return pafs.FileSystem.from_uri(f"{known[scheme]}:{rest}")


def _header_text(value: str) -> str:
    """A header's value must stay on its line."""
    return quote(value, safe="".join(chr(c) for c in range(0x20, 0x7F)) + "".join(c for c in value if ord(c) > 0x9F))


def _digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(row: dict) -> bytes:
    """One record: headers, block and the two empty lines. A revisit has no payload of its own."""
    payload = row["payload"] or b""
    block = b""
    if row["record_type"] != "revisit":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_header_text(row['target_uri'])}")
    head += [f"WARC-Payload-Digest: {_digest(row['payload_digest'])}", f"X-Payload-Length: {row['payload_length']}"]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose header tells how long it is, in the extra field `sl` (both lengths, 32 bits each), so that a reader
    can leave it out without unpacking it. Lengths that don't fit are left out."""
    packer = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if len(body) + 24 >> 32 or len(data) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(body) + 24, len(data)) + body


def member_length(head: bytes) -> int | None:
    """What a member's first bytes tell of its length."""
    if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, size = struct.unpack_from("<2sH", head, at)
        if name == b"sl" and size == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file of its own under a name that no other attempt has; the manifest, written
    last, lists the files of the attempts that count, so a lost executor leaves nothing that is read."""

    def __init__(self, path: str, gzipped: bool):
        self.path, self.gzipped = path, gzipped

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        name, out, at, splits = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzipped, None, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = record_bytes(row)
                if self.gzipped:
                    data = gzip_member(data)
                if not splits or at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
                out.write(data)
                at += len(data)
        if out is None:
            return Written([])
        out.close()
        return Written([{"file": name, "bytes": at, "splits": splits}])

    def commit(self, messages) -> None:
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        fs, path = open_fs(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{path}/{f['file']}")


class Slice(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class _Stream:
    """Bytes of a file from `at` on; gzip members are unpacked one by one, no further than asked for."""

    def __init__(self, raw, at: int, gzipped: bool):
        self.raw, self.gzipped = raw, gzipped
        raw.seek(at)
        self.buffer, self.packed, self.unpack = b"", b"", None
        if gzipped:
            self._open()

    def _open(self) -> bool:
        """Begin a member: its header may tell where it ends."""
        if len(self.packed) < 256:
            self.packed += self.raw.read(1 << 16)
        at, length = self.raw.tell() - len(self.packed), member_length(self.packed[:256])
        self.end = None if length is None else at + length
        self.buffer, self.unpack, self.step = b"", zlib.decompressobj(31), 1 << 12
        return bool(self.packed)

    def _more(self) -> bool:
        if not self.gzipped:
            new = self.raw.read(1 << 18)
            self.buffer += new
            return bool(new)
        if self.unpack.eof:
            return False
        data = self.packed or self.raw.read(1 << 16)
        if not data:
            return False
        self.buffer += self.unpack.decompress(data, self.step)
        self.packed = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        self.step = min(self.step * 4, 1 << 18)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (i := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        out, self.buffer = self.buffer[:i], self.buffer[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [self.buffer[:n]], min(n, len(self.buffer))
        self.buffer = self.buffer[n:]
        while got < n and self._more():
            parts.append(self.buffer[: n - got])
            self.buffer, got = self.buffer[n - got :], got + len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Leave the n bytes of a block out: a plain file is sought past them. In a gzip member nothing is done, since
        next_member() goes past it."""
        if self.gzipped:
            return
        if n > len(self.buffer):
            self.raw.seek(self.raw.tell() + n - len(self.buffer))
            self.buffer = b""
        else:
            self.buffer = self.buffer[n:]

    def next_member(self) -> bool:
        """Go to the next gzip member: past one that tells its length by a seek, else by unpacking it piecewise."""
        if not self.unpack.eof and self.end is not None:
            left = self.raw.tell() - self.end
            if 0 <= left <= len(self.packed):
                self.packed = self.packed[len(self.packed) - left :]
            else:
                self.raw.seek(self.end)
                self.packed = b""
        else:
            while not self.unpack.eof:
                self.buffer = b""
                if not self._more():
                    return False
        return self._open()

    def position(self) -> int:
        return self.raw.tell() - len(self.packed if self.gzipped else self.buffer)


def read_records(raw, start: int, end: int, wanted, payloads: bool, gzipped: bool) -> Iterator[tuple[int, dict, bytes | None]]:
    """(offset, headers, payload) of the records that begin in [start, end). Headers are parsed first;
    where they aren't wanted, the block is skipped. Records that were cut off end the slice."""
    stream = _Stream(raw, start, gzipped)
    while (offset := stream.position()) < end:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        payload = None
        if wanted(headers):
            if payloads:
                payload = stream.take(length)
                if "msgtype=response" in headers.get("content-type", "") and payload.startswith(b"HTTP/"):
                    payload = payload.partition(b"\r\n\r\n")[2]
            else:
                stream.skip(length)
            yield offset, headers, payload
        else:
            stream.skip(length)
        if gzipped:
            if not stream.next_member():
                return
        else:
            stream.skip(4)


def _field(column: str, headers: dict):
    value = headers.get(HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    if column == "payload_length":
        return int(value)
    if column == "payload_digest" and value.startswith("sha1:"):
        text = value.removeprefix("sha1:")
        return base64.b32decode(text).hex() if len(text) == 32 else text.lower()
    return value


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.tests = path, payloads, []

    def pushFilters(self, filters):
        """Equality, membership, prefixes and presence of header columns are tested on the headers alone."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()) or ())
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull)):
                kind = "in" if isinstance(f, In) else "prefix" if isinstance(f, StringStartsWith) else "there" if isinstance(f, IsNotNull) else "in"
                self.tests.append((column, kind, tuple(f.value) if isinstance(f, In) else (getattr(f, "value", None),)))
            else:
                yield f

    def partitions(self):
        fs, path = open_fs(self.path)
        try:
            with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
                files = json.loads(f.read())
        except FileNotFoundError:
            found = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
            base = path if len(found) != 1 or found[0].path != path else path.rpartition("/")[0]
            files = [{"file": x.path.removeprefix(base).lstrip("/"), "bytes": x.size, "splits": [0]} for x in sorted(found, key=lambda x: x.path) if x.path.endswith((".warc", ".warc.gz"))]
            path = base
        out = [Slice(f"{path}/{f['file']}", a, b) for f in files for a, b in zip(f["splits"], [*f["splits"][1:], f["bytes"]], strict=True)]
        return out or [Slice("", 0, 0)]

    def _wanted(self, headers: dict) -> bool:
        for column, kind, values in self.tests:
            value = _field(column, headers)
            if kind == "there":
                if value is None:
                    return False
            elif value is None or not (value.startswith(values[0]) if kind == "prefix" else value in values):
                return False
        return True

    def read(self, part: Slice):
        if not part.file:
            return
        fs, _ = open_fs(self.path)
        columns: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        size = 0
        with fs.open_input_file(part.file) as raw:
            for offset, headers, payload in read_records(raw, part.start, part.end, self._wanted, self.payloads, part.file.endswith(".gz")):
                for c in HEADERS:
                    columns[c].append(_field(c, headers))
                columns["payload"].append(payload), columns["file"].append(part.file), columns["offset"].append(offset)
                size += len(payload or b"") + 512
                if size > 8 << 20:
                    yield _batch(columns)
                    columns, size = {c: [] for c in columns}, 0
        if columns["file"]:
            yield _batch(columns)


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in columns.items()], list(columns))


class WarcSource(DataSource):
    """format("warc"). Options: path; payload=false leaves payloads out; compression=none|gzip (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record per page, as the writer takes it. Of pages with equal payloads of at least `least` bytes, that
    with the largest id is the response (each row with that id, if it comes several times) and the
    others revisit it; null ids come before all others. A null payload is empty."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("_id"), F.col(id_col).alias("_order"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    same = rows.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("_order").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # Digests and ids alone are shuffled to see which payloads repeat. Where they are few, payloads stay where they are.
    same = cut(same, "warc-same")
    rows = spread_join(rows, same, "payload_digest", F.coalesce("_id", F.lit("")), same.count(), salts=16)
    revisit = F.col("_top").isNotNull() & ~F.col("_order").eqNullSafe(F.col("_top")) & (F.col("payload_length") >= least)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c, F.lit("null")))
    return rows.select(
        name(F.col("_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"), "payload_digest",
        "payload_length", F.when(revisit, name(F.col("_top").cast("string"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("offset"),
    )


def page_id(c: Column) -> Column:
    text = F.substring(c, len("urn:page:") + 1, 64)
    return F.when(text != "null", text).cast("long")


def write_and_read(pages: DataFrame, least: int = 1000, **columns) -> DataFrame:
    """Write the pages as WARC archives to the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, file. The figures of a response are taken from the payload that was
    read, those of a revisit from its headers. Repeated rows each give a record; an empty table gives none;
    other columns are dropped."""
    spark = pages.sparkSession
    register(spark)
    path = fresh(spark, "warc")
    page_records(pages, least, **columns).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    own = F.col("record_type") != "revisit"
    return back.select(
        page_id(F.col("record_id")).alias("page_id"), F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page_id(F.col("refers_to")).alias("refers_to"), "file",
    )

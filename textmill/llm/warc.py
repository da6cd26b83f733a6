"""Operator 8, WARC: a Python data source that reads archives with planned
file partitions and header predicates pushed down, and a writer that replaces
equal payloads by revisit records.

Archives are gzip members, one a record, as the WARC format recommends.  The
writer notes each member's compressed size in a gzip extra field, so that the
reader can step over unwanted records without inflating them; members without
the field are inflated to find their end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from textmill.llm.common import file_system, shared_path

#: Bytes of files that one partition reads, and of payloads in one Arrow batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Payloads below this size are never replaced by revisits.
MIN_REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
#: Header columns, and the WARC header that each comes from.
HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = "record_id string, warc_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, payload_bytes long, payload binary"
_ARROW = pa.schema([(k, pa.string()) for k in HEADERS] + [("content_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _member(record: bytes, level: int = 1) -> bytes:
    """One gzip member, with its whole size in an extra field "SZ"."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x04\xff" + struct.pack("<H2sHQ", 12, b"SZ", 8, size)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _uri(text: str) -> str:
    """A header value cannot hold line ends or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), text)


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = ID_PREFIX + ("" if page_id is None else str(page_id))
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _uri(url))] if url else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record(headers, _http(len(payload)) + payload)
    # A revisit's block is the response's HTTP header, which has the payload's size.
    return _record([*headers, ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)], _http(len(payload)))


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Write one record a page (null html: empty payload) to archives in
    ``folder`` (by default a new one in the shared folder).  Of equal payloads
    of at least ``MIN_REVISIT_BYTES``, that with the largest id is a response
    and the others revisit it.  Returns the folder and a table of its files.

    Pages without an id are always responses; equal rows get equal records.
    A file's name is its partition's, so a task that runs again replaces it."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    slim = slim.withColumn("digest", F.when(F.octet_length("html") >= MIN_REVISIT_BYTES, F.sha2("html", 256)))
    keyed = slim.where(F.col("digest").isNotNull()).select("id", "digest")
    largest = keyed.groupBy("digest").agg(F.max("id").alias("keeper"), F.min("id").alias("other")).where("keeper > other").select("digest", "keeper")
    # One id may stand for several payloads, each repeated or not.
    revisits = keyed.join(largest, "digest").where("id < keeper").groupBy("id", "digest").agg(F.max("keeper").alias("refers_to"))
    rows = slim.join(revisits, ["id", "digest"], "left").select("id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n, size = TaskContext.get().partitionId(), None, 0, 0
        temporary = f"{root}/.part-{part:07d}-{TaskContext.get().taskAttemptId()}"
        final = f"{root}/part-{part:07d}.warc.gz"
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None:
                    out = fs.open_output_stream(temporary, compression=None)
                    info = _member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{part}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    size += len(info)
                member = _member(page_record(page, url, html.encode(), refers, date))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            fs.move(temporary, final)
            yield pa.record_batch([pa.array([f"{folder}/part-{part:07d}.warc.gz"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    from textmill.llm.common import written

    return folder, written(rows.mapInArrow(write, "file string, records long, bytes long"), "warc-files")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[tuple] = []

    def pushFilters(self, filters):
        """Predicates on header columns are decided from a record's headers;
        the rest goes back to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.filters.append((column, "in", [f.value]))
            elif column in HEADERS and isinstance(f, In):
                self.filters.append((column, "in", list(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.filters.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.filters.append((column, "some", None))
            else:
                yield f

    def partitions(self):
        """Files in order of name, several small ones to a partition."""
        from pyarrow import fs as pafs

        fs, root = file_system(self.uri)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        parts: list[list[str]] = []
        room = 0
        for f in sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and re.search(r"\.warc(\.gz)?$", f.base_name)), key=lambda f: f.path):
            if not parts or room < f.size:
                parts.append([])
                room = self.bytes
            parts[-1].append(f.path)
            room -= f.size
        return [_Files(p) for p in parts] or [_Files([])]

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            have = row[column]
            if have is None or kind == "in" and have not in value or kind == "starts" and not have.startswith(value):
                return False
        return True

    def read(self, partition: _Files):
        fs, _ = file_system(self.uri)
        rows, size = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as f:
                for row in records(f, path.endswith(".gz"), self.wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Stream:
    """Bytes of one record: a plain file, or one gzip member of it."""

    def __init__(self, f, packed: bool, chunk: int = 4096):
        self.f, self.start, self.data = f, f.tell(), b""
        self.inflate = zlib.decompressobj(31) if packed else None
        self.chunk, self.size, self.ended = chunk, None, False
        if packed:
            head = f.read(24)
            if len(head) == 24 and head[3] & 4 and head[12:14] == b"SZ":
                self.size = struct.unpack("<Q", head[16:24])[0]
            f.seek(self.start)

    def more(self, n: int) -> bool:
        raw = self.f.read(n)
        if not raw or self.ended:
            return False
        if self.inflate is None:
            self.data += raw
        else:
            self.data += self.inflate.decompress(raw)
            if self.inflate.eof:
                self.ended = True
                self.f.seek(self.f.tell() - len(self.inflate.unused_data))
        return True

    def need(self, n: int) -> bytes:
        while len(self.data) < n and self.more(max(self.chunk, n - len(self.data))):
            pass
        return self.data[:n]

    def headers(self) -> dict[str, str] | None:
        while b"\r\n\r\n" not in self.data:
            if not self.more(self.chunk):
                return None
        top, self.rest = self.data.split(b"\r\n\r\n", 1)
        self.top = len(top) + 4
        lines = top.decode("utf-8", "replace").split("\r\n")
        if not lines[0].lstrip().startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {self.start}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def skip(self, length: int) -> None:
        """Go to the next record: by the member's size, or its end."""
        if self.size is not None:
            self.f.seek(self.start + self.size)
        elif self.inflate is not None:
            while not self.ended and self.more(1 << 16):
                self.data = b""
        else:
            self.f.seek(self.start + self.top + length + 4)


def records(f, packed: bool, wanted, payload: bool) -> Iterator[dict]:
    """The records of an open archive that ``wanted`` takes by their headers."""
    end = f.size()
    while f.tell() < end:
        s = _Stream(f, packed)
        headers = s.headers()
        if headers is None:
            break
        length = int(headers.get("content-length", 0))
        row = {k: headers.get(v.lower()) for k, v in HEADERS.items()}
        for k in ("record_id", "refers_to"):
            row[k] = row[k].strip("<>") if row[k] else None
        if row["payload_digest"] and row["payload_digest"].startswith("sha1:") and len(row["payload_digest"]) == 37:
            row["payload_digest"] = base64.b32decode(row["payload_digest"][5:]).hex()
        if wanted(row):
            row |= {"content_length": length, "payload_bytes": length, "payload": None}
            http = (row["content_type"] or "").startswith("application/http")
            block = s.need(s.top + length)[s.top :] if payload or http and row["warc_type"] == "revisit" else s.need(s.top + min(length, 8192))[s.top :] if http else b""
            if http:
                head, _, body = block.partition(b"\r\n\r\n")
                size = re.search(rb"(?mi)^content-length:\s*(\d+)", head)
                row["payload_bytes"] = int(size[1]) if size else length - len(head) - 4
                block = body
            row["payload"] = block if payload and row["warc_type"] != "revisit" else None
            yield row
        s.skip(length)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; with ``payload`` false,
    payloads are neither inflated nor returned."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives at ``path``, as ``SCHEMA``; filters on
    header columns are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(column: str):
    """The id in a record's name; null where it has none."""
    return F.nullif(F.substring_index(column, ":", -1), F.lit("")).cast("long")


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of pages: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``.  Responses are digested from their payload;
    revisits are read by their headers."""
    full = read_warc(spark, path).where(F.col("warc_type") == "response")
    again = read_warc(spark, path, payload=False).where(F.col("warc_type") == "revisit")
    return full.select(page_id("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
                       F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        again.select(page_id("record_id"), "payload_bytes", "payload_digest", "warc_type", page_id("refers_to")))

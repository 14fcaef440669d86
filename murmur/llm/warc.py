"""WARC archives as a PySpark Python data source.

Reading plans one partition per group of archive files (about
``split_bytes`` each), takes filters on record type and header columns, reads a
record's headers first, and decodes a payload only when the option ``payload``
asks for it and the record passed the filters; otherwise it seeks past it
(plain archives) or inflates without keeping it (``.gz``, one member a record).
Writing gives one archive per task; the driver's commit gives the files of
the successful attempts their final names.

Files are reached through ``pyarrow.fs``, so any shared file system it knows
will do.

Defined cases: a null payload is empty; a null id is written as ``none`` and
read as null; header values cannot hold line breaks (they become ``%0A`` and
``%0D``); a record cut off at the end of an archive raises an error.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    WriterCommitMessage)

from murmur.session import scratch_path

SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, date string, payload_digest string, "
          "payload_length long, payload binary")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns that come from headers: filters on them are decided before the payload.
HEADER_COLUMNS = frozenset(COLUMNS) - {"payload", "payload_length"}
#: Smallest payload that is stored once and revisited.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = pa.schema([(c, pa.int64() if c == "payload_length" else pa.binary() if c == "payload" else pa.string()) for c in COLUMNS])


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str | None, uri: str | None, refers_to: str | None, date: str, digest: str, length: int,
           payload: bytes) -> bytes:
    """One WARC record; ``digest`` is hex SHA-1 and ``length`` the size of the full payload."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n").encode()
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if record_id is None else _clean(record_id)}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_clean(refers_to or 'none')}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class _Members:
    """The records of a gzip archive as one readable stream; skipping inflates without keeping."""

    def __init__(self, raw):
        self.raw, self.buffer, self.inflate, self.ended = raw, b"", zlib.decompressobj(31), False

    def _fill(self) -> None:
        data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        data = data or self.raw.read(1 << 16)
        if not data:
            self.ended = True
            return
        self.buffer += self.inflate.decompress(data, 1 << 18)

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0 and not self.ended:
            if not self.buffer:
                self._fill()
                continue
            parts.append(self.buffer[:n])
            self.buffer = self.buffer[n:]
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0:
            got = len(self.read(min(n, 1 << 18)))
            if not got:
                raise ValueError("archive ends inside a record")
            n -= got

    def line(self) -> bytes:
        while b"\n" not in self.buffer and not self.ended:
            self._fill()
        end = self.buffer.find(b"\n") + 1 or len(self.buffer)
        out, self.buffer = self.buffer[:end], self.buffer[end:]
        return out


class _Plain:
    def __init__(self, raw):
        self.raw = io.BufferedReader(raw, 1 << 18) if isinstance(raw, io.RawIOBase) else raw

    def read(self, n: int) -> bytes:
        return self.raw.read(n)

    def skip(self, n: int) -> None:
        self.raw.seek(n, 1)

    def line(self) -> bytes:
        return self.raw.readline()


def _headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.line().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(value: str | None) -> str | None:
    name = None if value is None else value.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else name


def read_archive(stream, passes, payload: bool) -> Iterator[tuple]:
    """Rows of one archive; ``passes`` sees the header columns and decides before the block is read."""
    while True:
        line = stream.line()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(stream)
        size = int(head["content-length"])
        digest = head.get("warc-payload-digest", "")
        digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
        row = {"record_type": head.get("warc-type"), "record_id": _page(head.get("warc-record-id")),
               "target_uri": head.get("warc-target-uri"), "refers_to": _page(head.get("warc-refers-to")),
               "date": head.get("warc-date"), "payload_digest": digest}
        if not passes(row):
            stream.skip(size)
            continue
        body = None
        if not head.get("content-type", "").startswith("application/http"):
            length = size                               # the block is the payload
            left = size
        else:
            http, left = {}, size
            while left > 0:
                line = stream.line()
                left -= len(line)
                if not line.rstrip(b"\r\n"):
                    break
                name, _, value = line.decode("latin-1").partition(":")
                http[name.strip().lower()] = value.strip()
            length = int(http.get("content-length", left))
        if payload and row["record_type"] != "revisit":
            body = stream.read(left)
            if len(body) < left:
                raise ValueError("archive ends inside a record")
        else:
            stream.skip(left)
        yield (*row.values(), length, body)


@dataclass
class Archives(InputPartition):
    files: list[str]


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", 128 << 20))
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADER_COLUMNS:
                self.equal.append((name, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True))
                 if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and "/_" not in x.path[len(root):]]
        out, size = [[]], 0
        for x in sorted(found, key=lambda x: x.path):
            if out[-1] and size + x.size > self.split_bytes:
                out.append([])
                size = 0
            out[-1].append(x.path)
            size += x.size
        return [Archives(x) for x in out]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        passes = lambda row: all(row[c] in v for c, v in self.equal)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
        for path in partition.files:
            with fs.open_input_file(path) as raw:
                stream = _Members(raw) if path.endswith(".gz") else _Plain(io.BufferedReader(raw, 1 << 18))
                for row in read_archive(stream, passes, self.payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.gzip = options.get("compression", "none") == "gzip"
        self.run = uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}-{task.taskAttemptId()}.warc" + ".gz" * self.gzip
        fs, root = pafs.FileSystem.from_uri(self.path)
        out, n = None, 0
        for batch in iterator:
            for r in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                r = dict(zip(COLUMNS, r))
                if out is None:
                    fs.create_dir(f"{root}/_attempts", recursive=True)
                    out = fs.open_output_stream(f"{root}/_attempts/{name}", compression=None)
                data = record(r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["date"] or self.date,
                              r["payload_digest"], r["payload_length"], r["payload"] or b"")
                out.write(gzip.compress(data, 6, mtime=0) if self.gzip else data)
                n += 1
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def commit(self, messages: list[Written]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m is not None and m.file:
                fs.move(f"{root}/_attempts/{m.file}", f"{root}/{m.file}")

    def abort(self, messages: list[Written]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/_attempts/{m.file}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let it take filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Archive rows of ``pages``: of equal payloads of ``least`` bytes or more, the largest id is the response, others revisit it.

    Payloads meet by SHA-1 and length; only keys go into the aggregate that
    finds the response.  Rows that repeat the response's id are responses too;
    rows without an id revisit a row that has one.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"),
                        F.coalesce(F.encode(F.col(source), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("payload_length") >= least).groupBy("payload_digest", "payload_length").agg(F.max("id").alias("response"))
    rows = rows.join(first, ["payload_digest", "payload_length"], "left")
    again = F.expr("response is not null and not (id <=> response)")
    return rows.select(F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("id").cast("string").alias("record_id"),
                       "target_uri", F.when(again, F.col("response").cast("string")).alias("refers_to"), F.lit(None).cast("string").alias("date"),
                       "payload_digest", "payload_length", F.when(~again, F.col("payload")).alias("payload"))


def write(rows: DataFrame, path: str, compression: str = "none", date: str = "1970-01-01T00:00:00Z") -> None:
    register(rows.sparkSession)
    rows.select(*COLUMNS).write.format("warc").mode("append").option("compression", compression).option("date", date).save(path)


def round_trip(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Write the pages to archives in the shared checkpoint folder and read every record back.

    Digest and size of a response are computed from its payload as read; those
    of a revisit come from its headers.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(records(pages, key), path, "gzip")
    back = read(spark, path)
    full = F.col("record_type") == "response"
    return back.select(F.col("record_id").cast("long").alias(key),
                       F.when(full, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
                       F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"), "target_uri")

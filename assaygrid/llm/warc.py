"""WARC archives as a PySpark data source: spark.read.format("warc"), df.write.format("warc").

Reading: a partition is a file, found by one listing. Predicates on record type, id, URI, date, digest and
reference are pushed down. A record's headers are parsed first; of one that a predicate rejects, or
whose payload is not wanted, the block is passed over without being decoded.

Writing: gzip members, one a record, in files of bounded size, through pyarrow's file systems, so any
store they reach will do. Names tell the job and the attempt of a task; a job that commits removes what
its other attempts left.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from assaygrid.llm.tables import arrow_batches, fresh_path, without

SCHEMA = "record_id string, record_type string, uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Bytes after which a writer begins another file; a file is what a task reads.
FILE_BYTES = 64 << 20
#: Columns that headers alone give, with their headers (fixed values of the format).
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_header(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(row: dict) -> bytes:
    """The bytes of a record before compression."""
    kind, payload = row["record_type"] or "response", row["payload"] or b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"] or "1970-01-01T00:00:00Z")]
    if row["uri"] is not None:
        # a line end would end the header
        head.append(("WARC-Target-URI", row["uri"].replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Payload-Digest", row["payload_digest"]), ("X-Payload-Length", str(row["payload_bytes"]))]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        head.append(("WARC-Payload-Digest", row["payload_digest"] or digest_header(hashlib.sha1(payload).digest())))
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


class Stream(io.RawIOBase):
    """Bytes of a file, inflated member by member if they are gzip."""

    def __init__(self, raw):
        self.raw = raw
        self.held = b""
        self.first = self._more()
        self.zip = self.first[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zip else None
        self.rest = self.first
        self.done = False

    def _more(self) -> bytes:
        return self.raw.read(1 << 20)

    def fill(self) -> bool:
        """More bytes in held; False at the end."""
        while True:
            if not self.rest:
                self.rest = self._more()
                if not self.rest:
                    return False
            if not self.zip:
                self.held, self.rest = self.held + self.rest, b""
                return True
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(self.rest, 1 << 20)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.held += out
                return True

    def line(self) -> bytes | None:
        while (i := self.held.find(b"\n")) < 0:
            if not self.fill():
                return None
        out, self.held = self.held[:i].rstrip(b"\r"), self.held[i + 1 :]
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next n bytes; passed over if keep is not set."""
        parts = []
        while n:
            if not self.held and not self.fill():
                raise ValueError("a WARC record ends before its length")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def records(raw, wanted: dict[str, frozenset], payloads: bool) -> Iterator[dict]:
    """Records of a file that meet wanted (column: values)."""
    stream = Stream(raw)
    while True:
        line = stream.line()
        while line is not None and not line.startswith(b"WARC/"):
            line = stream.line()
        if line is None:
            return
        head: dict[str, str] = {}
        last = None
        while line := stream.line():
            if line[:1] in b" \t" and last:
                head[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            head[last] = value.strip()
        size = int(head.get("content-length", 0))
        row = {c: head.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        if any(row[c] not in values for c, values in wanted.items()):
            stream.take(size, keep=False)
            continue
        row |= {"payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None, "payload": None}
        if not payloads or row["record_type"] == "revisit":
            stream.take(size, keep=False)
        else:
            block = stream.take(size)
            if head.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            row |= {"payload": block, "payload_bytes": len(block)}
        yield row


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.payloads = options.get("payload", "true").lower() == "true" and "payload" in columns
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality and membership on header columns; leaves the rest to Spark."""
        for f in filters:
            values = {EqualTo: lambda f: [f.value], In: lambda f: list(f.value)}.get(type(f))
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
                yield f
                continue
            name, found = f.attribute[0], frozenset(values(f)) - {None}
            self.wanted[name] = self.wanted.get(name, found) & found

    def partitions(self) -> list[InputPartition]:
        store, path = open_store(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        found = sorted(f.path for f in files if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        return [InputPartition(p) for p in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        store, _ = open_store(self.path)
        held, size = [], 0
        with store.open_input_stream(partition.value, compression=None) as raw:
            for row in records(raw, self.wanted, self.payloads):
                held.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns)


@dataclass
class Wrote(WriterCommitMessage):
    paths: list[str] = field(default_factory=list)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job = options["path"], uuid.uuid4().hex
        store, path = open_store(self.path)
        if overwrite and store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir_contents(path)
        store.create_dir(path, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, path = open_store(self.path)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        done, attempt = Wrote([]), uuid.uuid4().hex[:8]
        out, at = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is not None and at > FILE_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        done.paths.append(f"{path}/{self.job}-{task:06d}-{len(done.paths):03d}-{attempt}.warc.gz")
                        out, at = store.open_output_stream(done.paths[-1], compression=None), 0
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = squeeze.compress(record(row)) + squeeze.flush()
                    out.write(data)
                    at += len(data)
            if out is not None:
                out.close()
        except BaseException:
            self._remove(done.paths)
            raise
        return done

    def commit(self, messages: list[Wrote | None]) -> None:
        """What attempts of this job left that did not commit goes."""
        store, path = open_store(self.path)
        kept = {p.rpartition("/")[2] for m in messages if m is not None for p in m.paths}
        for f in store.get_file_info(fs.FileSelector(path)):
            name = f.path.rpartition("/")[2]
            if name.startswith(self.job) and name not in kept:
                store.delete_file(f.path)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._remove([p for m in messages if m is not None for p in m.paths])

    def _remove(self, paths: list[str]) -> None:
        store, _ = open_store(self.path)
        for p in paths:
            if store.get_file_info(p).type == fs.FileType.File:
                store.delete_file(p)


class WarcDataSource(DataSource):
    """Options: path; payload ("false": headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """pages as rows of SCHEMA: of equal payloads of at least least bytes, the largest page_id is a response, others revisit it.

    Null html: empty. Null page_ids: ranked below all others; records of their own with id page:null.
    Rows that repeat the largest page_id and payload are responses, each. Equality is by SHA-1 and length.
    """
    rows = without(pages).select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("uri"),
        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    # only digests seen twice are in the table of firsts; where it is too large to broadcast, payloads are shuffled by digest,
    # and adaptive execution splits a digest that very many pages share
    firsts = rows.where(f"payload_bytes >= {least}").groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(firsts, ["sha1", "payload_bytes"], "left")
    revisits = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    name = lambda c: F.concat(F.lit("page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        "uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), _base32(F.col("sha1"))).alias("payload_digest"),
        "payload_bytes",
        F.when(revisits, name(F.col("first"))).alias("refers_to"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def _base32(sha1):
    """A digest's 40 hex digits as the 32 letters that the header carries: eight groups of five digits, each four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    part = lambda i, j: F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 10).cast("int").bitwiseAND(31 << 5 * (3 - j))
    return F.concat(*[F.substring(letters, F.shiftright(part(i, j), 5 * (3 - j)) + 1, F.lit(1)) for i in range(8) for j in range(4)])


def hex_digest(header):
    """The hex digits of a digest as payload_digest has it."""
    letter = lambda i: (F.position(F.substring(header, 6 + i, 1), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")) - 1).cast("long")
    part = lambda i: sum((F.shiftleft(letter(8 * i + j), 5 * (7 - j)) for j in range(1, 8)), F.shiftleft(letter(8 * i), 35))
    return F.lower(F.concat(*[F.lpad(F.hex(part(i)), 10, "0") for i in range(4)]))


def write_archive(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Writes pages as WARC files and returns their folder (a new one in the shared folder by default)."""
    spark = pages.sparkSession
    arrow_batches(spark)
    register(spark)
    path = path or fresh_path(spark, "warc")
    page_records(pages, **columns).write.format("warc").option("path", path).mode("append").save()
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the WARC files at path, as SCHEMA has them. payload False: headers only, payload_bytes only where a header gives them."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)

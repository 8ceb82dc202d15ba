"""WARC archives as a Spark data source, and pages archived with revisit records.

Reading: files are packed into partitions by size. Predicates on the record type and other headers are taken over from
Spark. Of each record only the headers are inflated first; if a predicate fails, or no payload is asked for, the rest is
neither inflated nor decoded. A gzip member carries its length in the "sl" field of its header, so the reader can jump
over it; archives without that field, and uncompressed ones, are read too.

Writing: every task writes files of its own and names them in its commit message; only files that the commit lists in a
manifest are read, so a task that is lost and run again leaves no double records. Files roll over at ``FILE_BYTES``.

Options: path (a folder or file of any file system that pyarrow can open), payload (false: leave it out),
verify (true: check payload digests), partition_bytes.

Defined results: a null payload is empty, a null url is left out; line breaks in header values are percent-encoded;
archives without records, and folders without archives, give no rows; records with broken headers raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage)

from lurewatch.llm.common import scratch, stored

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, content_length long, "
          "http_length long, payload binary")
WRITTEN = ("record_id", "record_type", "target_uri", "refers_to", "sha1", "payload_bytes", "payload")
FILE_BYTES, PARTITION_BYTES, HEAD_BYTES, NEAR_BYTES = 128 << 20, 64 << 20, 4096, 1 << 20
BATCH_RECORDS, BATCH_BYTES = 256, 16 << 20
DATE = "1970-01-01T00:00:00Z"
# Gzip header with an extra field "sl" of two 32-bit lengths, compressed member and inflated record.
_GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
_TRAILER_BYTES, _LENGTHS = 8, struct.Struct("<II")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member that knows its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = len(_GZIP_HEAD) + _LENGTHS.size + len(body) + _TRAILER_BYTES
    known = total < 1 << 32 and len(record) < 1 << 32
    lengths = _LENGTHS.pack(total, len(record)) if known else _LENGTHS.pack(0, 0)
    return _GZIP_HEAD + lengths + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _line(name: str, value) -> str:
    return f"{name}: {str(value).replace('\r', '%0D').replace('\n', '%0A')}\r\n"


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, digest: str, length: int, payload: bytes) -> bytes:
    """A response with its payload, or a revisit with the same HTTP headers and none."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = "WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", record_id) + _line("WARC-Date", DATE)
    head += _line("WARC-Target-URI", uri) if uri is not None else ""
    head += _line("WARC-Payload-Digest", "sha1:" + digest) + "Content-Type: application/http; msgtype=response\r\n"
    if refers_to is not None:
        head += "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" + _line("WARC-Refers-To", refers_to)
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in zip(*(batch.column(name).to_pylist() for name in WRITTEN)):
                record_id, kind, uri, refers_to, sha1, length, payload = row
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                size += out.write(member(record(record_id, kind, uri, refers_to, digest, length, payload or b"")))
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        old = _manifests(store, root)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([name for m in messages if m for name in m.files]).encode())
        for path in old if self.overwrite else []:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for name in (name for m in messages if m for name in m.files):
            store.delete_file(f"{root}/{name}")


def _listed(store: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    return store.get_file_info(fs.FileSelector(root, allow_not_found=True))


def _manifests(store: fs.FileSystem, root: str) -> list[str]:
    return [f.path for f in _listed(store, root) if f.base_name.startswith("_manifest-")]


def archives(path: str) -> list[tuple[str, int]]:
    """Path and size of the archives of a folder: those that a manifest lists, or all if there is no manifest."""
    store, root = opened(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return [(root, store.get_file_info(root).size)]
    found, named = {f.base_name: f for f in _listed(store, root)}, _manifests(store, root)
    if named:
        names = [name for one in named for name in json.loads(store.open_input_stream(one).read())]
    else:
        names = [name for name in found if name.endswith((".warc", ".warc.gz"))]
    return sorted((found[name].path, found[name].size) for name in names)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class Headers(dict):
    """Header names in lower case; the columns that stand for them."""

    def column(self, name: str):
        if name == "content_length":
            return int(self["content-length"])
        if name == "payload_digest":
            return (self.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        return self.get({"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}[name])


HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "content_length")


def parsed(head: bytes) -> Headers:
    """The headers before the first empty line."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return Headers((name.strip().lower(), value.strip()) for name, _, value in (line.partition(":") for line in lines[1:] if line))


_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda x, v: v in x,
}


def taken(rule: Filter) -> bool:
    """Whether the reader can decide a predicate from a record's headers alone."""
    if isinstance(rule, Not):
        return not isinstance(rule.child, Not) and taken(rule.child)
    if not isinstance(rule, (*_TESTS, EqualNullSafe, IsNull, IsNotNull)) or rule.attribute[0] not in HEADER_COLUMNS or len(rule.attribute) > 1:
        return False
    return not isinstance(rule, In) or None not in rule.value


def holds(rule: Filter, headers: Headers) -> bool | None:
    """As in SQL: null where the header is missing, but for the null tests."""
    if isinstance(rule, Not):
        inner = holds(rule.child, headers)
        return None if inner is None else not inner
    value = headers.column(rule.attribute[0])
    if isinstance(rule, IsNull):
        return value is None
    if isinstance(rule, IsNotNull):
        return value is not None
    if isinstance(rule, EqualNullSafe):
        return value == rule.value
    return None if value is None else _TESTS[type(rule)](value, rule.value)


def _inflated(file, start: int, size: int | None) -> tuple[bytes, Callable[[], bytes], Callable[[], int]]:
    """A gzip member: its first bytes, its whole record, and where it ends; both are worked out only when called."""
    near = file.read_at(min(size or NEAR_BYTES, NEAR_BYTES), start)
    first = zlib.decompressobj(31)
    head = first.decompress(near, HEAD_BYTES)
    whole: list = []

    def full() -> bytes:
        if not whole:
            out, more, at = [head, first.decompress(first.unconsumed_tail)], first, start + len(near)
            while not more.eof:
                data = file.read_at(NEAR_BYTES, at)
                if not data:
                    raise ValueError("a gzip member is cut off")
                at += len(data)
                out.append(more.decompress(data))
            whole.extend([b"".join(out), at - len(more.unused_data)])
        return whole[0]

    def end() -> int:
        if size:
            return start + size
        full()
        return whole[1]

    return head, full, end


def _plain(file, start: int) -> tuple[bytes, Callable[[], bytes], Callable[[], int]]:
    head = file.read_at(HEAD_BYTES, start)
    while b"\r\n\r\n" not in head and (more := file.read_at(NEAR_BYTES, start + len(head))):
        head += more
    stop = head.index(b"\r\n\r\n") + 4
    length = int(parsed(head[:stop])["content-length"])
    return head, lambda: head[:stop] + file.read_at(length, start + stop), lambda: start + stop + length + 4


def records(path: str, store: fs.FileSystem, wanted: Callable[[Headers], bool]) -> Iterator[tuple[Headers, Callable[[], bytes]]]:
    """Headers of the wanted records and a function that gives the block."""
    with store.open_input_file(path) as file:
        at, total = 0, file.size()
        while at < total:
            lead = file.read_at(len(_GZIP_HEAD) + _LENGTHS.size, at)
            if lead[:2] == b"\x1f\x8b":
                size = _LENGTHS.unpack(lead[len(_GZIP_HEAD) :])[0] if lead.startswith(_GZIP_HEAD) else 0
                head, full, end = _inflated(file, at, size or None)
            else:
                head, full, end = _plain(file, at)
            stop = head.find(b"\r\n\r\n")
            if stop < 0:
                head = full()
                stop = head.index(b"\r\n\r\n")
            headers = parsed(head[:stop])
            if wanted(headers):
                yield headers, lambda full=full, stop=stop, n=int(headers["content-length"]): full()[stop + 4 : stop + 4 + n]
            at = end()


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.rules: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for rule in filters:
            if taken(rule):
                self.rules.append(rule)
            else:
                yield rule

    def partitions(self) -> list[Files]:
        packed, size = [], 0
        for path, own in archives(self.path):
            if not packed or size + own > self.partition_bytes:
                packed.append([])
                size = 0
            packed[-1].append(path)
            size += own
        return [Files(paths) for paths in packed] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n.endswith("length") else pa.string()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
        rows, size = [], 0
        for path in partition.paths:
            for headers, block in records(path, store, lambda h: all(holds(r, h) for r in self.rules)):
                payload = length = None
                if self.payload:
                    http, _, payload = block().partition(b"\r\n\r\n")
                    length = next((int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
                    if headers.column("record_type") != "response":
                        payload = None
                    elif self.verify and base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers.column("payload_digest"):
                        raise ValueError(f"the payload of {headers.column('record_id')} does not have its digest")
                rows.append([*(headers.column(c) for c in HEADER_COLUMNS), length, payload])
                size += len(payload or b"")
                if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """The rows that the writer takes: of equal payloads of at least ``least_bytes`` bytes the one with the smallest key is
    the response, the others revisit it. Only digests that occur twice meet the pages again."""
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("target_uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("body"))
    own = own.withColumn("sha1", F.sha1("body")).withColumn("payload_bytes", F.length("body").cast("long"))
    again = stored(
        own.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("sha1", "first"), "revisits")
    joined = own.join(again, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        name("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, name("first")).alias("refers_to"), "sha1", "payload_bytes", F.when(~revisit, F.col("body")).alias("payload"))


def digest(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    register(spark)
    path = scratch(spark, "warc")
    with_revisits(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").option("verify", "true").load(path)
    kind = pages.schema["page_id"].dataType
    key = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS {kind.simpleString()})")
    return read.select(
        key("record_id").alias("page_id"), F.coalesce(F.length("payload").cast("long"), F.col("http_length")).alias("payload_bytes"),
        "payload_digest", "record_type", key("refers_to").alias("refers_to"))

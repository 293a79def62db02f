"""WARC archives as a PySpark Python data source.

Reading plans partitions of whole files by size. In each file record headers are parsed first; predicates on the record type and on headers
that Spark pushes down are answered there, and of records that fail them, or whose payload wasn't asked for (option `columns`), the body is skipped: by
Content-Length in plain files, by the member length that our writer puts into each gzip header (subfield `sl`) in compressed ones, and by
inflating without keeping in others, whose members may hold any number of records or a part of one. Writing gives one gzip member a record, in files of
bounded size. They count once the job has committed: its last step writes one small file that names them, and readers leave out files of ours that none names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from palimpsest.llm.common import bounded_batches, set_default, shared_dir, stage, unstage

#: Bytes of a partition when reading, of a file when writing, of payload in a batch.
PARTITION_BYTES, FILE_BYTES, BATCH_BYTES = 32 << 20, 64 << 20, 4 << 20
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100

#: Columns and the header fields that they come from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "warc_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = "record_id string, warc_type string, target_uri string, date string, content_type string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, file string, offset long, payload binary"
_COLUMNS = dict(c.rsplit(" ", 1) for c in SCHEMA.replace("map<string,string>", "map<string;string>").split(", "))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
#: Files of our writer count only if a file of this beginning and their job's number names them.
_OURS, _COMMITTED = re.compile(r"part-([0-9a-f]{32})-[0-9a-f]{32}\.warc\.gz"), "_committed-"


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


def record(fields: dict[str, str | None], payload: bytes) -> bytes:
    """One WARC record. Control characters in header values are percent-encoded."""
    revisit = fields.get("WARC-Type") == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = {"Content-Type": "application/http; msgtype=response"} | ({"WARC-Profile": PROFILE} if revisit else {}) | {k: v for k, v in fields.items() if v is not None}
    lines = [f"{k}: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in named.items()]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    return head + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member whose header holds its own length and that of the data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return struct.pack("<4BIBBH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Fields(dict):
    """Header values by lower-cased name; `named` has the names as they stand."""

    def __init__(self) -> None:
        super().__init__()
        self.named: dict[str, str] = {}

    @property
    def length(self) -> int:
        value = self.get("content-length", "")
        if not value.isdecimal():
            raise ValueError(f"a record without a Content-Length: {self.get('warc-record-id')}")
        return int(value)


@dataclass
class _Head:
    offset: int
    fields: Fields
    body: Callable[[bool], bytes]


def _fields(head: bytes) -> Fields:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out, last = Fields(), None
    for line in lines[1:]:
        line = line.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        if line[:1] in (" ", "\t") and last:  # a folded line goes on
            out.named[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip()
            out.named[last] = value.strip()
    out.update({k.lower(): v for k, v in out.named.items()})
    return out


def _plain(stream) -> Iterator[_Head]:
    """Records of an uncompressed stream. What has a method `skip` is skipped by it, else by seeking."""
    at, held = 0, b""

    def more(n: int = 1 << 16) -> bool:
        nonlocal held
        got = stream.read(n)
        held += got
        return bool(got)

    while True:
        while held[:2] == b"\r\n" or len(held) < 2 and more():
            if held[:2] == b"\r\n":
                held, at = held[2:], at + 2
        if not held.strip():
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record header doesn't end")
        fields = _fields(held[:end])
        start, held = at, held[end + 4 :]
        length = fields.length
        taken = False

        def body(wanted: bool, length: int = length) -> bytes:
            nonlocal held, taken
            taken = True
            if len(held) >= length:
                out, held = held[:length], held[length:]
                return out
            if not wanted:
                if hasattr(stream, "skip"):
                    stream.skip(length - len(held))
                else:
                    stream.seek(stream.tell() + length - len(held))
                held = b""
                return b""
            parts, missing = [held], length - len(held)
            while missing and (got := stream.read(missing)):
                parts.append(got)
                missing -= len(got)
            held = b""
            if missing:
                raise ValueError("a record is cut off")
            return b"".join(parts)

        yield _Head(start, fields, body)
        if not taken:
            body(False)
        at = start + end + 4 + length


class _Inflated:
    """The gzip members of a file from some place on as one stream of what they hold."""

    def __init__(self, stream, at: int):
        stream.seek(at)
        self.stream, self.unpacker, self.held, self.size = stream, None, b"", 0
        self.at, self.starts, self.members = at, [], []  # of each member, where its content and where itself starts

    def _some(self) -> bytes:
        """A next piece of content; empty at the end."""
        while True:
            packed = self.held or self.stream.read(1 << 14)
            self.held = b""
            if self.unpacker is None:
                packed = packed.lstrip(b"\0") if self.members else packed  # members may be filled up with zeros
                if not packed:
                    return b""
                self.unpacker = zlib.decompressobj(31)
                self.starts.append(self.size)
                self.members.append(self.stream.tell() - len(packed))
            elif not packed:
                raise ValueError("a gzip member is cut off")
            out = self.unpacker.decompress(packed, 1 << 18)
            if self.unpacker.eof:
                self.held, self.unpacker = self.unpacker.unused_data, None
            else:
                self.held = self.unpacker.unconsumed_tail
            self.size += len(out)
            if out:
                return out

    def read(self, n: int) -> bytes:
        """Up to about n bytes, what comes at once; what is too much is kept."""
        out = self.__dict__.pop("rest", b"") or self._some()
        if len(out) > n:
            out, self.rest = out[:n], out[n:]
        return out

    def skip(self, n: int) -> None:
        while n and (got := self.read(n)):
            n -= len(got)

    def member(self, place: int) -> int:
        """Where the member starts that holds a place of the content."""
        return self.members[max(0, bisect_right(self.starts, place) - 1)]


def _packed(stream, size: int) -> Iterator[_Head]:
    """Records of a file of gzip members: of ours, one each, a header is inflated, and more only if it's asked for; others are inflated from end to end."""
    at = 0
    while at < size:
        stream.seek(at)
        held = stream.read(1 << 13)
        length = whole = None
        if held[:2] == b"\x1f\x8b" and held[3] & 4 and held[12:14] == b"sl":
            length, whole = struct.unpack("<II", held[16:24])
        unpacker = zlib.decompressobj(31)
        data = unpacker.decompress(held) if length else b""
        while length and (end := data.find(b"\r\n\r\n")) < 0 and not unpacker.eof:
            got = stream.read(1 << 13)
            if not got:
                raise ValueError("a record header doesn't end")
            data += unpacker.decompress(got)
        fields = _fields(data[:end]) if length else None
        if not length or (end + 4 + fields.length + 4) & 0xFFFFFFFF != whole:
            inflated = _Inflated(stream, at)
            for head in _plain(inflated):
                head.offset = inflated.member(head.offset)
                yield head
            return
        parts, start, count = [data[end + 4 :]], at, fields.length

        def body(wanted: bool) -> bytes:
            if not wanted:
                return b""
            while not unpacker.eof:
                got = stream.read(1 << 16)
                if not got:
                    raise ValueError("a record is cut off")
                parts.append(unpacker.decompress(got))
            return b"".join(parts)[:count]

        yield _Head(start, fields, body)
        at = start + length


def content(fields: Fields, block: bytes) -> bytes:
    """A record's payload: of an HTTP message what follows its headers, which may lack (then it is the block) or end with the block (then it is empty)."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return block
    ends = [(at, at + len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := block.find(gap)) >= 0]
    if not block[:5].upper() == b"HTTP/" and not ends:
        return block
    return block[min(ends)[1] :] if ends else b""


def records(path: str, size: int | None = None) -> Iterator[_Head]:
    where, name = place(path)
    size = where.get_file_info(name).size if size is None else size
    with where.open_input_file(name) as stream:
        magic = stream.read(2)
        stream.seek(0)
        yield from _packed(stream, size) if magic == b"\x1f\x8b" else _plain(stream)


_TESTS: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    In: lambda x, v: x is not None and x in v,
    IsNull: lambda x, v: x is None,
    IsNotNull: lambda x, v: x is not None,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
}


def _value(fields: Fields, column: str):
    raw = fields.get(HEADERS[column].lower())
    if column != "payload_length":
        return raw
    return int(raw) if raw and raw.isdecimal() else None


def _test(f: Filter) -> tuple[str, Callable[[object], bool]] | None:
    """(column, predicate) of a filter that headers answer, else None."""
    negative = isinstance(f, Not)
    inner = f.child if negative else f
    if type(inner) not in _TESTS or len(inner.attribute) != 1 or inner.attribute[0] not in HEADERS:
        return None
    test, value = _TESTS[type(inner)], getattr(inner, "value", None)
    if negative:  # null stays null, and a null condition drops the row
        nulls = isinstance(inner, (EqualNullSafe, IsNull, IsNotNull))
        return inner.attribute[0], lambda x: (nulls or x is not None) and not test(x, value)
    return inner.attribute[0], lambda x: test(x, value)


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.names, self.partition_bytes = path, schema.fieldNames(), partition_bytes
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, name = place(self.path)
        info = where.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name, recursive=True))
        scheme = re.match(r"^[a-z0-9+]+://[^/]*", self.path)
        prefix = scheme[0] if scheme and scheme[0] != "file://" and not info.path.startswith(scheme[0]) else ""
        out, held, size = [], [], 0
        hidden = lambda p: any(x[:1] in "._" for x in p[len(name) :].split("/") if x)
        files = [f for f in found if f.type == fs.FileType.File and f.size]
        committed: set[str] = set()
        for f in files:
            if f.base_name.startswith(_COMMITTED):
                with where.open_input_file(f.path) as stream:
                    committed.update(stream.read().decode().split())
        mine = lambda f: info.type == fs.FileType.File or not _OURS.fullmatch(f.base_name) or f.base_name in committed
        for f in sorted((f for f in files if not hidden(f.path) and mine(f)), key=lambda f: f.path):
            if held and size + f.size > self.partition_bytes:
                out.append(_Files(held))
                held, size = [], 0
            held.append((prefix + f.path, f.size))
            size += f.size
        return [*out, _Files(held)] if held else out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.filters]
        wanted = "payload" in self.names
        kinds = {"payload_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        rows: list[list] = [[] for _ in self.names]
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.string())) for n, x in zip(self.names, rows, strict=True)], self.names)

        for path, length in partition.files:
            for head in records(path, length):
                if not all(test(_value(head.fields, column)) for column, test in tests):
                    continue
                for n, x in zip(self.names, rows, strict=True):
                    if n == "payload":
                        body = content(head.fields, head.body(True)) if head.fields.get("warc-type") != "revisit" else None
                        size += len(body or b"")
                        x.append(body)
                    else:
                        x.append({"headers": list(head.fields.named.items()), "file": path, "offset": head.offset}[n] if n not in HEADERS else _value(head.fields, n))
                size += 500
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [[] for _ in self.names], 0
        if rows and (rows[0] or not wanted and not partition.files):
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of any of the columns of HEADERS, headers map<string,string> and payload -> files that appear when the job commits."""

    def __init__(self, path: str, file_bytes: int, overwrite: bool = False):
        self.path, self.file_bytes, self.overwrite, self.job = path, file_bytes, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, name = place(self.path)
        where.create_dir(name, recursive=True)
        files, stream, size = [], None, 0
        for batch in iterator:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, row, strict=True))
                fields = {HEADERS[k]: None if v is None else str(v) for k, v in row.items() if k in HEADERS} | dict(row.get("headers") or ())
                data = member(record(fields, row.get("payload") or b""))
                if stream is None or size + len(data) > self.file_bytes:
                    if stream is not None:
                        stream.close()
                    files.append(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                    stream, size = where.open_output_stream(f"{name}/{files[-1]}", compression=None), 0
                stream.write(data)
                size += len(data)
        if stream is not None:
            stream.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        """One file makes all of a job's visible; files of failed attempts are named by none. Overwriting deletes what was there after that."""
        where, name = place(self.path)
        where.create_dir(name, recursive=True)
        files = [f for m in messages if m for f in m.files]
        before = [f for f in where.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and self.job not in f.base_name] if self.overwrite else []
        with where.open_output_stream(f"{name}/{_COMMITTED}{self.job}", compression=None) as stream:
            stream.write("\n".join(files).encode())
        self._delete(where, [f.path for f in sorted(before, key=lambda f: not f.base_name.startswith(_COMMITTED))])

    def abort(self, messages: list[_Written | None]) -> None:
        where, name = place(self.path)
        self._delete(where, [f.path for f in where.get_file_info(fs.FileSelector(name, allow_not_found=True)) if self.job in f.base_name])

    @staticmethod
    def _delete(where: fs.FileSystem, paths: list[str]) -> None:
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(where.delete_file, paths))


class WarcSource(DataSource):
    """format("warc"). Options: path, partitionBytes, fileBytes, columns (names of those to read, with commas between; Spark doesn't tell a Python source
    which columns a query uses, and payloads that aren't among them aren't decoded), payload ("false": all columns but the payload)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        names = [n.strip() for n in self.options["columns"].split(",")] if self.options.get("columns") else list(_COLUMNS)
        if unknown := [n for n in names if n not in _COLUMNS]:
            raise ValueError(f"no such columns: {unknown}; there are {list(_COLUMNS)}")
        names = [n for n in names if n != "payload" or self.options.get("payload", "true") != "false"]
        return ", ".join(f"{n} {_COLUMNS[n]}" for n in names).replace(";", ",")

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known, with filters pushed down."""
    set_default(spark, "spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:palimpsest:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages -> rows for format("warc"). Of equal payloads of at least 100 bytes the one with the smallest page_id is the response.

    A null html is an empty payload. Rows that repeat the smallest id are responses too; rows without an id revisit it; if none of the
    equal ones has an id, all are responses.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("target_uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    same = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = stage(same.where("n > 1 and first is not null").select(F.col("digest").alias("__digest"), "first"), "equal")
    rows = rows.join(same, (F.col("digest") == F.col("__digest")) & (F.col("size") >= LEAST_REVISIT), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    out = rows.select(
        _record_id(F.col("page_id")).alias("record_id"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("warc_type"),
        "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("size").alias("payload_length"),
        F.when(again, _record_id(F.col("first"))).alias("refers_to"),
        F.when(~again, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )
    out._palimpsest_path = same._palimpsest_path  # to be unstaged with the rows
    return out


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row of pages and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    For responses size and digest are those of the payload as read; for revisits, which have no payload, those of their headers.
    Repeated rows each have a record; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    register(spark)
    path = f"{shared_dir(spark)}/palimpsest/warc-{uuid.uuid4().hex}"
    rows = page_records(pages, page_id, url, html)
    rows.write.format("warc").mode("append").save(path)
    unstage(rows)
    read = spark.read.format("warc").option("columns", "record_id,warc_type,payload").load(path).where("warc_type = 'response'")
    heads = spark.read.format("warc").option("columns", "record_id,warc_type,payload_length,payload_digest,refers_to").load(path).where("warc_type = 'revisit'")
    number = lambda c: F.when(F.length(c) > 0, F.regexp_extract(c, r"page:(-?\d+)>", 1)).try_cast("long")
    shown = lambda size, digest, refers_to: (number("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), refers_to.alias("refers_to"))
    responses = read.select(*shown(F.octet_length("payload"), F.sha2("payload", 256), F.lit(None).cast("long")))
    revisits = heads.select(*shown(F.col("payload_length"), F.substring_index("payload_digest", ":", -1), number("refers_to")))
    out = stage(responses.unionByName(revisits), "pages")
    where, name = place(path)
    if where.get_file_info(name).type == fs.FileType.Directory:
        where.delete_dir(name)
    return out


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > f THEN f END AS refers_to
FROM q
"""

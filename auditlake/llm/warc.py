"""WARC archives as a PySpark data source.

Reading plans one partition per group of files, parses the headers of a record
first and asks the pushed predicates on record type and header fields before
the payload is touched; payloads nobody asked for are skipped, not decoded.
Writing streams Arrow batches into one archive per task (more, when a file grows
over its limit) in a staging folder; the driver moves the files of successful
tasks into place, so lost and repeated tasks leave nothing behind.

The folder must be one that pyarrow's file systems open (local or shared mounts,
hdfs, s3, gs, abfs), since Python workers read and write the files themselves.
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
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
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

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, "
    "refers_to string, content_length long, payload_length long, headers map<string,string>, payload binary"
)
#: Columns that header predicates may be pushed on, with the header they come from.
FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "refers_to": "warc-refers-to", "content_length": "content-length",
}
_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    In: lambda x, v: x is not None and x in v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def _pushable(f) -> bool:
    if isinstance(f, Not):
        return _pushable(f.child) and not isinstance(f.child, (IsNull, IsNotNull))
    known = type(f) in _TESTS or isinstance(f, (IsNull, IsNotNull))
    return known and len(f.attribute) == 1 and f.attribute[0] in FIELDS


def _holds(f, row: dict) -> bool:
    if isinstance(f, Not):
        return row[f.child.attribute[0]] is not None and not _holds(f.child, row)
    value = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (value is None) == isinstance(f, IsNull)
    return _TESTS[type(f)](value, f.value)


def _fields(stream) -> dict[str, str] | None:
    """Header lines up to the blank one, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith((b"WARC/", b"HTTP/")):
        raise ValueError(f"not the start of a record: {line[:60]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _skip(stream, n: int) -> None:
    while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
        n -= got


def read_records(stream, filters: tuple, wanted: frozenset[str] | None) -> Iterator[dict]:
    """Records of an open archive that pass ``filters``; payloads of ``wanted`` types only (None: of all)."""
    while (head := _fields(stream)) is not None:
        size = int(head.get("content-length", 0))
        row = {c: head.get(h) for c, h in FIELDS.items()} | {"content_length": size}
        if not all(_holds(f, row) for f in filters):
            _skip(stream, size)
            continue
        digest = head.get("warc-payload-digest", "")
        algorithm, _, text = digest.partition(":")
        if algorithm.lower() == "sha1" and len(text) == 32:
            digest = base64.b32decode(text).hex()
        row |= {"payload_digest": digest or None, "headers": list(head.items()), "payload": None, "payload_length": size}
        if (head.get("content-type") or "").startswith("application/http"):
            before = _Counted(stream, size)
            http = _fields(before) or {}
            size -= before.n
            # A revisit holds the answer's headers, but not its body.
            row["payload_length"] = int(http.get("content-length", size)) if row["record_type"] == "revisit" else size
        if row["record_type"] != "revisit" and (wanted is None or row["record_type"] in wanted):
            row["payload"] = stream.read(size)
            if len(row["payload"]) < size:
                raise ValueError("the archive ends inside a record")
        else:
            _skip(stream, size)
        yield row


class _Counted:
    """readline() that counts its bytes and stops at the end of the block."""

    def __init__(self, stream, left: int) -> None:
        self.stream, self.n, self.left = stream, 0, left

    def readline(self) -> bytes:
        line = self.stream.readline(self.left - self.n) if self.left > self.n else b""
        self.n += len(line)
        return line


@dataclass
class FileGroup(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 64 << 20))
        types = options.get("payloads")
        self.wanted = None if types is None else frozenset(t for t in types.split(",") if t)
        self.filters: tuple = ()

    def pushFilters(self, filters):
        self.filters = tuple(f for f in filters if _pushable(f))
        return [f for f in filters if not _pushable(f)]

    def partitions(self) -> list[FileGroup]:
        """Files in order of name, gathered up to the split size. A larger file stands alone."""
        system, root = _open_fs(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        inside = lambda f: f.path[len(root) :].strip("/")
        names = sorted(
            (f.path, f.size) for f in files
            if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not any(p.startswith(("_", ".")) for p in inside(f).split("/"))
        )
        groups: list[list[str]] = []
        room = 0
        for path, size in names:
            if not groups or size > room:
                groups.append([])
                room = self.split
            groups[-1].append(path)
            room -= size
        return [FileGroup(tuple(g)) for g in groups or [[]]]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(self.path)
        schema = pa.schema([
            *((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "content_type", "payload_digest", "refers_to")),
            ("content_length", pa.int64()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
        ])
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20)
                rows: list[dict] = []
                held = 0
                for row in read_records(stream, self.filters, self.wanted):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("filebytes", 256 << 20))
        self.packed = options.get("compression", "gzip") == "gzip"
        self.level = int(options.get("level", 3))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open_fs(self.path)
        system.create_dir(self._staging(root), recursive=True)
        paths: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.limit:
                    if out is not None:
                        out.close()
                    paths.append(f"{self._staging(root)}/part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out, size = system.open_output_stream(paths[-1], compression=None), 0
                data = b"".join(record(row, self.date))
                if self.packed:  # each record a gzip member of its own, as readers of archives expect
                    zipper = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    data = zipper.compress(data) + zipper.flush()
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(tuple(paths))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open_fs(self.path)
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if old.is_file and old.path.endswith((".warc", ".warc.gz")):
                    system.delete_file(old.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for path in message.paths if message else ():
                system.move(path, f"{root}/{path.rsplit('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = _open_fs(self.path)
        if system.get_file_info(self._staging(root)).type == pafs.FileType.Directory:
            system.delete_dir(self._staging(root))


def record(row: dict, date: str) -> Iterator[bytes]:
    """The bytes of one record. Payloads go as HTTP answers; a revisit holds the answer's headers only."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    length = row.get("payload_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    body = b"" if revisit else payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", row.get("target_uri"))]
    if row.get("payload_digest"):
        fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
    if revisit:
        fields += [("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    yield b"WARC/1.1\r\n"
    for name, value in fields:
        if value is not None:
            yield f"{name}: {' '.join(value.splitlines())}\r\n".encode()
    yield b"\r\n"
    yield http
    yield body
    yield b"\r\n\r\n"


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options path, payloads (types to decode), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, payloads: str | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Records below ``path`` (``SCHEMA``), .warc and .warc.gz, or one such file.

    ``payloads`` names the record types whose payload is decoded, by commas (None:
    all; "": none). Filters on the header columns are pushed into the reader. A
    folder without archives gives no rows. ``payload`` is null where not decoded.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source cannot be planned without
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("splitBytes", split_bytes)
    if payloads is not None:
        reader = reader.option("payloads", payloads)
    return reader.load(path)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", file_bytes: int = 256 << 20, date: str | None = None) -> str:
    """Append ``records`` (record_type, record_id, and any of target_uri, payload_digest, refers_to, payload_length, payload)."""
    records.sparkSession.dataSource.register(WarcSource)
    writer = records.write.format("warc").mode("append").option("compression", compression).option("fileBytes", file_bytes)
    (writer.option("date", date) if date else writer).save(path)
    return path


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """One record per page: a response, or a revisit of the page with the largest id and the same payload.

    Payloads under ``least`` bytes are always responses. A null payload is empty, a
    null url leaves the field out. Rows that repeat the largest id are all
    responses; if all ids of a group are null so are all of these; other rows with
    a null id revisit. An empty table gives none; other columns are not looked at.
    """
    rows = pages.select(
        F.col(page_id).cast("string").alias("id"),
        F.col(page_id).alias("n"),
        F.col(url).alias("target_uri"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("payload_digest", F.sha1("payload"))
    rows = rows.withColumn("payload_length", F.octet_length("payload").cast("long"))
    # Copies combine to one row per task and digest before the shuffle; only groups of two or more go on.
    best = (
        rows.filter(F.col("payload_length") >= least)
        .groupBy("payload_digest").agg(F.max("n").alias("best"), F.count("*").alias("copies"))
        .filter("copies > 1 AND best IS NOT NULL").select(F.col("payload_digest").alias("same"), "best")
    )
    rows = rows.join(best, (F.col("payload_digest") == F.col("same")) & (F.col("payload_length") >= least), "left")
    revisit = F.col("best").isNotNull() & ~F.col("n").eqNullSafe(F.col("best"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c, F.lit("")), F.lit(">"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name(F.col("id")).alias("record_id"),
        "target_uri",
        "payload_digest",
        F.when(revisit, name(F.col("best").cast("string"))).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )

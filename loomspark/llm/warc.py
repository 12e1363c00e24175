"""WARC archives as a Spark data source, and the archive of a table of pages.

``read_warc`` plans whole files into partitions. A task parses a record's headers first; where
predicates on type and headers turn a record down, or no column asks for payloads, its block is
passed over: by a seek in plain files and in gzip members that carry their length (extra field ``sl``),
by inflating without keeping in other members. ``write_warc`` writes one gzip member a record and lists
the files of finished tasks in a versioned manifest, so what a lost task left behind is never read.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, give_back, materialize, new_path

#: Columns of a record and the header that each comes from; payload_length and payload come from the block.
HEADERS = {
    "record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest",
}
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), "content_length long, payload_length long, headers map<string,string>, payload binary, file string, offset long"])
#: Fixed value: the profile of a record whose payload is that of an earlier one.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of files in a partition, of a file, and of payloads in a batch.
SPLIT_BYTES, FILE_BYTES, BATCH_BYTES = 128 << 20, 256 << 20, 4 << 20
MANIFESTS = "_manifests"


# Records


class Plain:
    """The bytes of one record in a file that is not compressed."""

    def __init__(self, file: io.BufferedReader):
        self.file = file

    def line(self) -> bytes:
        return self.file.readline()

    def take(self, n: int) -> bytes:
        return self.file.read(n)

    def leave(self, unread: int) -> None:
        """Pass over the rest of the block; blank lines before the next record are passed by its reader."""
        self.file.seek(unread, io.SEEK_CUR)


class Member:
    """The bytes of one gzip member, inflated as far as they are asked for."""

    def __init__(self, file: io.BufferedReader):
        self.file, self.start, self.kept = file, file.tell(), b""
        head = file.read(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {self.start}")
        self.length = None  # of the whole member, where it says so
        flags = head[3]
        if flags & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        for flag in (8, 16):  # file name and comment
            while flags & flag and file.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            file.read(2)
        self.inflate = zlib.decompressobj(-15)

    def _more(self, most: int = 1 << 14) -> bool:
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail or self.file.read(1 << 14)
        if not raw:
            raise ValueError(f"the gzip member at {self.start} is cut off")
        self.kept += self.inflate.decompress(raw, most)
        return True

    def line(self) -> bytes:
        while b"\n" not in self.kept and self._more():
            pass
        cut = self.kept.find(b"\n") + 1 or len(self.kept)
        out, self.kept = self.kept[:cut], self.kept[cut:]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.kept[:n]], min(n, len(self.kept))
        self.kept = self.kept[n:]
        while have < n and self._more(max(1 << 14, min(n - have, 1 << 22))):
            parts.append(self.kept[: n - have])
            self.kept = self.kept[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def leave(self, unread: int) -> None:
        if self.length is not None:
            self.file.seek(self.start + self.length)
            return
        while not self.inflate.eof:
            self.kept = b""
            self._more(1 << 20)
        self.file.seek(8 - len(self.inflate.unused_data), io.SEEK_CUR)  # the trailer


def parse_head(record, first: bytes | None = None) -> tuple[str, dict[str, str]]:
    """The first line and the fields up to the blank line; folded lines are joined, of repeated fields the first counts.

    The head of a record must end in a blank line; that of an HTTP message may end with its block.
    """
    status = (first if first is not None else record.line()).decode("utf-8", "replace").strip()
    fields: dict[str, str] = {}
    last = None
    while (line := record.line()) not in (b"\r\n", b"\n"):
        if not line:
            if isinstance(record, Counted):
                break
            raise ValueError("the head of a record is cut off")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = next((k for k in fields if k.lower() == name.strip().lower()), None)
        if last is None:
            last = name.strip()
            fields[last] = value.strip()
    return status, fields


class Fields(dict):
    """Header fields by their name in any case."""

    def __init__(self, fields: dict[str, str]):
        super().__init__(fields)
        self.lower = {k.lower(): v for k, v in fields.items()}

    def field(self, name: str) -> str | None:
        return self.lower.get(name.lower())


def records(file: io.BufferedReader, zipped: bool, wanted: Iterable = (), payloads: bool = True, lengths: bool = True) -> Iterator[dict[str, Any]]:
    """The records of a file that meet every one of ``wanted`` (functions of a record's header columns).

    Blocks of other records are not looked at. ``payloads`` and ``lengths`` say whether the block's HTTP head and payload are needed.
    """
    while True:
        if not file.peek(1):
            return
        at = file.tell()
        if zipped:
            record: Plain | Member = Member(file)
            first = record.line()
        else:
            record = Plain(file)
            first = record.line()
            while first in (b"\r\n", b"\n"):
                at = file.tell()
                first = record.line()
            if not first:
                return
        version, fields = parse_head(record, first)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = Fields(fields)
        size = int(fields.field("Content-Length") or 0)
        row: dict[str, Any] = {c: fields.field(h) for c, h in HEADERS.items()} | {"content_length": size, "offset": at}
        left = size
        if all(keep(row) for keep in wanted):
            row |= {"headers": dict(fields), "payload_length": size, "payload": None}
            if payloads or lengths:
                if (row["content_type"] or "").lower().startswith("application/http"):
                    counted = Counted(record, size)
                    _, http = parse_head(counted)
                    left = counted.left
                    stated = Fields(http).field("Content-Length")
                    row["payload_length"] = int(stated) if row["warc_type"] == "revisit" and (stated or "").isdigit() else left
                if payloads and row["warc_type"] != "revisit":
                    row["payload"] = record.take(left)
                    if len(row["payload"]) < left:
                        raise ValueError(f"the record at {at} is cut off")
                    left = 0
            yield row
        record.leave(left)


class Counted:
    """Lines of a block that do not go beyond its end."""

    def __init__(self, record: Plain | Member, size: int):
        self.record, self.left = record, size

    def line(self) -> bytes:
        if self.left <= 0:
            return b""
        out = self.record.line()
        self.left -= len(out)
        return out


def member(head: list[tuple[str, Any]], block: bytes, level: int) -> bytes:
    """One record as a gzip member that says how long it is, where that fits."""
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in head if v is not None), f"Content-Length: {len(block)}"]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    raw = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = raw.compress(plain) + raw.flush()
    length = 10 + 2 + 12 + len(packed) + 8
    tail = struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    if max(length, len(plain)) >= 1 << 32:
        return gzip.compress(plain, level)
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(plain)) + packed + tail


def _clean(value: Any) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


# Files


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def manifests(path: str) -> list[str]:
    fs, root = filesystem(path)
    found = fs.get_file_info(pa.fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json"))


def archive_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of what the last manifest lists, or without manifests of every ``.warc`` and ``.warc.gz`` file below."""
    fs, root = filesystem(path)
    if found := manifests(path):
        with fs.open_input_stream(found[-1]) as f:
            return [(f"{root}/{x['name']}", x["bytes"]) for x in json.loads(f.read())]
    info = fs.get_file_info(root)
    listed = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in listed if f.is_file and f.path.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


TESTS = {
    EqualTo: lambda v, x: v is not None and x is not None and v == x, EqualNullSafe: lambda v, x: v == x, GreaterThan: lambda v, x: v is not None and v > x, GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x, LessThanOrEqual: lambda v, x: v is not None and v <= x, In: lambda v, x: v is not None and v in x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x), StringEndsWith: lambda v, x: v is not None and v.endswith(x), StringContains: lambda v, x: v is not None and x in v,
}


#: Names of the tests for explicit predicates.
TEST_NAMES = {"=": EqualTo, "in": In, "<": LessThan, "<=": LessThanOrEqual, ">": GreaterThan, ">=": GreaterThanOrEqual, "prefix": StringStartsWith, "suffix": StringEndsWith, "contains": StringContains, "null": IsNull, "not null": IsNotNull}


class Wanted:
    """A pushed predicate on a header column."""

    def __init__(self, column: str, kind: type, value: Any = None):
        self.column, self.kind, self.value = column, kind, value

    def __call__(self, row: dict[str, Any]) -> bool:
        v = row[self.column]
        if self.kind in (IsNull, IsNotNull):
            return (v is None) == (self.kind is IsNull)
        return TESTS[self.kind](v, self.value)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.split = int(options.get("splitbytes") or SPLIT_BYTES)
        self.wanted = [Wanted(column, TEST_NAMES[test], value) for column, test, value in json.loads(options.get("where") or "[]")]

    def partitions(self) -> list[Files]:
        """Whole files in order, about ``splitBytes`` of them in a partition; a larger file stands alone."""
        out: list[list[str]] = []
        room = 0
        for path, size in archive_files(self.path):
            if not out or size > room:
                out.append([])
                room = self.split
            out[-1].append(path)
            room -= size
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names, arrow = self.schema.names, to_arrow_schema(self.schema)
        fs = filesystem(self.path)[0]
        rows: list[dict] = []
        held = 0
        batch = lambda: pa.RecordBatch.from_pydict({c: [list(r[c].items()) if c == "headers" else r[c] for r in rows] for c in names}, schema=arrow)
        try:
            for path in partition.paths if partition else []:
                with fs.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 16) as file:
                    for row in records(file, path.endswith(".gz"), self.wanted, "payload" in names, "payload_length" in names):
                        rows.append(row | {"file": path})
                        held += len(row["payload"] or b"") + 512
                        if held > BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
            if rows:
                yield batch()
        finally:
            give_back()


class PushingReader(WarcReader):
    """Takes predicates on header columns; Spark has others evaluated by itself."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if (column in HEADERS or column == "content_length") and (type(f) in TESTS or type(f) in (IsNull, IsNotNull)):
                self.wanted.append(Wanted(column, type(f), getattr(f, "value", None)))
            else:
                yield f


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most, self.level = int(options.get("filebytes") or FILE_BYTES), int(options.get("level") or 6)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        files: list[dict] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        files.append({"name": name, "bytes": 0, "records": 0})
                        info = b"software: loomspark\r\nformat: WARC File Format 1.1\r\n"
                        self._put(out, files[-1], member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row.get("date")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info, self.level))
                    self._put(out, files[-1], self.record(row))
                    if files[-1]["bytes"] >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
            give_back()
        return Written(files)

    @staticmethod
    def _put(out, file: dict, data: bytes) -> None:
        out.write(data)
        file["bytes"] += len(data)
        file["records"] += 1

    def record(self, row: dict) -> bytes:
        """A response or revisit holds an HTTP head that states the payload's full length; a revisit has no payload."""
        kind, payload = row.get("warc_type") or "resource", row.get("payload") or b""
        over_http = kind in ("response", "revisit")
        length = row.get("payload_length") if row.get("payload_length") is not None else len(payload)
        block = (http_head(length) if over_http else b"") + (b"" if kind == "revisit" else payload)
        head = [
            ("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row.get("target_uri")),
            ("WARC-Payload-Digest", row.get("payload_digest")), ("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", SAME_PAYLOAD if kind == "revisit" else None),
            ("Content-Type", "application/http; msgtype=response" if over_http else row.get("content_type") or "application/octet-stream"),
        ]
        return member(head, block, self.level)

    def commit(self, messages: list[Written | None]) -> None:
        """Publish the files of this write as the next version; with ``overwrite`` the files of earlier versions go afterwards."""
        fs, root = filesystem(self.path)
        before = manifests(self.path)
        old = []
        if before:
            with fs.open_input_stream(before[-1]) as f:
                old = json.loads(f.read())
        new = [x for m in messages if m for x in m.files]
        version = int(before[-1].rsplit("/", 1)[-1].split(".")[0]) + 1 if before else 1
        fs.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        draft = f"{root}/{MANIFESTS}/{uuid.uuid4().hex}.draft"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        fs.move(draft, f"{root}/{MANIFESTS}/{version:012d}.json")
        for path in (f"{root}/{x['name']}" for x in (old if self.overwrite else [])):
            if fs.get_file_info(path).is_file:
                fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for x in (x for m in messages if m for x in m.files):
            if fs.get_file_info(f"{root}/{x['name']}").is_file:
                fs.delete_file(f"{root}/{x['name']}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``. Options: path, where, pushdown, splitBytes, fileBytes, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        options = self._options()
        return (PushingReader if options.get("pushdown") == "true" else WarcReader)(schema, options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(schema, self._options(), overwrite)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, where: Sequence[tuple] = (), pushdown: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of an archive folder or file with ``columns`` (a part of ``SCHEMA``); payloads are decoded if they are among them.

    ``path`` is what pyarrow opens: a local path or a URI of file, hdfs, s3 or gs. ``where`` has predicates on header columns that all records
    must meet, as (column, test, value) with a test of ``TEST_NAMES``; others are passed over in the file.

    ``pushdown`` hands the filters of a query down by themselves. Spark 4.1 keeps what it pushed with the DataFrame: its next query is safe, as
    it gets a predicate that always holds, but one query that uses the same DataFrame twice with unlike filters is not, so it is off by default. It
    needs ``spark.sql.python.filterPushdown.enabled``, which is set then, as plans are made later.
    """
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("splitBytes", split_bytes).option("where", json.dumps([list(w) for w in where]))
    if not pushdown:
        return reader.schema(columns).load(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    asked = StructType.fromDDL(columns)
    schema = asked if "content_length" in asked.names else StructType([*asked.fields, StructField("content_length", LongType())])
    return reader.schema(schema).option("pushdown", "true").load(path).where("content_length >= 0").select(*asked.names)


def write_warc(df: DataFrame, path: str, mode: str = "append", file_bytes: int = FILE_BYTES) -> None:
    """Write records: columns of ``HEADERS`` with payload_length and payload, those that are absent are left out.

    One writer at a time. ``overwrite`` replaces what earlier versions list once the new one is there.
    """
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("warc").mode(mode).option("fileBytes", file_bytes).save(path)


# The archive of pages


def page_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """One record for each row of ``pages`` (page_id, url, html): response, or revisit of the smallest page_id with an equal payload.

    Only digests are grouped. The copies' digests are a table of their own, joined back as a skewed join
    that adaptive execution cuts, so a payload that a third of all pages share meets in no one task.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"_digest": F.unhex(F.sha2("payload", 256)), "payload_length": F.octet_length("payload").cast("long")})
    copies = rows.where(F.col("payload_length") >= least_bytes).groupBy("_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = materialize(copies.where((F.col("n") > 1) & F.col("first").isNotNull()).select("_digest", "first"), "copies")
    again = F.col("first").isNotNull() & (F.col("payload_length") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.join(copies, "_digest", "left").select(
        name(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.when(again, name(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), F.lower(F.hex("_digest"))).alias("payload_digest"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def archived_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 100) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): ``pages`` written as WARC files under ``path`` and read back.

    A response's length and digest are those of the payload that was read, a revisit's those its record states. A
    null html is an empty payload, a null url is left out. Of equal payloads of ``least_bytes`` or more
    the smallest page_id is the response; rows that repeat it are responses too. A null page_id
    revisits the others, and where all ids are null every row is a response. An empty table gives no rows,
    long texts are written whole, extra columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    written = page_records(pages, least_bytes)
    write_warc(written, path)
    columns = "record_id string, warc_type string, refers_to string, payload_digest string, payload_length long, payload binary"
    found = read_warc(spark, path, columns, [("warc_type", "in", ["response", "revisit"])])
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    read = F.col("payload").isNotNull()
    return found.select(
        page("record_id").alias("page_id"), F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(read, F.sha2("payload", 256)).otherwise(F.replace("payload_digest", F.lit("sha256:"), F.lit(""))).alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


def oracle() -> str:
    """DuckDB SQL of ``archived_pages`` over ``pages``."""
    return """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f USING (d)"""

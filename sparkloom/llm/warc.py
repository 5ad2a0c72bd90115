"""WARC archives as a PySpark Python data source.

Writing: every task writes gzip members, one a record, to files of bounded size. Each member's gzip header carries its
compressed length in an `sl` extra field. On commit the driver writes a manifest, so files of failed attempts are never
read. Reading: one partition a file; equality, IN, prefix and null predicates on record type and header columns are
pushed down; of a record only the headers are inflated first, and the payload of a record that is not wanted, or that
the schema leaves out, is skipped by its compressed length without being inflated.

Records that break the format (no end of the WARC head, no length, or cut off by the end of the file) fail the read; with
the option mode DROPMALFORMED they are left out: one of a known length is skipped, and one of an unknown length ends its file.
A page id that is no number reads as null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FORMAT = "sparkloom_warc"
#: column -> WARC header; "http_length" comes from the HTTP head of the block, "payload" from its body.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "page_id": "x-page-id", "refers_to_page": "x-refers-to-page",
}
#: Columns that need the block, not just the headers: the length that the HTTP head states, the payload, and the payload's own
#: length and digest, which are worked out from its bytes.
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, page_id long, refers_to_page long, http_length long, payload binary, payload_length long, payload_sha1 string"
_LONGS = ("page_id", "refers_to_page")
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
_FIRST = 1024
_MANIFEST = "_manifest.json"


def member(block: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field holds its compressed and plain lengths."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(block) + squeeze.flush()
    size = len(_HEAD) + 8 + len(body) + 8
    return _HEAD + struct.pack("<II", size & 0xFFFFFFFF, len(block) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, page_id: int | None, payload: bytes, refers_to: tuple[str, int] | None, digest: str) -> bytes:
    """A WARC/1.1 record with an HTTP response block; a revisit has the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in uri))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to[0]}>", f"X-Refers-To-Page: {refers_to[1]}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:sparkloom:{'' if page_id is None else page_id}:{digest}"


#: Names that Hadoop gives to stores which pyarrow has under another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
_KNOWN = ("file", "s3", "gs", "gcs", "hdfs", "viewfs", "abfs", "abfss")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Spark has it, and the place there. Stores that pyarrow knows are opened with its own client, whose
    settings come from the environment or the URI; any other one through Hadoop's client (libhdfs)."""
    scheme, found, rest = path.partition("://")
    if not found or scheme in _KNOWN:
        return pafs.FileSystem.from_uri(path)
    if scheme in _SCHEMES:
        if scheme.startswith("wasb"):
            rest = rest.replace(".blob.", ".dfs.", 1)
        return pafs.FileSystem.from_uri(f"{_SCHEMES[scheme]}://{rest}")
    authority, _, at = rest.partition("/")
    return pafs.HadoopFileSystem(f"{scheme}://{authority}", 0), f"/{at}"


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows (page_id, url, payload, sha1, response): response is the page_id of the record that holds the payload, null for itself.

    A task keeps one file open and one record in memory.
    """

    def __init__(self, path: str, roll: int) -> None:
        self.path, self.roll = path, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for page_id, url, payload, sha1, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "response")), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                kind = "response" if response is None else "revisit"
                other = None if response is None else (record_id(response, digest), response)
                data = member(record(kind, record_id(page_id, digest), url, page_id, payload, other, digest))
                if out is None or size + len(data) > self.roll:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{_MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{base}/{f}")


@dataclass
class FilePart(ds.InputPartition):
    file: str


def _holds(filters: list[tuple[str, str, object]], row: dict) -> bool:
    for column, kind, value in filters:
        x = row.get(column)
        if kind == "null":
            ok = x is None
        elif x is None:
            ok = False
        elif kind == "eq":
            ok = x == value
        elif kind == "in":
            ok = x in value
        else:
            ok = x.startswith(value)
        if not ok:
            return False
    return True


def _spec(column: str, kind: str, value: object) -> tuple[str, str, str]:
    return column, kind, json.dumps(sorted(value, key=str) if isinstance(value, (list, tuple)) else value)


class WarcReader(ds.DataSourceReader):
    """Takes on the header predicates that its options list, and no others.

    Spark 4.1 keeps what was pushed with the relation, for all plans over one frame. As every such plan has the listed
    predicates, all push the same; a filter added later stays with Spark and cannot take rows from the frame it came from.
    """

    def __init__(self, path: str, schema: T.StructType, listed: str = "[]", mode: str = "FAILFAST") -> None:
        if mode not in ("FAILFAST", "DROPMALFORMED"):
            raise ValueError("mode is FAILFAST or DROPMALFORMED")
        self.path, self.schema, self.strict = path, schema, mode == "FAILFAST"
        self.listed = {tuple(x) for x in json.loads(listed)}
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        kinds = {ds.EqualTo: "eq", ds.In: "in", ds.StringStartsWith: "prefix", ds.IsNull: "null"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind, value = kinds.get(type(f)), getattr(f, "value", None)
            if column in HEADERS and kind and _spec(column, kind, value) in self.listed:
                self.filters.append((column, kind, value))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        fs, base = _filesystem(self.path)
        if fs.get_file_info(base).type == pafs.FileType.File:
            return [FilePart(base)]
        if fs.get_file_info(f"{base}/{_MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{base}/{_MANIFEST}", compression=None) as f:
                names = json.loads(f.read())
            return [FilePart(f"{base}/{n}") for n in names]
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        return [FilePart(f.path) for f in found if f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        fs, _ = _filesystem(self.path)
        names = self.schema.names
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(self.schema)
        rows: list[dict] = []
        size = 0
        with fs.open_input_file(partition.file) as f:
            for row in records(f, frozenset(names), self.filters, self.strict):
                rows.append(row)
                size += len(row.get("payload") or b"")
                if len(rows) >= 4096 or size >= 1 << 23:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


def parse_headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _row(headers: dict[str, str]) -> dict:
    """The header columns; a header that is missing, or a page id that is no number, is null."""
    row: dict = {c: headers.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c][1:-1] if row[c] and row[c].startswith("<") else row[c]
    for c in _LONGS:
        row[c] = _number(row[c])
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    return row


class Malformed(ValueError):
    """A record that breaks the format, and its place."""


class _Bytes:
    """A record's bytes from its start on: plain, or the content of one gzip member. Reads no further than asked."""

    def __init__(self, f: pa.NativeFile, at: int) -> None:
        self.f, self.at, self.used = f, at, 0
        f.seek(at)
        first = f.read(_FIRST)
        self.used = len(first)
        self.zip = first[:2] == b"\x1f\x8b"
        # The member's compressed length, where its header has one.
        self.long = struct.unpack_from("<I", first, 16)[0] if self.zip and len(first) >= 24 and first[3] & 4 and first[12:14] == b"sl" else None
        self.inflate = zlib.decompressobj(31) if self.zip else None
        self.raw = first
        self.data = bytearray(b"" if self.zip else first)

    def more(self, n: int) -> bool:
        """Some n further bytes; False at the end."""
        if self.inflate is None:
            got = self.f.read(n)
            self.used += len(got)
            self.data += got
            return bool(got)
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.f.read(1 << 16 if n > _FIRST else _FIRST)
            self.used += len(self.raw)
            if not self.raw:
                return False
        try:
            self.data += self.inflate.decompress(self.raw, n)
        except zlib.error as error:
            raise Malformed(f"the member at byte {self.at} cannot be inflated: {error}") from error
        self.raw = self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes, start: int = 0, stop: int | None = None) -> int:
        """The place of mark at or after start, -1 if there is none (before stop)."""
        seen = start
        while True:
            found = self.data.find(mark, max(start, seen - len(mark) + 1))
            if found >= 0 or stop is not None and len(self.data) >= stop:
                return found if found >= 0 and (stop is None or found < stop) else -1
            seen = len(self.data)
            if not self.more(_FIRST):
                return -1

    def fill(self, n: int) -> bool:
        """Whether there are n bytes, read up to there."""
        while len(self.data) < n:
            if not self.more(min(1 << 20, n - len(self.data))):
                return False
        return True

    def next(self, n: int) -> int:
        """Where the following record begins; n is the length of this one with its end."""
        if self.long is not None:
            return self.at + self.long
        if self.inflate is None:
            return self.at + n
        while not self.inflate.eof:  # another writer's member: its length is known when it is inflated
            self.data.clear()
            if not self.more(1 << 20):
                raise Malformed(f"the member at byte {self.at} is cut off")
        return self.at + self.used - len(self.inflate.unused_data)


def _block(source: _Bytes, cut: int, length: int, row: dict, names: frozenset[str]) -> None:
    """The columns that need the block, of `length` bytes from cut on; the payload is inflated only for columns that need it."""
    whole = bool(names & {"payload", "payload_length", "payload_sha1"})
    if not whole and "http_length" not in names:
        return
    if whole and not source.fill(cut + length):
        raise Malformed(f"the record at byte {source.at} is cut off")
    end = source.until(b"\r\n\r\n", cut, cut + length) if source.fill(min(cut + 5, cut + length)) and source.data[cut : cut + 5] == b"HTTP/" else -1
    if end >= 0:
        row["http_length"] = _number(parse_headers(bytes(source.data[cut:end])).get("content-length"))
    if whole:
        payload = bytes(source.data[cut if end < 0 else end + 4 : cut + length])
        row["payload"], row["payload_length"] = payload, len(payload)
        if "payload_sha1" in names:
            row["payload_sha1"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(f: pa.NativeFile, names: frozenset[str], filters: list[tuple[str, str, object]], strict: bool = True) -> Iterator[dict]:
    """The records of an open file that pass the filters, with the columns named. The filters see a record right after its
    WARC head; of one that they refuse nothing more is read than its length takes. See the module on malformed records."""
    size, at = f.size(), 0
    while at < size:
        source = _Bytes(f, at)
        try:
            end = source.until(b"\r\n\r\n")
            if end < 0:
                if not source.zip and not bytes(source.data).strip():
                    return  # blank lines at the end
                raise Malformed(f"the record at byte {at} has no end of its head")
            headers = parse_headers(bytes(source.data[:end]).lstrip())
            length, cut = _number(headers.get("content-length")), end + 4
            if length is None or length < 0:
                raise Malformed(f"the record at byte {at} has no length")
            if source.long is not None and at + source.long > size or not source.zip and at + cut + length > size:
                raise Malformed(f"the record at byte {at} is cut off")
            row = _row(headers)
            good = _holds(filters, row)
            if good:
                _block(source, cut, length, row, names)
            at = source.next(cut + length + 4)
            if good:
                yield {k: v for k, v in row.items() if k in names}
        except Malformed:
            if strict:
                raise
            if source.long is None:
                return
            at += source.long


class WarcSource(ds.DataSource):
    """format("sparkloom_warc"), with the options path, roll (bytes of a file, 64 MB by default), mode and push (see read_archives)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("push", "[]"), self.options.get("mode", "FAILFAST").upper())

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll", 1 << 26)))


def register(spark: SparkSession) -> None:
    """Registers the format and lets Spark hand predicates to Python sources, which a session does not do by itself."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes a record a row of pages(page_id, url, html) to archives under path.

    A null html is an empty payload. Of rows with equal payloads of at least `least` bytes the one with the largest
    page_id is the response (rows that repeat that id are all responses) and the others revisit it; with null ids alone,
    all are responses. Other columns play no part; an empty table writes an empty archive.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload")).withColumn("same", F.sha2("payload", 256))
    largest = rows.groupBy("same").agg(F.max("page_id").alias("largest"))  # by SHA-256: SHA-1 has known collisions
    joined = rows.join(largest, "same")
    own = F.col("largest").isNull() | (F.col("size") < least) | F.coalesce(F.col("page_id") == F.col("largest"), F.lit(False))
    out = joined.select("page_id", "url", "payload", "sha1", F.when(own, F.lit(None)).otherwise(F.col("largest")).cast("long").alias("response"))
    out.write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, schema: str = SCHEMA, where: Mapping[str, object] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """The records of all archives under path; columns that schema leaves out are not read.

    where: predicates on header columns, evaluated before payloads are inflated: a value, a list of values, a text that
    ends in % (a prefix), or None (no such header). mode: see the module. An archive without records, or a folder without
    archives, gives an empty table.
    """
    register(spark)
    cond, push = F.lit(True), []
    for column, value in (where or {}).items():
        if column not in HEADERS:
            raise ValueError(f"{column} is no header column")
        c = F.col(column)
        if value is None:
            cond, spec = cond & c.isNull(), _spec(column, "null", None)
        elif isinstance(value, (list, tuple)) and len(set(value)) > 1:
            cond, spec = cond & c.isin(list(value)), _spec(column, "in", list(set(value)))
        elif isinstance(value, str) and value.endswith("%"):
            cond, spec = cond & c.startswith(value[:-1]), _spec(column, "prefix", value[:-1])
        else:
            one = value[0] if isinstance(value, (list, tuple)) else value
            cond, spec = cond & (c == one), _spec(column, "eq", one)
        push.append(spec)
    return spark.read.format(FORMAT).schema(schema).option("push", json.dumps(push)).option("mode", mode).load(path).filter(cond)


def warc_digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """The contract's columns, from archives written to the shared folder and read back.

    The length and the digest of a response are worked out from the payload that is read; a revisit has no payload, and
    its record states both. Nulls, repeats, long payloads and empty tables are as in write_pages().
    """
    spark = pages.sparkSession
    path = common.scratch(spark, "warc")
    write_pages(pages, path, least)
    schema = "record_type string, payload_digest string, page_id long, refers_to_page long, http_length long, payload_length long, payload_sha1 string"
    rows = read_archives(spark, path, schema, {"record_type": ["response", "revisit"]})
    own = F.col("record_type") == "response"
    return rows.select(
        "page_id", F.when(own, F.col("payload_length")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(own, F.col("payload_sha1")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"),
    )

"""WARC archives as a Spark data source, for reading and writing.

Every record is a gzip member of its own. Members carry their stored and plain sizes
in the extra field "sl" (skip lengths), so a reader that does not want a record goes
on to the next without inflating its payload; archives without the field, and plain
ones, are read as well. Headers are parsed before any payload is decoded, and filters
on columns that headers give are applied at that point.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
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

from concord.llm import store

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary, file string, offset long"
)
#: Header of each column that a header gives.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A writer begins a new archive after so many bytes, which bounds a reader's partition.
FILE_BYTES = 64 << 20
_READ = 1 << 20


def sha1_hex(label: str | None) -> str | None:
    if not label:
        return None
    value = label.rpartition(":")[2]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def _clean(value: str) -> str:
    """A header's value on one line, with a % code for what would end it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if ("\r" in value or "\n" in value) else value


def member(plain: bytes, level: int = 3) -> bytes:
    """A gzip member of the bytes, with its skip lengths."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(plain) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


@dataclass
class _Files(WriterCommitMessage):
    files: list


class _WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str]):
        self.folder, self.columns = options["path"], columns
        self.level = int(options.get("level", "3"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, stream, size = [], None, 0
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in self.columns}
            payloads = columns.get("payload") or [None] * batch.num_rows
            for i in range(batch.num_rows):
                if stream is None:
                    files.append({"file": store.new_file(self.folder, ".warc.gz")})
                    stream, size = store.create(files[-1]["file"]), 0
                headers = [(h, str(columns[c][i])) for c, h in HEADERS.items() if c in columns and columns[c][i] is not None]
                if ("WARC-Type", "revisit") in headers:
                    headers.append(("WARC-Profile", REVISIT_PROFILE))
                data = member(record(headers, payloads[i] or b""), self.level)
                stream.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    stream.close()
                    files[-1]["bytes"], stream = size, None
        if stream is not None:
            stream.close()
            files[-1]["bytes"] = size
        return _Files(files)

    def commit(self, messages: list) -> None:
        store.commit(self.folder, [f for m in messages if m for f in m.files])

    def abort(self, messages: list) -> None:
        store.remove([f["file"] for m in messages if m for f in m.files])


@dataclass
class _Archive(InputPartition):
    file: str


class Warc(DataSource):
    """format("warc"): a folder of archives. A schema with fewer columns reads fewer; without payload, none is decoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return _WarcWriter(self.options, schema.fieldNames())


def _test(f: Filter):
    """The filter as a function of its column's value; None if it is not one that headers can answer."""
    if isinstance(f, Not):
        inner = _test(f.child)
        # SQL's NOT of an unknown stays unknown
        return inner and (inner[0], lambda v, t=inner[1]: None if (x := t(v)) is None else not x)
    column = getattr(f, "attribute", (None,))[0]
    if column not in HEADERS or len(f.attribute) != 1:
        return None
    known = {
        EqualTo: lambda v: v == f.value,
        GreaterThan: lambda v: v > f.value,
        GreaterThanOrEqual: lambda v: v >= f.value,
        LessThan: lambda v: v < f.value,
        LessThanOrEqual: lambda v: v <= f.value,
        In: lambda v: v in f.value,
        StringStartsWith: lambda v: v.startswith(f.value),
        StringEndsWith: lambda v: v.endswith(f.value),
        StringContains: lambda v: f.value in v,
    }
    if type(f) in known:
        return column, lambda v, t=known[type(f)]: None if v is None else t(v)
    if isinstance(f, IsNull):
        return column, lambda v: v is None
    if isinstance(f, IsNotNull):
        return column, lambda v: v is not None
    return (column, lambda v: v == f.value) if isinstance(f, EqualNullSafe) else None


class _WarcReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.folder, self.columns, self.filters = options["path"], columns, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        return [_Archive(f["file"]) for f in store.committed(self.folder)]

    def read(self, partition: _Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        tests = [_test(f) for f in self.filters]
        rows, held = [], 0
        types = {"payload": pa.binary(), "payload_bytes": pa.int64(), "offset": pa.int64()}
        arrow = pa.schema([(c, types.get(c, pa.string())) for c in self.columns])
        with store.open_file(partition.file) as f:
            for row in _records(f, partition.file, tests, "payload" in self.columns):
                rows.append(tuple(row[c] for c in self.columns))
                held += len(row.get("payload") or b"") + 200
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)


def parse_headers(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Bytes:
    """The file's bytes from a place on, read in pieces and kept while they are looked at."""

    def __init__(self, file):
        self.file, self.size, self.at, self.have = file, file.size(), 0, b""

    def peek(self, n: int) -> bytes:
        if len(self.have) < n:
            self.have += self.file.read_at(max(n - len(self.have), min(_READ, self.size - self.at - len(self.have))), self.at + len(self.have)) if self.at + len(self.have) < self.size else b""
        return self.have[:n]

    def skip(self, n: int) -> None:
        self.have = self.have[n:] if n < len(self.have) else b""
        self.at += n


def _plain_member(source: _Bytes, enough: bytes | None) -> tuple[bytes, int | None]:
    """Inflated bytes of the member at the source, up to ``enough`` at least if given; its stored size once it is known."""
    unpack = zlib.decompressobj(31)
    out, fed = b"", 0
    step = 1 << 14
    while not unpack.eof:
        data = source.peek(fed + step)[fed:]
        if not data:
            raise ValueError("an archive ends within a record")
        out += unpack.decompress(data)
        fed += len(data)
        if enough and enough in out:
            break
        step = _READ
    return out, (fed - len(unpack.unused_data) if unpack.eof else None)


def _records(file, name: str, tests: list, payloads: bool) -> Iterator[dict]:
    source = _Bytes(file)
    while source.at < source.size:
        start = source.at
        zipped = source.peek(2) == b"\x1f\x8b"
        if zipped:
            head = source.peek(24)
            size = struct.unpack_from("<I", head, 16)[0] if head[3] & 4 and head[12:14] == b"sl" else None
            plain, ended = _plain_member(source, b"\r\n\r\n")
            size = size or ended
        else:
            while source.peek(2) == b"\r\n":
                source.skip(2)
            start = source.at
            if start >= source.size:
                return
            n = 1 << 14
            while b"\r\n\r\n" not in (plain := source.peek(n)) and len(plain) == n:
                n *= 2
            size = None
        head, mark, _ = plain.partition(b"\r\n\r\n")
        if not mark or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start} of {name}")
        headers = parse_headers(head)
        length = int(headers.get("content-length", "0"))
        begin = len(head) + 4
        row = {c: headers.get(h.lower()) for c, h in HEADERS.items()} | {"file": name, "offset": start}
        row["payload_digest"] = sha1_hex(row["payload_digest"])
        row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] is not None else length if row["record_type"] != "revisit" else None
        wanted = all(t(row[c]) for c, t in tests)
        if zipped:
            if (wanted and payloads and len(plain) < begin + length) or size is None:
                plain, size = _plain_member(source, None)
            if wanted and payloads:
                row["payload"] = plain[begin : begin + length]
        else:
            size = begin + length
            if wanted and payloads:
                row["payload"] = source.peek(size)[begin:]
        if wanted and payloads:
            if len(row["payload"]) != length:
                raise ValueError(f"the record at {start} of {name} is cut off")
            if row["record_type"] != "revisit" and row["payload_digest"] and hashlib.sha1(row["payload"]).hexdigest() != row["payload_digest"]:
                raise ValueError(f"the payload at {start} of {name} does not have its digest")
        if wanted:
            yield row
        source.skip(size)


#: Equal payloads of fewer bytes than this are stored again each time.
REVISIT_BYTES = 1000


def archive_pages(pages: DataFrame, folder: str) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to archives in ``folder``.

    Of rows with equal payloads of REVISIT_BYTES or more, the one with the largest
    page_id is a response and the others revisit it, without a payload; all other rows
    are responses. The payload is the html in UTF-8; a null one is empty. Rows that
    repeat the largest page_id are responses all; a null page_id counts as the least
    and has no record id. A null url has no target. Other columns are ignored.

    The groups are found on digests alone; a digest that very many rows have is the
    key of a left side that is dealt over SALTS tasks.
    """
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(groups, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    out = joined.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("text/html").alias("content_type"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.when(revisit, urn("first")).alias("refers_to"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(folder)


#: Tasks over which the rows of one digest are dealt.
SALTS = 16


def read_archives(spark, folder: str, schema: str = SCHEMA) -> DataFrame:
    """The records of all archives of a folder. Filters on header columns reach the reader if the session allows that."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).load(folder)


def page_records(spark, folder: str) -> DataFrame:
    """What archive_pages() wrote, by page: page_id, payload_bytes, payload_digest, record_type, refers_to, and url and payload.

    Size and digest of a response are those of the payload as read; those of a revisit
    are its headers'.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = read_archives(spark, folder, "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
        "payload",
    )

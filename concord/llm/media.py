"""Media columns: members of archive files as a Spark data source.

A payload is stored as an 8-bit greyscale PNG image, losslessly: rows of WIDTH samples.
Images are members of tar archives. The writer notes, every SPLIT_BYTES, where a member
begins; a reader plans one partition for each such byte range and streams its members
in Arrow batches. A member that can't be read or does not fit its checksums is read
again by its offset alone, without the members around it.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from concord.llm import store

#: Samples of a row; a payload is filled up with FILL to a positive multiple of it.
WIDTH, FILL = 576, 255
SPLIT_BYTES, FILE_BYTES = 16 << 20, 256 << 20
RETRIES = 3
_SIGN = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> bytes:
    """UTF-8 of the text, filled up to a positive multiple of WIDTH bytes."""
    data = (text or "").encode()
    return data + bytes([FILL]) * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """An image of the payload's bytes, row by row; its length must be a positive multiple of WIDTH."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with its filter, 0: none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """Samples [height, width] of an 8-bit greyscale image without interlacing; checks every checksum."""
    if image[:8] != _SIGN:
        raise ValueError("not a PNG image")
    at, data, head = 8, [], None
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if len(image) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a damaged PNG image")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, entropy of their histogram in bits, and an average hash of 8 by 8 fields."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    n, values = len(flat), np.arange(256)
    mean = float(counts @ values) / n
    deviation = float(np.sqrt(max(float(counts @ (values * values)) / n - mean * mean, 0.0)))
    p = counts[counts > 0] / n
    sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    edges = np.arange(65) * n // 64
    fields = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(np.diff(edges), 1)
    marks = np.packbits(fields > fields.mean()).tobytes().hex()
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};hash={marks}"


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file; of sizes beyond 8 GiB in base 256."""
    sized = f"{size:011o}\0".encode() if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head = name.encode()[:100].ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + sized + b"00000000000\0" + b" " * 8 + b"0" + b"\0" * 100 + b"ustar\x0000"
    head = head.ljust(512, b"\0")
    return head[:148] + f"{sum(head):06o}\0 ".encode() + head[156:]


def parse_tar_header(head: bytes) -> tuple[str, int, bytes] | None:
    """Name, size and kind of a member; None for the zeros that end an archive."""
    if not head.strip(b"\0"):
        return None
    if len(head) < 512 or int(head[148:156].strip(b"\0 ") or b"-1", 8) != sum(head[:148]) + 8 * 32 + sum(head[156:]):
        raise ValueError("a damaged tar header")
    size = int.from_bytes(head[125:136], "big") if head[124] & 0x80 else int(head[124:136].strip(b"\0 ") or b"0", 8)
    prefix = head[345:500].rstrip(b"\0").decode("utf-8", "replace") if head[257:262] == b"ustar" else ""
    name = head[:100].rstrip(b"\0").decode("utf-8", "replace")
    return (f"{prefix}/{name}" if prefix else name), size, head[156:157]


@dataclass
class _Files(WriterCommitMessage):
    files: list


class _MediaWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str]):
        self.folder = options["path"]
        self.name, self.text = columns.index("name"), columns.index("text")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, stream = [], None
        for batch in batches:
            for name, text in zip(batch.column(self.name).to_pylist(), batch.column(self.text).to_pylist(), strict=True):
                if stream is None:
                    files.append({"file": store.new_file(self.folder, ".tar"), "splits": [0]})
                    stream, size = store.create(files[-1]["file"]), 0
                image = to_png(padded(text))
                data = tar_header(name, len(image)) + image + b"\0" * (-len(image) % 512)
                if size + len(data) - files[-1]["splits"][-1] > SPLIT_BYTES and size > files[-1]["splits"][-1]:
                    files[-1]["splits"].append(size)
                stream.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    stream.write(b"\0" * 1024)
                    stream.close()
                    files[-1]["bytes"], stream = size, None
        if stream is not None:
            stream.write(b"\0" * 1024)
            stream.close()
            files[-1]["bytes"] = size
        return _Files(files)

    def commit(self, messages: list) -> None:
        store.commit(self.folder, [f for m in messages if m for f in m.files])

    def abort(self, messages: list) -> None:
        store.remove([f["file"] for m in messages if m for f in m.files])


@dataclass
class _Range(InputPartition):
    file: str
    low: int
    high: int | None


class MediaArchives(DataSource):
    """format("media_archives"): members of the tar archives of a folder, one partition a byte range.

    Where the manifest tells where a range ends, a header before that end that is damaged,
    zeros or cut off is read again by its offset, and fails the job after RETRIES tries.

    Columns: name, file, offset, error (null, or why a member could not be read in
    RETRIES tries), media (its bytes as stored), media_bytes, media_sha256, payload
    (the samples), payload_bytes, payload_sha256, tail_crc32 (of the last 32 samples),
    unpadded_bytes (without the trailing FILL), feature. A schema with fewer columns
    computes and sends fewer.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return (
            "name string, file string, offset long, error string, media binary, media_bytes long, media_sha256 string, payload binary, "
            "payload_bytes long, payload_sha256 string, tail_crc32 long, unpadded_bytes long, feature string"
        )

    def reader(self, schema) -> DataSourceReader:
        return _MediaReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return _MediaWriter(self.options, schema.fieldNames())


_COLUMNS = {
    "name": (pa.string(), lambda m: m["name"]),
    "file": (pa.string(), lambda m: m["file"]),
    "offset": (pa.int64(), lambda m: m["offset"]),
    "error": (pa.string(), lambda m: m["error"]),
    "media": (pa.binary(), lambda m: m["media"]),
    "media_bytes": (pa.int64(), lambda m: len(m["media"])),
    "media_sha256": (pa.string(), lambda m: hashlib.sha256(m["media"]).hexdigest()),
    "payload": (pa.binary(), lambda m: m["samples"].tobytes()),
    "payload_bytes": (pa.int64(), lambda m: m["samples"].size),
    "payload_sha256": (pa.string(), lambda m: hashlib.sha256(m["samples"].tobytes()).hexdigest()),
    "tail_crc32": (pa.int64(), lambda m: zlib.crc32(m["samples"].tobytes()[-32:])),
    "unpadded_bytes": (pa.int64(), lambda m: len(m["samples"].tobytes().rstrip(bytes([FILL])))),
    "feature": (pa.string(), lambda m: features(m["samples"])),
}
_ALWAYS = ("name", "file", "offset", "error")


class _MediaReader(DataSourceReader):
    def __init__(self, options, schema):
        self.folder, self.columns = options["path"], schema.fieldNames()
        self.wait = float(options.get("retryseconds", options.get("retrySeconds", "0.2")))

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in store.committed(self.folder):
            bounds = [*f.get("splits", [0]), f.get("bytes")]
            out += [_Range(f["file"], low, high) for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def _member(self, partition: _Range, at: int, size: int) -> dict:
        """The member's bytes by its offset, with as many tries as it needs up to RETRIES."""
        for k in range(RETRIES):
            try:
                with store.open_file(partition.file) as f:
                    image = f.read_at(size, at + 512)
                return {"media": image, "samples": from_png(image), "error": None}
            except (OSError, ValueError, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.wait * (k + 1))
        return {"media": None, "samples": None, "error": error}

    def _header(self, partition: _Range, at: int) -> tuple[str, int, bytes]:
        """The header of a member that has to be at the offset, with as many tries as it needs up to RETRIES; raises after them."""
        for k in range(RETRIES):
            try:
                with store.open_file(partition.file) as f:
                    head = parse_tar_header(f.read_at(512, at))
                if head is not None:
                    return head
                error = "no member where the manifest has one"
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
            time.sleep(self.wait * (k + 1))
        raise ValueError(f"{partition.file} at {at}: {error}")

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows, held = [], 0
        with store.open_file(partition.file) as f:
            at, high = partition.low, partition.high if partition.high is not None else f.size()
            while at < high:
                try:
                    head = parse_tar_header(f.read_at(512, at))
                except (OSError, ValueError):
                    if partition.high is None:
                        raise
                    head = None
                if head is None:
                    if partition.high is None:
                        break
                    head = self._header(partition, at)
                name, size, kind = head
                if kind in (b"0", b"\0"):
                    m = {"name": name, "file": partition.file, "offset": at}
                    try:
                        image = f.read_at(size, at + 512)
                        m |= {"media": image, "samples": from_png(image), "error": None}
                    except (OSError, ValueError, zlib.error):
                        m |= self._member(partition, at, size)
                    rows.append([_COLUMNS[c][1](m) if m["error"] is None or c in _ALWAYS else None for c in self.columns])
                    held += size + 500 if not {"payload", "media"}.isdisjoint(self.columns) else 500
                at += 512 + size + -size % 512
                if held >= 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _COLUMNS[n][0]) for n, c in zip(self.columns, zip(*rows, strict=True), strict=True)], self.columns)


def write_media(docs: DataFrame, folder: str) -> None:
    """Stores the text of each row of ``docs`` (doc_id, text) as an image in archives in ``folder``; nothing is shuffled.

    A null text is stored as an empty one: one row of FILL. The member's name is the
    doc_id; a null one is called null. Rows that repeat a doc_id are members each.
    Equal texts are equal images. Other columns are ignored.
    """
    docs.sparkSession.dataSource.register(MediaArchives)
    name = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit(".png"))
    docs.select(name.alias("name"), F.col("text").cast("string").alias("text")).write.format("media_archives").mode("append").save(folder)


def read_media(spark: SparkSession, folder: str, columns: str | None = None) -> DataFrame:
    """The members of all archives of a folder, with the columns of a schema string, or all."""
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives")
    return (reader.schema(columns) if columns else reader).load(folder)


def media_digests(spark: SparkSession, folder: str) -> DataFrame:
    """What write_media() stored, read back: doc_id, n_bytes, and payload's and image's digests and feature. A member that can't be read fails the job."""
    found = read_media(spark, folder, "name string, error string, unpadded_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    sure = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("name"), F.lit(": "), F.col("error"))).cast("string")).otherwise(F.col("feature"))
    return found.select(
        F.regexp_extract("name", r"^(-?\d+)\.png$", 1).try_cast("long").alias("doc_id"),
        F.col("unpadded_bytes").alias("n_bytes"),
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        sure.alias("feature"),
    )

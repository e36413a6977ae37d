"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their id. Layout, numbers little-endian:

    header  8 bytes           b"CSST0002"
    blocks                    each zstd-compressed, then crc32 of the stored bytes (4)
    index   per block         first and last key (9 each), offset (8), stored bytes (4),
                              entries (4), ids in the blocks before (8)
    filter  Bloom filter      bits
    footer  FOOTER bytes      offsets and sizes of index and filter, hashes of the filter,
                              documents, ids, bytes an id, b"CSST0002"

A block is a run of entries: bytes shared with the key before (1), further bytes of
the key (1), bytes of the value (4), the further bytes, the value. Keys are 9 bytes
that sort as the ids do, null first. The value is the token ids, of 2 bytes each where
the vocabulary allows, else of 4. The manifest has each shard's first and last id, so
a lookup opens only shards that may hold the id; it asks the filter, bisects the
index, and reads one block, of which the index says how many ids stand before it.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concord.llm import store
from concord.llm.pieces import Coder, letters_of, library, runs, to_letters
from concord.llm.words import row_runs

MAGIC = b"CSST0002"
FOOTER = struct.Struct("<QQQQIQQI8s")
_INDEX = struct.Struct("<9s9sQIIQ")
#: Bytes of entries after which a block ends, before compression.
BLOCK_BYTES = 1 << 18
#: Bits of the Bloom filter a document, and its hashes.
FILTER_BITS, FILTER_HASHES = 10, 7
#: Text that is encoded at a time; in longer runs more stretches of text are the same.
RUN_BYTES = 1 << 22
#: Stored bytes and documents after which a task begins another shard; its keys are held until it ends.
SHARD_BYTES, SHARD_DOCUMENTS = 1 << 28, 1 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _filter_places(keys: bytes, bits: int) -> np.ndarray:
    """Places in a filter of so many bits of keys that stand one after another, a row for each."""
    parts = np.frombuffer(keys, np.dtype([("sign", "u1"), ("number", ">u8")]))
    x = parts["number"].astype(np.uint64) + parts["sign"]
    a = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    b = (a ^ (a >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(FILTER_HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class Writer:
    """One shard; documents come in order."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.offset = stream, width, 0
        self.block, self.first, self.last, self.entries = bytearray(), b"", b"", 0
        self.index, self.keys, self.ids, self.ids_before = [], bytearray(), 0, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.offset += len(data)

    @property
    def documents(self) -> int:
        return len(self.keys) // 9

    @property
    def full(self) -> bool:
        return self.offset >= SHARD_BYTES or self.documents >= SHARD_DOCUMENTS

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype(f"<u{self.width}").tobytes()
        if key < self.last:
            raise ValueError("documents must come in ascending order")
        shared = 0
        if self.entries:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += struct.pack("<BBI", shared, 9 - shared, len(value)) + key[shared:] + value
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)
        self.keys += key
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.entries:
            stored = self.pack(bytes(self.block))
            self.index.append((self.first, self.last, self.offset, len(stored), self.entries, self.ids_before))
            self._put(stored + struct.pack("<I", zlib.crc32(stored)))
        self.block, self.entries, self.ids_before = bytearray(), 0, self.ids

    def close(self) -> None:
        self._end_block()
        index = b"".join(_INDEX.pack(*x) for x in self.index)
        at = self.offset
        self._put(index)
        bits = max(64, self.documents * FILTER_BITS)
        marks = np.zeros(-(-bits // 8) * 8, np.uint8)
        for low in range(0, len(self.keys), 9 << 16):
            marks[_filter_places(bytes(self.keys[low : low + (9 << 16)]), bits)] = 1
        packed = np.packbits(marks).tobytes()
        filter_at = self.offset
        self._put(packed)
        self._put(FOOTER.pack(at, len(index), filter_at, len(packed), bits, self.documents, self.ids, self.width, MAGIC))
        self.stream.close()


class Shard:
    """One shard, for reading."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < len(MAGIC) + FOOTER.size or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token table")
        at, n, filter_at, filter_n, self.bits, self.documents, self.ids, self.width, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("a token table without its end")
        self.index = list(_INDEX.iter_unpack(file.read_at(n, at)))
        self._filter = filter_at, filter_n
        self.blocks_read = 0

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, _, at, size, _, _ = self.index[k]
        stored = self.file.read_at(size + 4, at)
        self.blocks_read += 1
        if zlib.crc32(stored[:size]) != struct.unpack("<I", stored[size:])[0]:
            raise ValueError(f"block {k} is damaged")
        data, key, i = zstandard.ZstdDecompressor().decompress(stored[:size]), b"", 0
        while i < len(data):
            shared, more, value = struct.unpack_from("<BBI", data, i)
            i += 6
            key = key[:shared] + data[i : i + more]
            i += more
            yield key, np.frombuffer(data, f"<u{self.width}", value // self.width, i)
            i += value

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def may_hold(self, key: bytes) -> bool:
        """What the filter says: False only for keys that the shard does not have."""
        at, n = self._filter
        bits = np.frombuffer(self.file.read_at(n, at), np.uint8)
        places = _filter_places(key, self.bits)[0]
        return bool((bits[places >> 3] >> (7 - (places & 7)) & 1).all())

    def get(self, doc_id: int | None) -> list[tuple[int, np.ndarray]]:
        """(ids of the shard before, ids) of each document of that id, mostly one or none."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        k = bisect.bisect_left([x[1] for x in self.index], key)
        found = []
        while k < len(self.index) and self.index[k][0] <= key:
            before = self.index[k][5]
            for own, ids in self._block(k):
                if own == key:
                    found.append((before, ids))
                before += len(ids)
            k += 1
        return found


@lru_cache
def _library_coder(path: str) -> Coder:
    """Pieces are encoded by the library's own model, many at a time and each once, whatever texts it is in."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    plain = Tokenizer(library(path).model)
    plain.pre_tokenizer = CharDelimiterSplit("\n")  # no letter of a byte is a line end
    sizes = np.array([len(plain.id_to_token(i) or "") for i in range(plain.get_vocab_size())])

    def encode(pieces: list[str]) -> list[bytes]:
        out = []
        for low in range(0, len(pieces), 20_000):
            letters = to_letters(pieces[low : low + 20_000])
            ids = np.array(plain.encode_batch_fast(["\n".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            # tokens are made of whole letters, so counting those tells where each piece ends
            ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(x) for x in letters])) + 1
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [data[i:j] for i, j in zip(at, at[1:])]
        return out

    def encode_units(pieces: list[str]) -> list[bytes]:
        data = np.frombuffer("\n".join(pieces).encode(), np.uint8)
        gap = np.flatnonzero((data[:-2] == 10) & (data[1:-1] == 10) & (data[2:] == 10))  # a unit's end: its line end between two of joining
        letters = np.concatenate([[0], np.cumsum(data != 10)])[[*gap, len(data)]]
        ids = np.array(plain.encode_batch_fast([letters_of(data)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.searchsorted(np.cumsum(sizes[ids]), letters) + 1) * 4
        out, at = ids.tobytes(), [0, *ends.tolist()]
        return [out[i:j] for i, j in zip(at, at[1:])]

    return Coder(path, encode, encode_units)


def library_ids(path: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Token ids of each whole text by the tokenizers library; none for null and empty texts."""
    coder = _library_coder(path)
    for run in runs([t or "" for t in texts], RUN_BYTES):
        for ids in coder(run):
            yield np.frombuffer(ids, "<u4")


_MADE = "shard long, part long, file string, documents long, ids long, first long, last long"


def _write(folder: str, path: str, end: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    width = 2 if max(library(path).get_vocab_size(), (end or 0) + 1) <= 65536 else 4
    writer, made = None, []

    def close() -> None:
        writer.close()
        first, last = (id_of(bytes(k)) for k in (writer.keys[:9], writer.keys[-9:]))
        made.append((TaskContext.get().partitionId(), len(made), file, writer.documents, writer.ids, first, last))

    for batch in batches:
        texts = (t for first, count in row_runs(batch.column(1), RUN_BYTES) for t in library_ids(path, batch.column(1).slice(first, count).to_pylist()))
        for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
            if writer is None:
                file = store.new_file(folder, ".sst")
                writer = Writer(store.create(file), width)
            writer.add(doc_id, ids if end is None else np.append(ids, np.uint32(end)))
            if writer.full:
                close()
                writer = None
    if writer is not None:
        close()
    if made:
        names = [c.split()[0] for c in _MADE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "file" else pa.int64()) for c, n in zip(zip(*made, strict=True), names, strict=True)], names)


def write_token_tables(docs: DataFrame, folder: str, path: str, end: int | None = None) -> None:
    """Shards of the token ids of all rows of ``docs`` (doc_id, text) in ``folder``, in ascending order of doc_id across them.

    Ids are the tokenizers library's with add_special_tokens=False by the vocabulary
    file at ``path``, then ``end`` if given. Null and empty texts have no ids of their
    own. Null doc_ids come first; rows that repeat a doc_id are entries of their own,
    in the order of their texts. The range partitioning also looks at a hash of the
    text, so that many rows of one doc_id do not meet in one task. A task ends a shard at
    SHARD_BYTES or SHARD_DOCUMENTS and begins another. An empty table makes no shard.
    Other columns are ignored. The driver gets one row a shard, for the manifest.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys, "text").drop("tie")
    made = dealt.mapInArrow(lambda it: _write(folder, path, end, it), _MADE).collect()
    store.commit(folder, [r.asDict() for r in sorted(made, key=lambda r: (r.shard, r.part))])


@dataclass
class _ShardPartition(InputPartition):
    file: str
    start: int


class TokenTables(DataSource):
    """Reads a folder of write_token_tables(); one partition a shard.

    Columns, of which a given schema may name fewer: doc_id, start (ids of all
    documents before), n_tokens, ids_crc32 (unsigned, of the ids as little-endian
    32-bit integers), token_ids. With option doc_id, a lookup in the shards whose ids
    go from below to above it; empty means the null id.
    """

    @classmethod
    def name(cls) -> str:
        return "token_tables"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long, token_ids array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(self.options, schema.fieldNames())


class _TokenReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.folder, self.columns, self.wanted = options["path"], columns, options.get("doc_id")

    def partitions(self) -> list[InputPartition]:
        out, start = [], 0
        key = None if self.wanted is None else key_of(self._id())
        for f in store.committed(self.folder):
            if key is None or key_of(f["first"]) <= key <= key_of(f["last"]):
                out.append(_ShardPartition(f["file"], start))
            start += f["ids"]
        return out

    def _id(self) -> int | None:
        return int(self.wanted) if self.wanted else None

    def read(self, partition: _ShardPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with store.open_file(partition.file) as f:
            shard, start = Shard(f), partition.start
            rows: list[tuple] = []
            if self.wanted is not None:
                rows = [(self._id(), start + before, ids) for before, ids in shard.get(self._id())]
            held = 0
            for doc_id, ids in shard if self.wanted is None else ():
                rows.append((doc_id, start, ids))
                held += len(ids)
                start += len(ids)
                if held > 1 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        made = {
            "doc_id": lambda: pa.array([r[0] for r in rows], pa.int64()),
            "start": lambda: pa.array([r[1] for r in rows], pa.int64()),
            "n_tokens": lambda: pa.array([len(r[2]) for r in rows], pa.int64()),
            "ids_crc32": lambda: pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
            "token_ids": lambda: pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)


def read_token_tables(spark: SparkSession, folder: str, columns: str = "doc_id long, start long, n_tokens long, ids_crc32 long, token_ids array<int>") -> DataFrame:
    """The documents of a folder of shards; an empty folder has none."""
    spark.dataSource.register(TokenTables)
    return spark.read.format("token_tables").schema(columns).load(folder)


def find_document(spark: SparkSession, folder: str, doc_id: int | None) -> DataFrame:
    """The documents of one id, mostly one or none, by the manifest, the filter and the index of the shards that may hold it."""
    spark.dataSource.register(TokenTables)
    return spark.read.format("token_tables").option("doc_id", "" if doc_id is None else str(doc_id)).load(folder)

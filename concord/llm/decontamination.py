"""Benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over consecutive words; words under a 0 are ignored,
so a hit survives substitutions there. Seeds of the benchmark are joined with those
of every document by hash; around each hit the two word sequences are compared on
their common diagonal, and the pair counts if some window of WINDOW words agrees in
all but LOSS of them.

The masks find every such window: SEEDS is such that whichever LOSS words of WINDOW
are substituted, some mask fits between them (tests check all placements).

Shorter items have masks of their whole length: one for a place-by-place match, or,
where a word may be substituted, three that leave out a third each.

A benchmark of at most BLOCK_WORDS words is a table in memory, broadcast to the one scan
of the documents. Of a larger one only a Bloom filter of its seeds, of at most
FILTER_BITS, is broadcast: the scan hands on the seeds that pass, with the words of their
documents, and they are joined with the benchmark's by hash. Either way the documents
are read and hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import cut, dealt_anew, free_name
from concord.llm.words import mix, text_chunks, word_hashes

WINDOW, LOSS = 13, 2
#: Fixed masks; 1: the word counts, 0: it is ignored.
SEEDS = ("1110111001", "101111101", "1110010111")
#: Items of fewer words than this are no evidence and never match.
SHORTEST = 5
#: Words of benchmark items that are held in memory and broadcast at most; a larger benchmark is joined by hash.
BLOCK_WORDS = 1 << 20
#: Bits of the filter of a larger benchmark's seeds at most, and places that a seed has in it.
FILTER_BITS, FILTER_PLACES = 1 << 29, 6


def _seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask at each place where it fits into the words."""
    n = len(words) - len(mask) + 1
    h = np.full(max(n, 0), len(mask) * 65536 + int(mask, 2), np.uint64)
    for k, c in enumerate(mask if n > 0 else ""):
        if c == "1":
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(h)


def loss_of(size: int, short_loss: bool) -> int:
    """Words of an item's window that may be substituted: LOSS, and in proportion in shorter items or none."""
    return LOSS if size >= WINDOW else LOSS * size // WINDOW if short_loss else 0


def masks_of(size: int, short_loss: bool) -> tuple[str, ...]:
    """Masks that find an item of so many words; of a shorter one than WINDOW at most one word is substituted."""
    if size >= WINDOW:
        return SEEDS
    if not loss_of(size, short_loss):
        return ("1" * size,)
    edges = [size * k // 3 for k in range(4)]
    return tuple("1" * low + "0" * (high - low) + "1" * (size - high) for low, high in zip(edges[:-1], edges[1:], strict=True))


def _item_seeds(words: np.ndarray, short_loss: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds of an item, and where each begins."""
    found = [_seed_hashes(words, m) for m in masks_of(len(words), short_loss)]
    return np.concatenate(found), np.concatenate([np.arange(len(h), dtype=np.int32) for h in found])


def _all_masks(sizes, short_loss: bool) -> list[str]:
    """The masks of items of these sizes."""
    return [*SEEDS, *sorted({m for n in sizes if SHORTEST <= n < WINDOW for m in masks_of(n, short_loss)})]


def best_window(own: np.ndarray, words: np.ndarray, diagonal: int, short_loss: bool) -> tuple[int, int, int, int] | None:
    """Of the best window on a diagonal of an item and a text: words that agree, and where it begins in text and item; then all words of the diagonal that agree."""
    size = min(WINDOW, len(own))
    low, high = max(0, -diagonal), min(len(own), len(words) - diagonal)
    if high - low < size:
        return None
    sums = np.concatenate([[0], np.cumsum(own[low:high] == words[diagonal + low : diagonal + high])])
    within = sums[size:] - sums[:-size]
    best = int(within.argmax())
    need = size - loss_of(len(own), short_loss)
    return (int(within[best]), diagonal + low + best, low + best, int(sums[-1])) if within[best] >= need else None


class _Block:
    """Items of the benchmark: their words, and their seeds sorted by hash, with a filter of one bit a place."""

    def __init__(self, items: list[tuple[int, np.ndarray]], short_loss: bool = False):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.short_loss = short_loss
        self.masks = _all_masks(map(len, self.words), short_loss)
        seeds = [_item_seeds(w, short_loss) for w in self.words]
        self.hashes = np.concatenate([h for h, _ in seeds])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.at = self.hashes[order], np.concatenate([at for _, at in seeds])[order]
        self.of = np.repeat(np.arange(len(seeds), dtype=np.int32), [len(h) for h, _ in seeds])[order]
        bits = max(16, int(len(self.hashes) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        marks = np.zeros(1 << bits, bool)
        marks[(self.hashes >> self.shift).astype(np.int64)] = True
        self.filter = np.packbits(marks, bitorder="little")

    def known(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> self.shift).astype(np.int64)
        return (self.filter[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    def hits(self, words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, diagonal) of all places where a seed of the words, within one text, is one of an item."""
        found = [np.zeros((3, 0), np.int64)]
        for mask in self.masks:
            h = _seed_hashes(words, mask)
            near = np.flatnonzero(self.known(h))
            near = near[text_of[near] == text_of[near + len(mask) - 1]]
            h = h[near]
            low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
            count = high - low
            near, low, count = near[count > 0], low[count > 0], count[count > 0]
            seed = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            near = np.repeat(near, count)
            found.append(np.stack([text_of[near], self.of[seed], near - self.at[seed]]).astype(np.int64))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


_NAMES = ["doc_id", "item_id", "matched", "window", "doc_word", "item_word", "agreeing"]


def _overlaps(block: _Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for first, b, offsets in text_chunks(batch.column(1)):
            words, at = word_hashes(b, offsets, apart=True)
            text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            best: dict[tuple[int, int], tuple] = {}
            for text, item, diagonal in zip(*block.hits(words, text_of), strict=True):
                own = words[at[text] : at[text + 1]]
                if (x := best_window(block.words[item], own, int(diagonal - at[text]), block.short_loss)) is not None:
                    best[text, item] = max(best.get((text, item), x), x)
            out += [(ids[first + t], block.ids[i], x[0], min(WINDOW, len(block.words[i])), x[1], x[2], x[3]) for (t, i), x in best.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], _NAMES)


def _items(short_loss: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words binary, size) of the items that may match."""
    for batch in batches:
        for first, b, offsets in text_chunks(batch.column(1)):
            words, at = word_hashes(b, offsets, apart=True)
            long = np.flatnonzero(np.diff(at) >= SHORTEST)
            own = [words[at[i] : at[i + 1]].tobytes() for i in long]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + long)), pa.array(own, pa.binary()), pa.array(np.diff(at)[long], pa.int64())], ["item_id", "words", "size"])


def _broadcast_overlaps(docs: DataFrame, items: DataFrame, short_loss: bool) -> DataFrame:
    rows = items.select("item_id", "words").collect()  # overlaps() has counted their words
    block = _Block([(r.item_id, np.frombuffer(r.words, np.uint64)) for r in rows], short_loss)
    sent = docs.sparkSession.sparkContext.broadcast(block)
    return docs.mapInArrow(lambda it: _overlaps(sent.value, it), _SCHEMA)


_SCHEMA = ", ".join(f"{c} long" for c in _NAMES)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a filter of so many bits, a row for each of FILTER_PLACES."""
    step = (mix(hashes) | np.uint64(1))[None, :]
    return ((hashes[None, :] + step * np.arange(FILTER_PLACES, dtype=np.uint64)[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _seeds(short_loss: bool, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, item, at) of items (item, words); with ``bits``, (word, bit) of each seed's places in a filter of 64-bit words."""
    for batch in batches:
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hashes, at = _item_seeds(np.frombuffer(words, np.uint64), short_loss)
            if bits:
                place = np.unique(_places(hashes, bits))
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), item)), pa.array(at.astype(np.int64))], ["hash", "item", "at"])


def _passing(masks: list[str], bits: int, marks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (row, doc_id, words) for each document with seeds that pass the filter, and rows (row, hash, at) of those."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 36
    for batch in batches:
        for first, b, offsets in text_chunks(batch.column(1)):
            words, at = word_hashes(b, offsets, apart=True)
            text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for mask in masks:
                h = _seed_hashes(words, mask)
                near = np.arange(len(h))
                for place in _places(h, bits):
                    near = near[marks[place[near] >> 6] >> (place[near] & 63).astype(np.uint64) & np.uint64(1) == 1]
                near = near[text_of[near] == text_of[near + len(mask) - 1]]
                found.append((near, h[near]))
            place, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
            texts = np.unique(text_of[place])
            if not len(texts):
                continue
            rows = number + np.searchsorted(texts, text_of[place])
            none = lambda k, kind: pa.nulls(k, kind)
            names = ["row", "doc_id", "words", "hash", "at"]
            own = pa.array([words[at[i] : at[i + 1]].tobytes() for i in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(texts))), batch.column(0).take(pa.array(first + texts)), own, none(len(texts), pa.int64()), none(len(texts), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(rows), none(len(rows), pa.int64()), none(len(rows), pa.binary()), pa.array(hashes.view(np.int64)), pa.array(place - at[text_of[place]])], names)
            number += len(texts)


def _compared(short_loss: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best window of each row (doc_id, words, item_id, item_words, diagonals)."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            words, own = (np.frombuffer(r[c], np.uint64) for c in ("words", "item_words"))
            found = [x for d in r["diagonals"] if (x := best_window(own, words, d, short_loss)) is not None]
            if found:
                x = max(found)
                out.append((r["doc_id"], r["item_id"], x[0], min(WINDOW, len(own)), x[1], x[2], x[3]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], _NAMES)


def _joined_overlaps(docs: DataFrame, items: DataFrame, total: int, sizes: list[int], short_loss: bool) -> DataFrame:
    """The overlaps by a join on seed hashes; items are numbered, as their ids may repeat or be null."""
    spark = docs.sparkSession
    items = cut(items.select("item_id", "words", F.monotonically_increasing_id().alias("item")), "items")
    own = items.select("item", "words")
    seeds = cut(own.mapInArrow(lambda it: _seeds(short_loss, 0, it), "hash long, item long, at long"), "seeds")
    bits = min(FILTER_BITS, 1 << (96 * max(total, 2048)).bit_length())
    marked = own.mapInArrow(lambda it: _seeds(short_loss, bits, it), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    filled = marked.toPandas()  # at most bits / 64 rows, whatever the size of the benchmark
    marks = np.zeros(bits // 64, np.uint64)
    marks[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast((_all_masks(sizes, short_loss), bits, marks))
    passed = cut(docs.mapInArrow(lambda it: _passing(*sent.value, it), "row long, doc_id long, words binary, hash long, at long"), "passed")
    met = passed.where("hash IS NOT NULL").select("row", "hash", F.col("at").alias("place")).join(seeds, "hash")
    near = met.groupBy("row", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    texts = passed.where("words IS NOT NULL").select("row", "doc_id", "words")
    both = near.join(texts, "row").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    return both.select("doc_id", "words", "item_id", "item_words", "diagonals").mapInArrow(lambda it: _compared(short_loss, it), _SCHEMA)


def overlaps(docs: DataFrame, benchmark: DataFrame, short_loss: bool = False) -> DataFrame:
    """Pairs of a document (doc_id, text) and a benchmark item (item_id, text) that overlap.

    One row per doc_id and item_id: matched, the words of the best window that agree,
    of window words; doc_word and item_word, where that window begins; agreeing, the
    words that agree on its whole diagonal. An item of WINDOW words or more overlaps a
    document if some WINDOW consecutive words of it agree, place by place, with words
    of the document in all but LOSS; a shorter one, of SHORTEST words at least, if all
    its words occur in a row or, with ``short_loss``, all but LOSS * words // WINDOW: one
    in items of 7 to 12 words. Each character of a script without blanks is a word.

    Null and empty texts and items overlap nothing. Rows that repeat a doc_id or an
    item_id count as one (the best window of any; then the latest place); rows with a
    null id are kept under a null id. Items of equal text each make their pair. Other
    columns are ignored; an empty table gives an empty result.

    Documents are read once; of a benchmark of up to BLOCK_WORDS words only pairs are
    shuffled, of a larger one the words of documents with seeds that pass its filter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut(given.mapInArrow(lambda it: _items(short_loss, it), "item_id long, words binary, size long"), "items")
    sizes = items.groupBy(F.least("size", F.lit(WINDOW)).alias("size")).agg(F.sum("size").alias("total")).collect()
    total = sum(r.total for r in sizes)
    if not total:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    if total <= BLOCK_WORDS:
        found = _broadcast_overlaps(docs, items, short_loss)
    else:
        found = _joined_overlaps(docs, items, total, [r.size for r in sizes], short_loss)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "agreeing", "doc_word", "item_word", "window")).alias("best"))
    return best.select("doc_id", "item_id", *(F.col(f"best.{c}").alias(c) for c in ("matched", "window", "doc_word", "item_word", "agreeing")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, short_loss: bool = False) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id has no overlap with the benchmark.

    All rows of a doc_id go if one of their texts overlaps an item. Null doc_ids stay, as
    do null and empty texts of other ids; an empty benchmark takes nothing.
    """
    leaks = overlaps(docs, benchmark, short_loss).where("doc_id IS NOT NULL").select("doc_id").distinct()
    name = free_name(docs, "leak")
    return docs.join(dealt_anew(leaks, "doc_id").withColumnRenamed("doc_id", name), F.col("doc_id").cast("long") == F.col(name), "left_anti")

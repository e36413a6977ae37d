"""Quality classifier: supervised subword embeddings.

Each whitespace-separated word, each pair of neighbouring words, and each run of 3 and of
4 characters of a word with one boundary mark at either side is hashed to a row of an
embedding matrix; a pair has a second row, which says whether it is one word twice. A
document is the mean of its rows; a softmax over two classes reads it. Matrix and
softmax are trained together by stochastic gradient descent in numpy on a bounded sample
of labelled documents. As both layers are linear, a row's share in the score is one
number, so scoring is a gather and a mean over all of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.shared import free_name, with_mapped
from concord.llm.words import mix, power_tables, text_chunks

BITS, DIM, GRAMS = 18, 8, (3, 4)
#: Rows of the matrix: one for each hash, and two that say whether a pair of neighbours is one word twice.
ROWS = (1 << BITS) + 2
#: Labelled documents, and bytes of their text, that are used for training at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 40_000_000
#: SPREAD: how much faster the many rows of the matrix learn than the softmax.
EPOCHS, RATE, SPREAD = 3, 0.5, 20.0
THRESHOLD = 0.7
_SPREAD_BITS = np.uint64(0xBF58476D1CE4E5B9)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: White space, which parts words.
_BLANKS = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


@lru_cache
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its number in the hash, and whether it belongs to a word."""
    points = np.arange(0x110000, dtype=np.uint64)
    solid = np.ones(len(points), bool)
    solid[_BLANKS] = False
    codes = mix(points + np.uint64(0x1234567)) | np.uint64(1)
    codes[_BLANKS] = codes[0x20]
    return codes, solid


def _characters(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts in UTF-8, and where each text's begin."""
    lead = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    try:
        return np.frombuffer(b.tobytes().decode().encode("utf-32-le"), "<u4"), lead[offsets]
    except UnicodeDecodeError:  # a text that is no UTF-8 has a sign of its own for what can't be read
        texts = [b[i:j].tobytes().decode(errors="replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def features(b: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, where each text's begin): for words, pairs of neighbours, and each length of run."""
    texts = len(offsets) - 1
    if not len(b):
        return
    points, offsets = _characters(b, offsets)
    n = len(points)
    codes, word = _codes()
    # one boundary sign before each text and one at the end, so that every word has both
    begin = offsets + np.arange(texts + 1)
    m = n + texts + 1
    c = np.full(m, 32, np.uint32)
    own = np.ones(m, bool)
    own[begin] = False
    c[own] = points
    solid = word[c]
    power, inverse = power_tables(m)
    sums = np.empty(m + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[c] * power[:m], out=sums[1:])
    shift = np.uint64(64 - BITS)
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    at = np.searchsorted(starts, begin)
    words = (sums[ends] - sums[starts]) * inverse[starts]
    yield (words * _SPREAD_BITS >> shift).astype(np.int32), at
    pairs = mix(words[:-1] * _PAIR + words[1:]) if len(words) else words
    inside = np.ones(len(starts), bool)
    inside[at[:-1][np.diff(at) > 0]] = False  # a text's first word has no neighbour before it
    pairs_at = np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - 1, 0))])
    yield (pairs >> shift).astype(np.int32)[inside[1:]], pairs_at
    # pairs of a word with itself are as many as words; what they share has a row after those of hashes, as have all others
    yield np.where(words[1:] == words[:-1], np.int32(1 << BITS), np.int32((1 << BITS) + 1))[inside[1:]], pairs_at
    for size in GRAMS:
        if m < size:
            return
        inner = solid[1 : m - size + 2].copy()
        for k in range(2, size - 1):
            inner &= solid[k : k + m - size + 1]
        h = sums[size:] - sums[:-size]
        h *= inverse[: m - size + 1]
        h *= _SPREAD_BITS
        h >>= shift
        runs = np.concatenate([[0], np.cumsum(inner, dtype=np.int64)])
        yield h.astype(np.int32)[inner], runs[np.minimum(begin, len(inner))]


@dataclass
class Model:
    """Each bucket's share in the log-odds of class 1, and the bias."""

    share: np.ndarray
    bias: float

    def scores(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of class 1; that of the bias alone for a text without words."""
        texts = len(offsets) - 1
        total, count = np.zeros(texts), np.zeros(texts, np.int64)
        for bucket, at in features(b, offsets):
            sums = np.concatenate([[0.0], np.cumsum(self.share[bucket], dtype=np.float64)])
            total += sums[at[1:]] - sums[at[:-1]]
            count += np.diff(at)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent on the labelled texts; without texts of both classes, their share is the score."""
    y = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(ROWS, np.float32), float(np.log(prior / (1 - prior))))
    rows = []
    for text in texts:
        _, b, offsets = next(text_chunks(pa.array([text]), lower=False))
        found = [bucket for bucket, _ in features(b, offsets)]
        bucket, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
        rows.append((bucket, (count / max(count.sum(), 1)).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.log(np.array([1 - prior, prior])).astype(np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, weight = rows[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = weight @ vectors[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * np.float32(0.1) * p
            vectors[bucket] -= (rate * np.float32(SPREAD) * weight)[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out() -> F.Column:
    """Whether a row's labels are never learned from: crc32 of the doc_id as text, modulo 4, is 2; not for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels (doc_id, quality) of ``docs`` (doc_id, text) that are not held out.

    SAMPLE_ROWS labelled doc_ids, those of the least hash, are taken at most, and of
    their texts SAMPLE_BYTES. Labels with a null doc_id or a quality other than 0 and 1
    are ignored; a doc_id with several labels counts as 1 if most of them are.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # in an order that does not hang on how the rows are dealt, so that a rerun gives the same model
    texts, marks, size = [], [], 0
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
        size += len(row.text.encode())
        if texts and size > SAMPLE_BYTES:
            break
        texts.append(row.text)
        marks.append(row.quality)
    return fit(texts, marks)


def _score(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.zeros(0)]
        for _, b, offsets in text_chunks(batch.column(batch.num_columns - 1), lower=False):
            out.append(model.scores(b, offsets))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "quality_score"])


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score double, from 0 to 1, of the whole text; a null text counts as empty.

    All columns stay, in order; one that is called quality_score already is replaced.
    Equal texts get equal scores. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_mapped(docs, F.col("text").cast("string"), lambda it: _score(sent.value, it), T.StructField("quality_score", T.DoubleType()))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that score at least ``threshold``; null and empty texts are scored as any other."""
    taken = next((c for c in docs.columns if c.lower() == "quality_score"), None)
    if taken is None:
        return with_score(docs, model).where(F.col("quality_score") >= threshold).drop("quality_score")
    name = free_name(docs, "score")
    kept = with_score(docs.withColumnRenamed(taken, name), model).where(F.col("quality_score") >= threshold)
    return kept.drop("quality_score").withColumnRenamed(name, taken)

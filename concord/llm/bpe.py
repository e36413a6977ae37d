"""Byte-pair encoding by speculation and verification, and decoding.

For words not met before, greedy longest match proposes tokens. Byte-pair merging
gives exactly these tokens if it would give each token from its own letters, and if
it would never merge across the border of any two neighbours; both are tested for
whole arrays of pairs at once. Only words in which a pair fails are merged step by
step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.pieces import RUN_BYTES, Coder, library, runs, to_letters
from concord.llm.shared import with_mapped
from concord.llm.words import row_runs

_NEVER = np.int64(1) << 40


class Merges:
    """A byte-pair vocabulary: its merges as arrays by token id, and the tokens that longest match may propose."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        size = max(self.vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self.rank[ids[:, 2]] = np.arange(len(ids))
        self.left[ids[:, 2]], self.right[ids[:, 2]] = ids[:, 0], ids[:, 1]
        self.rank_of = {(a, b): (r, c) for r, (a, b, c) in enumerate(ids.tolist())}
        self._rank_get = {p: r for p, (r, _) in self.rank_of.items()}.get
        self._made = ids[:, 2].tolist()
        keys = ids[:, 0] * size + ids[:, 1]
        order = np.argsort(keys)
        self._size, self._keys, self._ranks = size, keys[order], order.astype(np.int64)
        # A rank above those of both parts makes later merges the later ones in time; vocabularies learned by merging have that.
        grows = bool((self.rank[ids[:, 2]] > np.maximum(self.rank[ids[:, 0]], self.rank[ids[:, 1]])).all()) and len({*ids[:, 2].tolist()}) == len(ids)
        own = np.full(size, grows)
        if grows:
            made = ids[:, 2]
            good = self.compatible(ids[:, 0], ids[:, 1], np.arange(len(ids)))
            for t, a, b, ok in zip(made.tolist(), ids[:, 0].tolist(), ids[:, 1].tolist(), good.tolist(), strict=True):
                own[t] = ok and own[a] and own[b]
        inner = {s: i for s, i in self.vocab.items() if own[i]}
        self.last = {s[: len(s) - len(self.end)]: i for s, i in inner.items() if s.endswith(self.end) and len(s) > len(self.end)}
        self.inner = {s: i for s, i in inner.items() if not self.end or not s.endswith(self.end)}
        self.longest = max(map(len, {*self.last, *self.inner}), default=1)

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the border between tokens a and b alone, up to the merge of rank ``until``.

        The two tokens are taken apart from the last merge back to the first. Between
        two such steps, the pieces next to the border are x and y; a merge of them
        fires if it is due before the merge that used x in a (there the merge further
        left wins a tie) and not after the one that used y in b.
        """
        x, y = np.array(a), np.array(b)
        px = np.full(len(x), _NEVER) if until is None else np.array(until, np.int64)
        py = px.copy() - (until is not None)
        good = np.ones(len(x), bool)
        at = np.arange(len(x))
        while len(at):
            xs, ys = x[at], y[at]
            m = self._merge_rank(xs, ys)
            fires = (m < px[at]) & (m <= py[at]) & (m < _NEVER)
            good[at[fires]] = False
            rx, ry = self.rank[xs], self.rank[ys]
            more = ~fires & ((rx >= 0) | (ry >= 0))
            at, xs, ys, rx, ry = at[more], xs[more], ys[more], rx[more], ry[more]
            later = rx > ry
            i, j = at[later], at[~later]
            px[i], x[i] = rx[later], self.right[xs[later]]
            py[j], y[j] = ry[~later], self.left[ys[~later]]
        return good

    def propose(self, letters: str) -> list[int] | None:
        """Tokens by longest match from the left; None if it gets stuck."""
        out, at, n = [], 0, len(letters)
        last, inner, longest = self.last, self.inner, self.longest
        while True:
            rest = n - at
            if rest <= longest and (t := last.get(letters[at:])) is not None:
                out.append(t)
                return out
            for size in range(min(longest, rest - bool(self.end)), 0, -1):
                if (t := inner.get(letters[at : at + size])) is not None:
                    break
            else:
                return None
            out.append(t)
            at += size
            if at == n:
                return out

    def merge(self, letters: str) -> list[int]:
        """Tokens by merging, always the pair of least rank, of these the leftmost."""
        ids = [self.vocab[c] for c in letters[:-1]] + [self.vocab[letters[-1] + self.end]]
        return self._merge_short(ids) if len(ids) <= 64 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, made, never = self._rank_get, self._made, (1 << 40)
        ranks = [get(p, never) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < never:
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank_of = self.rank_of
        due = [(*rank_of[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank_of]
        due = [(r, i, c, p) for r, c, i, p in due]
        heapq.heapify(due)
        while due:
            _, i, c, (a, b) = heapq.heappop(due)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (p := (c, ids[after[i]])) in rank_of:
                    heapq.heappush(due, (rank_of[p][0], i, rank_of[p][1], p))
            if before[i] >= 0 and (p := (ids[before[i]], c)) in rank_of:
                heapq.heappush(due, (rank_of[p][0], before[i], rank_of[p][1], p))
        return [t for t in ids if t >= 0]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each piece."""
        letters = to_letters(pieces)
        found = [self.propose(x) for x in letters]
        sizes = np.array([len(f) if f else 0 for f in found])
        flat = np.fromiter((t for f in found if f for t in f), np.int64, sizes.sum())
        if len(flat) > 1:
            ends = np.cumsum(sizes)
            border = np.ones(len(flat), bool)
            border[ends[sizes > 0] - 1] = False
            at = np.flatnonzero(border)
            broken = at[~self.compatible(flat[at], flat[at + 1])]
            for k in np.unique(np.searchsorted(ends, broken, "right")).tolist():
                found[k] = None
        return [f if f else self.merge(x) for f, x in zip(found, letters, strict=True)]


@lru_cache
def _coder(path: str) -> Coder:
    merges = Merges(path)
    return Coder(path, lambda pieces: [np.array(ids, "<u4").tobytes() for ids in merges.encode(pieces)])


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Token ids of each whole text as little-endian 32-bit integers; none for null and empty texts."""
    coder = _coder(path)
    return [ids for run in runs([t or "" for t in texts]) for ids in coder(run)]


@lru_cache
def _names(path: str) -> list[str]:
    t = library(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]


def decode_ids(path: str, ids: bytes) -> str:
    """The text of token ids, special tokens included, as the library's decoder has it.

    A vocabulary without a decoder of its own gives its tokens' names, a blank between
    them; a byte-level one gives the bytes that its letters stand for.
    """
    names, decoder = _names(path), library(path).decoder
    tokens = [names[i] for i in np.frombuffer(ids, "<u4").tolist()]
    if decoder is None:
        return " ".join(tokens)
    return decoder.decode(tokens)


def _with_ids(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for first, count in row_runs(column, RUN_BYTES):
            run = column.slice(first, count).to_pylist()
            ids = encode_texts(path, run)
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            rows = [c.slice(first, len(run)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(pa.array(at), values)], [*batch.schema.names, "token_ids"])


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with token_ids array<int> of the whole text by the vocabulary file at ``path``.

    Ids are those of the tokenizers library with add_special_tokens=False; the string
    of a special token in a text is that token. Null and empty texts have an empty
    array. All columns stay; a column token_ids is replaced. Equal texts get equal
    ids; an empty table stays empty. Nothing is shuffled.
    """
    return with_mapped(docs, F.col("text").cast("string"), lambda it: _with_ids(path, it), T.StructField("token_ids", T.ArrayType(T.IntegerType())))


def _round_trip(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _with_ids(path, batches):
        lists = batch.column(2)
        ids, decoded = [], []
        values, at = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        for i in range(len(lists)):
            own = values[at[i] : at[i + 1]].tobytes()
            ids.append(hashlib.sha256(own).hexdigest())
            decoded.append(hashlib.sha256(decode_ids(path, own).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: its token_ids, decoded again, as digests.

    The ids are those of with_tokens(), little-endian and of 32 bits for the digest;
    the decoded text, in UTF-8, is that of decode_ids(). Ids are decoded in the task
    that made them, so they are not sent anywhere.
    """
    fed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fed.mapInArrow(lambda it: _round_trip(path, it), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

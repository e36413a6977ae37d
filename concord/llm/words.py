"""Words of whole texts as 64-bit hashes, for Arrow batches, in numpy.

A word is a maximal run of letters and digits of the lower-cased text. ASCII
letters and digits and every other non-ASCII character count as part of a word,
except the characters of General Punctuation (U+2000 to U+207F), the symbols
from U+0080 to U+00BF other than ª, µ, º, and the ideographic space, comma and
full stop. A word's hash is a polynomial over its bytes, mixed; prefix sums give
all words of a batch at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_lo:_hi] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of word hashes, and of its inverse, up to the n-th at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        both = []
        for base in (_P, _P_INV):
            steps = np.full(size, base)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if n > 4 * CHUNK_BYTES:
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def row_runs(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of a text column of about ``most`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ends):
        begun = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, begun + most, "right")), first + 1)
        yield first, last - first
        first = last


def text_chunks(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of texts in bytes) for runs of rows of about CHUNK_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # rows are copied a chunk at a time, not the whole of a batch
    for first, count in row_runs(column, CHUNK_BYTES):
        part = column.slice(first, count).fill_null("")
        part = (pc.utf8_lower(part) if lower else part).cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + count + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        yield first, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_bytes(b: np.ndarray) -> np.ndarray:
    word = _IS_WORD[b]
    if len(b) and b.max() >= 0x80:
        lead = np.flatnonzero(b == 0xC2)
        if len(lead):
            second = b[np.minimum(lead + 1, len(b) - 1)]
            out = lead[(second != 0xAA) & (second != 0xB5) & (second != 0xBA)]
            word[out] = False
            word[np.minimum(out + 1, len(b) - 1)] = False
        lead = np.flatnonzero((b == 0xE2) | (b == 0xE3))
        lead = lead[lead + 2 < len(b)]
        if len(lead):
            wide = ((b[lead] == 0xE2) & ((b[lead + 1] == 0x80) | (b[lead + 1] == 0x81))) | (
                (b[lead] == 0xE3) & (b[lead + 1] == 0x80) & (b[lead + 2] <= 0x82)
            )
            for k in range(3):
                word[lead[wide] + k] = False
    return word


def _unspaced(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where characters of scripts without blanks begin and end, and where punctuation of East Asian width begins.

    The scripts are Han, kana, bopomofo, Thai, Lao, Khmer and Myanmar.
    """
    lead = np.flatnonzero(b >= 0xE0)
    lead = lead[lead + 2 < len(b)]
    point = ((b[lead].astype(np.int32) & 15) << 12) | ((b[lead + 1].astype(np.int32) & 63) << 6) | (b[lead + 2] & 63)
    three = b[lead] < 0xF0
    inside = lambda *ranges: np.logical_or.reduce([(point >= low) & (point <= high) for low, high in ranges]) & three
    signs = inside((0x3001, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
    alone = inside((0x0E01, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)) & ~signs
    four = ~three & (b[lead] == 0xF0) & (b[lead + 1] >= 0xA0) & (b[lead + 1] <= 0xB3)
    return np.concatenate([lead[alone], lead[four]]), np.concatenate([lead[alone] + 3, lead[four] + 4]), lead[signs]


def word_hashes(b: np.ndarray, offsets: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts b[offsets[i]:offsets[i + 1]], and where each text's words begin.

    With ``apart``, each character of a script that is written without blanks is a word
    of its own, and punctuation of East Asian width belongs to none.
    """
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = _word_bytes(b)
    before = np.empty(n + 1, bool)  # whether the byte before belongs to the same text's word
    before[0] = False
    before[1:] = word
    before[offsets] = False
    if apart and b.max() >= 0xE0:
        first, end, signs = _unspaced(b)
        for k in range(3):
            word[signs + k] = False
        before[1:] &= word
        before[first] = before[end] = False
    starts = np.flatnonzero(word & ~before[:n])
    ends = np.flatnonzero(word & ~(np.append(word[1:], False) & before[1:])) + 1
    power, inverse = power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[b] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, and where each text's begin.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(at)
    full = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate([[0], np.cumsum(full)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    first = np.repeat(at[:-1] - out_at[:-1], full) + np.arange(out_at[-1])
    h = np.zeros(len(padded) - n, np.uint64)
    for k in range(n):
        h = h * _Q + padded[k : k + len(h)]
    out = mix(h)[first]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        x = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[at[i] : at[i + 1]]:
                x = x * _Q + w
        out[out_at[i]] = mix(np.array([x], np.uint64))[0]
    return out, out_at


def sequence_keys(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's sequence of words; equal sequences have equal keys."""
    counts = np.diff(at)
    place = np.arange(len(words)) - np.repeat(at[:-1], counts)
    power, _ = power_tables(int(counts.max(initial=0)) + 1)
    keys = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A99)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ salt) * power[place])])
        keys.append(mix((sums[at[1:]] - sums[at[:-1]]) + counts.astype(np.uint64) * salt))
    return keys[0], keys[1]


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as an Arrow column of bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def ragged_binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values[at[i]:at[i + 1]] as an Arrow column of bytes."""
    values = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer((np.asarray(at) * values.itemsize).astype(np.int64)), pa.py_buffer(values)]
    ).cast(pa.binary())

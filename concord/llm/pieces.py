"""Splitting of texts into the pieces that a byte-pair vocabulary encodes one by one.

Two patterns are known, those of the two JSON vocabularies. Texts of common Latin
characters are split by Python's ``re`` with the Unicode classes written out; any
other text, and one that holds a special token's string, goes through the library's
own normaliser and pre-tokeniser, so both ways give the same pieces.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of which texts are split here: Latin up to U+024F without those whose lower case lies elsewhere, and general punctuation that isn't white space.
_OWN = [
    c
    for c in map(chr, [*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)])
    if len(c.lower()) == 1 and (ord(c.lower()) < 0x250 or ord(c) >= 0x2010)
]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _OWN if unicodedata.category(c)[0] == kind)


_L, _N = _class("L"), _class("N")
_FOREIGN = re.compile(f"[^{''.join(re.escape(c) for c in _OWN)}]")
#: Words, single digits and runs of other characters of a lower-cased text; white space goes.
WORD_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: The same with a blank before them, and white space.
BYTE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: White space other than blanks, and a blank within a run of white space or at the end of one that ends the text: no piece begins at it.
_WHITE = [c for c in _OWN if c.isspace() and c != " "]
_WITHIN_WHITE = re.compile(r" (?<=\s )(?=\s|\Z)")


@lru_cache
def byte_letters() -> tuple[str, ...]:
    """The letter that stands for each byte: itself where it prints, else one from U+0100 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return tuple(chr(b) if b in prints else chr(next(hidden)) for b in range(256))


@lru_cache
def _code_points() -> np.ndarray:
    points = np.array([ord(c) for c in byte_letters()], "<u2")
    points[0xFF] = 10  # no byte of UTF-8; stands between pieces
    return points


@lru_cache
def _bytes_table() -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(byte_letters())}


def to_letters(pieces: list[str]) -> list[str]:
    """Each piece's bytes in UTF-8, each as its letter; no letter is a line end."""
    if not pieces:
        return []
    data = np.frombuffer(b"\xff".join([p.encode() for p in pieces]), np.uint8)
    return _code_points()[data].tobytes().decode("utf-16-le").split("\n")


@lru_cache
def _lines_points() -> np.ndarray:
    points = _code_points().copy()
    points[10] = 10
    return points


def letters_of(data: np.ndarray) -> str:
    """The letters of bytes in UTF-8; line ends stay."""
    return _lines_points()[data].tobytes().decode("utf-16-le")


def from_letters(letters: str) -> str:
    return letters.translate(_bytes_table()).encode("latin1").decode("utf-8", "replace")


@lru_cache
def library(path: str):
    """The tokenizer of a JSON file; one thread, as Spark runs a task on each core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Pieces of a text as the vocabulary at ``path`` has them; a special token's string is a piece of its own."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.lower = self.tokenizer.normalizer is not None
        self.pattern = WORD_PATTERN if self.lower else BYTE_PATTERN
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._sign = os.path.commonprefix([*self.special]) if self.special else None

    def pieces(self, text: str) -> list[str]:
        """All pieces of a text."""
        if self._sign and self._sign in text:
            return [p for part in self._apart.split(text) for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def is_whole(self, text: str) -> bool:
        """Whether a text has to be split as a whole, as a piece may cross a blank.

        Where blanks are kept, a piece begins at each one that doesn't stand within or at the
        text's end after other white space, so what stands between blanks, a unit, and the
        blank before it have the same pieces in any text. Texts with such a blank, or two
        in a row, are split as a whole, as are those with other than common Latin characters.
        """
        if self._sign and self._sign in text or _FOREIGN.search(text):
            return True
        return not self.lower and ("  " in text or any(c in text for c in _WHITE) and _WITHIN_WHITE.search(text) is not None)

    def _plain(self, text: str) -> list[str]:
        if _FOREIGN.search(text):
            if self.lower:
                text = self.tokenizer.normalizer.normalize_str(text)
            return [from_letters(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text.lower() if self.lower else text)


class Cached:
    """Encoded pieces or units, as bytes; forgets all beyond ``most`` of them, which costs time and changes nothing."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int):
        self.encode, self.most = encode, most
        self.known: dict[str, bytes] = {}

    def of(self, different: list[str]) -> list[bytes]:
        """The bytes of pieces that are all different."""
        if len(self.known) > self.most:
            self.known.clear()
        found = list(map(self.known.get, different))
        new = [p for p, x in zip(different, found, strict=True) if x is None]
        if new:
            made = self.encode(new)
            self.known.update(zip(new, made, strict=True))
            made = iter(made)
            found = [next(made) if x is None else x for x in found]
        return found

    def __call__(self, texts: list[list[str]], joined: bool = True) -> list:
        """The bytes of each text's pieces, as one or, if not ``joined``, as a list."""
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        if new:
            self.known.update(zip(new, self.encode(new), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) if joined else list(map(get, pieces)) for pieces in texts]


class Coder:
    """Encodes whole texts, units and pieces by way of what was encoded before; ``encode`` gives the ids of new pieces.

    ``encode_units``, if given, does so for the pieces of many units without white space at
    once: it gets them in order, with a line end as a piece of its own between two units.
    """

    def __init__(self, path: str, encode: Callable[[list[str]], list[bytes]], encode_units: Callable[[list[str]], list[bytes]] | None = None, most: int = 700_000):
        self.split = Splitter(path)
        self._encode_units = encode_units
        self._pieces = Cached(self._with_special(encode), most // 2)
        self._units = Cached(self._unit_ids, most)

    def _with_special(self, encode):
        special = {s: i.to_bytes(4, "little") for s, i in self.split.special.items()}

        def run(pieces: list[str]) -> list[bytes]:
            plain = [p for p in pieces if p not in special]
            ids = dict(zip(plain, encode(plain), strict=True))
            return [ids[p] if p in ids else special[p] for p in pieces]

        return run

    def _unit_ids(self, units: list[str]) -> list[bytes]:
        find = self.split.pattern.findall
        if self._encode_units:
            # units without white space, which does not print, are split in one go: a line end between two is a piece of its own
            plain = [u for u in units if u and u.isprintable()]
            ids = dict(zip(plain, self._encode_units(find(" " + "\n ".join(plain))) if plain else (), strict=True))
            if len(plain) < len(units):
                rest = [u for u in units if u not in ids]
                ids.update(zip(rest, self._pieces([find(" " + u) for u in rest]), strict=True))
            return list(map(ids.__getitem__, units))
        blank = "" if self.split.lower else " "
        found = [find(blank + u) for u in units]
        # most units are one piece
        one = self._pieces([[p[0] for p in found if len(p) == 1]], joined=False)[0]
        more = iter(self._pieces([p for p in found if len(p) != 1]))
        one = iter(one)
        return [next(one) if len(p) == 1 else next(more) for p in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers."""
        whole = [self.split.is_whole(t) for t in texts]
        hard = iter(self._pieces([self.split.pieces(t) for t, w in zip(texts, whole, strict=True) if w]))
        easy = iter(self._by_units([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [next(hard) if w else next(easy) for w in whole]

    def _by_units(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by their units: each different one is looked up once, then all are put together by number."""
        if not texts:
            return []
        heads: list[bytes] = []
        if self.split.lower:
            units = [t.lower().split() for t in texts]
            at = np.cumsum([0, *map(len, units)])
            values = pa.array(chain.from_iterable(units), pa.string())
        else:
            units = pc.split_pattern(pa.array(texts, pa.string()), " ")
            at, values = units.offsets.to_numpy(), units.values
            # a text's first unit has no blank before it
            heads = self._pieces([self.split.pattern.findall(t.partition(" ")[0]) for t in texts])
        coded = values.dictionary_encode()
        known = self._units.of(coded.dictionary.to_pylist())
        number = coded.indices.to_numpy().copy()
        if heads:
            number[at[:-1]] = len(known) + np.arange(len(texts))
        table = known + heads
        sizes = np.array([len(x) // 4 for x in table] or [0], np.int32)
        ids, starts = np.frombuffer(b"".join(table), "<u4"), np.cumsum(sizes, dtype=np.int64) - sizes
        own = sizes[number]
        ends = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        place = np.repeat((starts[number] - ends[:-1]).astype(np.int32), own)
        place += np.arange(len(place), dtype=np.int32)
        data, at = ids[place].tobytes(), (4 * ends[at]).tolist()
        return [data[i:j] for i, j in zip(at, at[1:])]


#: Text that is encoded at a time.
RUN_BYTES = 1 << 21


def runs(texts: list[str], most: int = RUN_BYTES) -> Iterable[list[str]]:
    """The texts in order, about ``most`` characters at a time."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run

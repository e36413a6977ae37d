import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concord.llm import bpe, pieces, token_table

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
HARD = ["", " ", "a", "Hello, World!", "it's we'll I'D", "x  y   z \n\n w", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "<|endoftext", "naïve ÉCOLE ß ŒUVRE", "İstanbul Σίσυφος ΣΑΣ", "你好，世界 123 ４５", "a\x1cb\x85c\xa0d", "éa", "Å ﬁ", "😀👍🏽", "aaaa" * 50, "th" * 400, "퟿", "1234 ²³ ½", "tab\tsep\r\n", "“quoted” — dash…"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_and_text_are_the_librarys(path):
    r = random.Random(0)
    texts = HARD + ["".join(r.choice(HARD) for _ in range(r.randint(1, 4))) for _ in range(200)]
    tokenizer = Tokenizer.from_file(path)
    for text, ids in zip(texts, bpe.encode_texts(path, texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert bpe.decode_ids(path, ids) == tokenizer.decode(want, skip_special_tokens=False), text


def test_the_librarys_own_ids_by_pieces():
    tokenizer = Tokenizer.from_file(BYTE)
    for text, ids in zip(HARD * 2, token_table.library_ids(BYTE, HARD * 2), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_blanks_between_other_white_space_are_split_as_by_the_library():
    r = random.Random(1)
    texts = ["a \u00a0 \u00a0 b", "end \u00a0 \u00a0", "x\n \ny", "x\n ", " \n x", "\t a\r\n b"]
    texts += ["".join(r.choice((" ", " ", "\n", "\t", "\r", "\x85", "\xa0", "a", "1", ".")) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    tokenizer = pieces.library(BYTE)
    for text, ids, same in zip(texts, bpe.encode_texts(BYTE, texts), token_table.library_ids(BYTE, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == same.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_encoded_as_by_the_library(text):
    tokenizer = pieces.library(WORD)
    assert np.frombuffer(bpe.encode_texts(WORD, [text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_character_that_is_split_here_is_split_as_by_the_library():
    for path in (WORD, BYTE):
        tokenizer = pieces.library(path)
        texts = [f"a{c}b {c}{c} {c}1" for c in pieces._OWN]
        for text, ids in zip(texts, bpe.encode_texts(path, texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_verified_proposals_are_what_merging_gives():
    merges = bpe.Merges(WORD)
    r = random.Random(3)
    names = [n for n in merges.vocab if n.endswith("</w>")]
    words = ["".join(r.choice(names).removesuffix("</w>") for _ in range(r.randint(1, 4))) for _ in range(3000)]
    words = [w for w in words if w.isascii() and w]
    assert merges.encode(words) == [merges.merge(w) for w in words]
    assert sum(merges.propose(w) == merges.merge(w) for w in words) > len(words) // 10


def test_long_and_short_merging_agree():
    merges = bpe.Merges(WORD)
    for word in ("abcabcabc", "aaaaaaa", "thethethe", "z"):
        ids = [merges.vocab[c] for c in word[:-1]] + [merges.vocab[word[-1] + "</w>"]]
        assert merges._merge_short(list(ids)) == merges._merge_long(list(ids))


def test_tables(table):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, None, None), (2, "", "y"), (3, "very " * 30_000, None)]
    df = bpe.with_tokens(table(rows, "doc_id long, text string, token_ids string"), WORD)
    assert df.columns == ["doc_id", "text", "token_ids"] and df.count() == 5
    tokenizer = pieces.library(WORD)
    for r in df.collect():
        assert r.token_ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids
    for r in bpe.round_trip(table(rows, "doc_id long, text string, token_ids string"), WORD).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.with_tokens(table([], "doc_id long, text string"), WORD).count() == 0

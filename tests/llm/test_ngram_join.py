import random
import re

import numpy as np
import pytest

from concord.llm import components, ngram_join

DOCS = "doc_id long, text string, node string"


def _brute(rows, n=5, threshold=0.8):
    """doc_id to (class_id, n_links) by all pairs, for distinct ids."""
    grams, words = {}, {}
    for i, t, _ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        words[i] = tuple(w)
        grams[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids, root, links = list(grams), {i: i for i in grams}, dict.fromkeys(grams, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(grams[a] & grams[b])
            if grams[a] and common >= threshold * (len(grams[a]) + len(grams[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def _corpus(seed, groups=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(groups):
        base = [word() for _ in range(r.choice((1, 3, 4, 5, 8, 40, 120)))] + (passage if r.random() < 0.4 else [])
        for _ in range(r.choice((1, 1, 2, 4, 9))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) * 3 + 7, r.choice((" ", ", ", "\n ")).join(w).title(), "clash"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_and_links_are_those_of_brute_force(table, seed):
    rows = _corpus(seed)
    got = ngram_join.ngram_classes(table(rows, DOCS)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == _brute(rows) and len(got) == len(rows)


@pytest.mark.parametrize("grams", [1 << 20, 200])
def test_blocks_of_large_groups_give_the_same(table, monkeypatch, grams):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    rows = _corpus(5, 12)
    got = ngram_join.ngram_classes(table(rows, DOCS)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == _brute(rows)


def test_texts_of_one_first_key_are_told_apart_by_the_second(table):
    rows = _corpus(6, 10)
    docs = table(rows, DOCS).select("doc_id", "text")
    got = ngram_join._classified(docs, 5, 0.8, 0.999, bits=4).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == _brute(rows)


def test_null_doc_ids_do_not_meet_each_other(table):
    rows = [(None, f"text {i} has words of its own {i} {i * i}", "x") for i in range(150)] + [(None, "the same words again and again", "x")] * 50
    got = ngram_join.ngram_classes(table(rows, DOCS)).collect()
    assert len(got) == 200 and sorted(r.n_links for r in got) == [0] * 150 + [49] * 50
    assert ngram_join.drop_near_duplicates(table(rows, DOCS)).count() == 151


def test_a_group_of_many_near_copies_is_shuffled_a_few_times(table, monkeypatch):
    """Blocks are compared in pairs, but their sets are moved once: rows handed to the tasks of pairs hold no sets."""
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(4):
            w[r.randrange(300)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(w), None))
    handed = []
    docs = table(rows, DOCS).select("doc_id", "text")
    seen = ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, purpose: handed.append((purpose, seen(df, purpose))) or handed[-1][1])
    got = ngram_join.ngram_classes(docs).collect()
    assert {x.class_id for x in got} == {0} and len(got) == 1500
    tables = dict(handed)
    stored = tables["within"].where("block IS NOT NULL")
    assert stored.count() >= 20 and stored.where(f"data IS NOT NULL AND size > {ngram_join.INLINE}").count() == 0
    sizes = stored.agg({"size": "sum"}).first()[0]
    assert sizes < 1500 * (296 * 8 + 32) * 1.1  # each set once
    grams = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t, _ in rows]
    for i in (0, 700, 1499):
        want = sum(len(grams[i] & g) >= 0.8 * len(grams[i] | g) for k, g in enumerate(grams) if k != i)
        assert next(x.n_links for x in got if x.doc_id == i) == want


def test_nulls_empties_and_repeats(table):
    text = "one two three four five six"
    rows = [(1, None, None), (2, "", None), (3, " .,!", None), (4, text, None), (4, text, None), (5, text.upper(), None), (None, text, None), (6, "hi", None), (7, "Hi!", None), (8, "word " * 50_000, None), (None, None, None)]
    got = ngram_join.ngram_classes(table(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.class_id, r.class_size, r.n_links))
    assert by[1] == {(1, 1, 0)} and by[2] == {(2, 1, 0)} and by[3] == {(3, 1, 0)}
    assert by[4] == by[5] == {(4, 4, 3)} and by[None] == {(4, 4, 3), (None, 1, 0)}
    assert by[6] == by[7] == {(6, 2, 1)} and by[8] == {(8, 1, 0)}
    kept = ngram_join.drop_near_duplicates(table(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "None"]
    assert ngram_join.ngram_classes(table([], DOCS)).count() == 0 and ngram_join.drop_near_duplicates(table([], DOCS)).count() == 0


def test_a_doc_id_of_two_classes_keeps_a_row_of_each(table):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(3, near, "a"), (5, near + " end", "b"), (5, "something else that is nowhere but here", "c"), (6, near, "d"), (7, " .", "e"), (7, " .", "f"), (8, "eight is here twice as it is", "g"), (8, "Eight is here twice as it is", "h")]
    kept = ngram_join.drop_near_duplicates(table(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(r.node for r in kept.collect()) == ["a", "c", "e", "f", "h"]


def test_columns_of_any_name_stay(table):
    text = "a b c d e f g"
    schema = "doc_id long, text string, key string, twin string, node string, __row string, _row string, __own_id string, __other_id string, `a.b` string"
    rows = [(1, text, *"ABCDEFGH"), (1, text, *"ABCDEFGH"), (2, text.upper(), *"ABCDEFGH"), (None, text, *"ABCDEFGH")]
    kept = ngram_join.drop_near_duplicates(table(rows, schema))
    assert kept.columns == table([], schema).columns and [tuple(r) for r in kept.collect()] == [rows[0]]


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        b, r = ngram_join.choose_bands(s, recall)
        assert 1 - (1 - s**r) ** b >= recall and b * r <= 256
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.999999, 4)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    both, one, two = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (800, 100, 100))
    values = np.concatenate([both, one, both, two])
    m = ngram_join.minhashes(values, np.array([0, 900, 1800, 1800]), 256)
    assert abs((m[0] == m[1]).mean() - 0.8) < 0.1 and (m[2] == 0xFFFFFFFF).all()


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 6000, rng.integers(1, 900), dtype=np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:9]]
    assert ngram_join.common(sets[:9], sets[4:]).tolist() == want
    one = sets[:9]
    assert ngram_join.common(one, one).tolist() == [[len(np.intersect1d(a, b)) for b in one] for a in one]
    assert ngram_join.common(sets[:2], sets[2:4]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:4]] for a in sets[:2]]


def test_components(table):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (300, 301), (301, 300)] + [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if None not in (a, b) and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components.connected_components(table(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.connected_components(table([], "u long, v long")).count() == 0

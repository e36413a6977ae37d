import itertools
import random
import re

import pytest

from concord.llm import decontamination as d

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def test_masks_find_every_window():
    for lost in itertools.combinations(range(d.WINDOW), d.LOSS):
        assert any(all(p + i not in lost for i, c in enumerate(m) if c == "1") for m in d.SEEDS for p in range(d.WINDOW - len(m) + 1)), lost


def _words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _brute(docs, items):
    """Pairs of which some window agrees, by all alignments."""
    out = set()
    for (i, t, _), (j, u, _) in itertools.product(docs, items):
        a, b = _words(t), _words(u)
        size = min(d.WINDOW, len(b))
        if len(b) < d.SHORTEST:
            continue
        need = size - d.LOSS if len(b) >= d.WINDOW else size
        if any(sum(x == y for x, y in zip(a[p : p + size], b[q : q + size], strict=True)) >= need for p in range(len(a) - size + 1) for q in range(len(b) - size + 1)):
            out.add((i, j))
    return out


def test_pairs_are_those_of_brute_force(table):
    r = random.Random(1)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("rstn")
    items = [(k, " ".join(word() for _ in range(n)), "x") for k, n in enumerate((3, 5, 9, 13, 14, 20, 40, 13, 12, 30))] + [(90, None, None), (91, "", None)]
    docs = []
    for i in range(150):
        text = [word() for _ in range(r.randint(0, 60))]
        if i % 2:
            own = _words(r.choice(items[:10])[1])
            low = r.randint(0, max(0, len(own) - 13)) if r.random() < 0.5 else 0
            own = own[low:]
            for _ in range(r.choice((0, 0, 1, 2, 3, 4))):
                own[r.randrange(len(own))] = word()
            at = r.randint(0, len(text))
            text[at:at] = own
        docs.append((i, r.choice((" ", ", ", "\n")).join(text).upper() if i % 3 else " ".join(text), "clash"))
    docs += [(900, None, None), (901, "", None), (902, items[5][1] + " " + " ".join(word() for _ in range(60_000)), None), (903, items[5][1], None), (903, items[5][1], None)]
    got = d.overlaps(table(docs, DOCS).repartition(3), table(items, ITEMS))
    rows = got.collect()
    assert {(x.doc_id, x.item_id) for x in rows} == _brute(docs, items)
    assert len(rows) == len({(x.doc_id, x.item_id) for x in rows})
    assert all(x.matched >= min(x.window, d.WINDOW) - d.LOSS for x in rows)


def _mixed(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice("aeiou") + r.choice("rst") for _ in range(n))
    items = [(k, text(r.choice((5, 9, 12, 13, 20, 60))), None) for k in range(12)] + [(3, text(20), None), (None, text(15), None), (50, None, None), (51, "too short", None)]
    docs = []
    for k in range(80):
        own = (items[k % 14][1] if k % 4 else text(20)).split()
        if k % 3 == 0:
            own[r.randrange(len(own))] = "other"
        docs.append((k % 70 if k % 9 else None, " ".join([text(5), *own, text(r.choice((0, 3, 40)))]), None))
    return docs + [(91, "", None), (92, None, None), (93, " ".join(i[1] for i in items[:12]) * 3, None)], items


@pytest.mark.parametrize("short_loss", [False, True])
def test_a_large_benchmark_is_joined_by_hash_with_the_same_rows(spark, table, monkeypatch, short_loss):
    docs, items = _mixed(2)
    docs, items = table(docs, DOCS).repartition(3), table(items, ITEMS).repartition(2)
    one = sorted(map(tuple, d.overlaps(docs, items, short_loss).collect()), key=str)
    monkeypatch.setattr(d, "BLOCK_WORDS", 50)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = d.overlaps(docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string"), items, short_loss)
    assert sorted(map(tuple, got.collect()), key=str) == one and len(one) > 50
    assert read.value == docs.count()  # the documents are read once, whatever the benchmark's size


def test_all_rows_of_a_doc_id_go_with_a_leak(table):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = table([(1, item, "a"), (1, "something else", "b"), (None, item, "c"), (2, None, "d")], "doc_id long, text string, __leak string")
    left = d.decontaminate(docs, table([(0, item, None)], ITEMS))
    assert left.columns == docs.columns and sorted(r["__leak"] for r in left.collect()) == ["c", "d"]


def test_leaks_go_and_all_else_stays(table):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = table([(1, f"so {item} it goes", "q"), (2, "one two three", "q"), (None, "x", "q"), (3, None, "q")], "doc_id long, text string, matched string")
    left = d.decontaminate(docs, table([(0, item, None)], ITEMS))
    assert left.columns == ["doc_id", "text", "matched"] and {r.doc_id for r in left.collect()} == {2, None, 3}
    assert d.decontaminate(docs, table([], ITEMS)).count() == 4
    assert d.overlaps(table([], DOCS), table([(0, item, None)], ITEMS)).count() == 0


def test_short_items_lose_a_word_in_proportion(table):
    for size in range(d.SHORTEST, d.WINDOW):
        masks = d.masks_of(size, True)
        assert all(any(m[i] == "0" for m in masks) for i in range(size)) or not d.loss_of(size, True)
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n)), None) for n in (4, 5, 6, 7, 9, 12)]
    docs = []
    for n, text, _ in items:
        for lost in range(3):
            for at in range(n):
                own = text.split()
                for k in range(lost):
                    own[(at + k * 2) % n] = "other"
                docs.append((n * 1000 + lost * 100 + at, "so " + " ".join(own) + " it goes", None))
    found = {(x.doc_id, x.item_id) for x in d.overlaps(table(docs, DOCS), table(items, ITEMS), short_loss=True).collect()}
    most = {5: 0, 6: 0, 7: 1, 9: 1, 12: 1}
    assert found == {(i, i // 1000) for i, _, _ in docs if i // 1000 in most and i % 1000 // 100 <= most[i // 1000]}


def test_scripts_without_blanks_are_words_by_character(table):
    item, thai = "水的沸点在标准大气压下是多少度？", "น้ำเดือดที่อุณหภูมิเท่าไร"
    docs = [(1, f"问题：{item}答案是一百度。", None), (2, "问题：水的沸点在正常大气压下是多少度呢", None), (3, "今天天气很好，我们去公园散步吧。", None), (4, f"ถามว่า{thai}ครับ", None), (5, "東京タワーの高さは？三百三十三メートル", None)]
    items = [(0, item, None), (1, thai, None), (2, "東京タワーの高さは？", None), (3, "水的沸点", None)]
    found = {(x.doc_id, x.item_id) for x in d.overlaps(table(docs, DOCS), table(items, ITEMS), short_loss=True).collect()}
    assert found == {(1, 0), (2, 0), (4, 1), (5, 2)}

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from concord.llm import html_text, ngram_join, quality
from concord.llm import queries as llm_queries
from concord.llm.words import sequence_keys, shingles, text_chunks, word_hashes


def _text(r, good):
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 80))]
    return " ".join(w if good else w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(0)
    rows = [(i, _text(r, i % 4 > 0), int(i % 4 > 0)) for i in range(400)]
    return rows


def _tables(table, rows):
    return table([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, quality_score string"), table([(i, y, None) for i, _, y in rows] + [(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_judged_rightly_and_never_learned_from(table, labelled):
    docs, labels = _tables(table, labelled)
    model = quality.train(docs, labels)
    scored = quality.with_score(docs, model)
    assert scored.columns == ["doc_id", "text", "quality_score"]
    y = {i: q for i, _, q in labelled}
    out = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in out.items())
    held = [r for r in scored.collect() if out[r.doc_id]]
    assert len(held) > 50 and np.mean([(r.quality_score >= 0.7) == y[r.doc_id] for r in held]) > 0.95
    turned = table([(i, 1 - q if out[i] else q, 0) for i, _, q in labelled], "doc_id long, quality int, toxic int")
    assert (quality.train(docs, turned).share == model.share).all()


def test_any_text_has_a_score(table, labelled):
    docs, labels = _tables(table, labelled)
    model = quality.train(docs, labels)
    odd = table([(1, None, "a"), (2, "", "a"), (None, "x", "a"), (3, " \n ", "a"), (4, "long " * 200_000, "a"), (5, "x", "a")], "doc_id long, text string, __scored_ string")
    got = {r.doc_id: r.quality_score for r in quality.with_score(odd, model).collect()}
    assert got[1] == got[2] == got[3] and got[None] == got[5] and all(0 <= s <= 1 for s in got.values())
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.with_score(odd.limit(0), model).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert {round(r.quality_score, 3) > 0.9 for r in quality.with_score(odd, one).collect()} == {True}
    none = quality.train(docs, labels.limit(0))
    assert quality.with_score(odd, none).first().quality_score == 0.5


def test_scores_are_means_over_all_features():
    r = random.Random(1)
    texts = ["", "one", "Çá va bien\u00a0là 漢字 😀😀 va va", *(_text(r, k % 2) for k in range(30)), "tail"]
    model = quality.Model(np.random.default_rng(0).normal(size=quality.ROWS).astype(np.float32), 0.3)
    _, b, offsets = next(text_chunks(pa.array(texts), lower=False))
    got = model.scores(b, offsets)
    for t, s in zip(texts, got, strict=True):
        _, b1, o1 = next(text_chunks(pa.array([t]), lower=False))
        found = [x for bucket, _ in quality.features(b1, o1) for x in bucket]
        z = (np.mean(model.share[found]) if found else 0) + 0.3
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
        names = ("words", "pairs", "again", "three", "four")
        counts = {k: len(x) for k, (x, _) in zip(names, quality.features(b1, o1), strict=False)}
        w = t.split()
        assert not w or counts == dict(zip(names, (len(w), len(w) - 1, len(w) - 1, sum(map(len, w)), sum(len(x) - 1 for x in w)), strict=True))


def test_pairs_of_words_and_runs_of_characters_are_hashed():
    def buckets(text):
        _, b, offsets = next(text_chunks(pa.array([text]), lower=False))
        return [x.tolist() for x, _ in quality.features(b, offsets)]

    one, other = buckets("red house red house"), buckets("house red house red")
    assert one[1] == [other[1][1], other[1][0], other[1][1]] and len(set(one[1])) == 2  # pairs have an order
    assert len({x for t in ("aé b", "aè b", "aê b") for x in buckets(t)[3]}) == 7  # a run never cuts a character: " aé", "aé ", ..., " b "
    assert buckets("a a b")[2] == [1 << quality.BITS, (1 << quality.BITS) + 1] and max(map(max, one)) < quality.ROWS


def test_bytes_that_are_no_text_have_a_score():
    b = np.frombuffer(b"ab\xff\xfe cd" + b"plain", np.uint8)
    model = quality.Model(np.ones(quality.ROWS, np.float32), 0.0)
    assert np.allclose(model.scores(b, np.array([0, 7, 12])), 1 / (1 + np.exp(-1)))


def test_columns_of_any_name_stay(table, labelled):
    """The operators' own names give way to those of a table."""
    import public_tokenizers

    from concord.llm import bpe, sharding

    model = quality.train(*_tables(table, labelled))
    docs = table([(1, "a text", "u", "v", "w", "x", "y")], "doc_id long, text string, __text_in string, __slot string, slot string, Quality_Score string, `a.b` string")
    scored = quality.with_score(docs.drop("Quality_Score"), model)
    assert scored.columns == [*docs.drop("Quality_Score").columns, "quality_score"] and scored.first()["__text_in"] == "u"
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns and quality.keep_good(docs, model, 0.0).first()["Quality_Score"] == "x"
    encoded = bpe.with_tokens(docs, public_tokenizers.path(llm_queries.WORD_BPE))
    assert encoded.columns == [*docs.columns, "token_ids"] and encoded.first()["__text_in"] == "u"
    placed = sharding.with_shard(docs, "slot")
    assert placed.columns == [*(c for c in docs.columns if c != "slot"), "slot", "shard"] and placed.first()["__slot"] == "v"
    want = sharding.with_shard(docs.select(docs["slot"].alias("k")), "k").first()
    assert (placed.first()["slot"], placed.first()["shard"]) == (want["slot"], want["shard"])


def test_words_and_shingles():
    texts = ["", None, "The THE, thé", "a b c d e f", "a b c", "x" * 5_000_000 + " end", "“a” b—c d e f!"]
    rows = []
    for _, b, offsets in text_chunks(pa.array(texts)):
        w, at = word_hashes(b, offsets)
        g, g_at = shingles(w, at, 5)
        keys = sequence_keys(w, at)[0]
        rows += [(w[i:j].tolist(), g[k:m].tolist(), q) for i, j, k, m, q in zip(at, at[1:], g_at, g_at[1:], keys.tolist())]
    assert [len(r[0]) for r in rows] == [0, 0, 3, 6, 3, 2, 6] and [len(r[1]) for r in rows] == [0, 0, 1, 2, 1, 1, 2]
    assert rows[2][0][0] == rows[2][0][1] != rows[2][0][2] and rows[3] == rows[6] and rows[4][0] == rows[3][0][:3]


def test_stages_are_those_of_brute_force(spark, sf):
    """Each stage on what the one before kept, compared with plain Python."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "encoding"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, docs, sf)
        assert now.columns == docs.columns
        docs = spark.createDataFrame(now.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    score = {r.doc_id: r.predicted for r in llm_queries.op10_quality(spark, sf).collect()}
    assert set(kept[0]) == {i for i, p in score.items() if p == 1}
    grams = {}
    for i, t in kept[0].items():
        w = re.findall(r"[^\W_]+", t.lower())
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    classes = {i: i for i in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                low, high = sorted((classes[a], classes[b]))
                classes = {k: low if c == high else c for k, c in classes.items()}
    assert set(kept[1]) == set(classes.values())
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)}
    leaked = {i for i, t in kept[1].items() if any(tuple(w[k : k + 13]) in runs for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - 12))}
    assert leaked and not leaked & set(kept[2]) and len(set(kept[1]) - leaked - set(kept[2])) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == len(kept[2]) and {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(kept[2])


def test_stages_with_nulls_repeats_and_empty_tables(spark, table, sf, tmp_path):
    schema = "doc_id long, text string, lang string, __leak string"
    rows = [(1, None, "en", "a"), (2, "", None, "b"), (None, "a short text", "en", None), (None, "a short text", "en", None), (3, "word " * 30_000, "en", "c"), (3, "word " * 30_000, "en", "d")]
    for docs in (table(rows, schema), table([], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= n and (name == "encoding" or out.columns == docs.columns), name


def test_queries_are_registered_and_have_their_columns(spark, sf):
    columns = {
        "op1_sharding": {"doc_id", "slot", "shard"},
        "op2_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op3_decontamination": {"doc_id", "item_id", "matched", "window", "doc_word", "item_word", "agreeing"},
        "op4_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op5_html_text": {"page_id", "url", "text", "n_chars"},
        "op6_token_table": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op7_url_filter": {"page_id", "host", "path", "rule", "verdict"},
        "op8_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op9_ngram_join": {"doc_id", "class_id", "class_size", "n_links"},
        "op10_quality": {"doc_id", "held_out", "score", "predicted"},
    }
    found = __spark_entry__.queries()
    assert set(columns) | {"pipeline"} <= set(found)
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op1_sharding", "op2_warc", "op4_bpe", "op5_html_text", "op6_token_table", "op7_url_filter", "op8_media", "op10_quality"):
        df = found[name](spark, sf)
        assert set(df.columns) == columns[name]
        assert df.count() == rows["pages" if "page_id" in df.columns else "documents"], name


@pytest.mark.parametrize("name", ["op1_sharding", "op2_warc", "op7_url_filter"])
def test_sql_gives_the_same_rows(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm_queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({llm_queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_a_cluster_needs_a_shared_folder_and_tables_of_it_can_go(spark, table):
    from types import SimpleNamespace

    from concord.llm import shared

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context), "x")
    made = shared.cut(table([(1,)], "a long"), "some")
    shared.remove(made, table([(1,)], "a long"))  # a table that is not of cut() is left alone
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(made.written)


def test_nothing_outside_names_this_package():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent
    for p in (root / "concord").rglob("*.py"):
        if "llm" not in p.parts:
            assert "concord.llm" not in p.read_text()
    assert ngram_join.BLOCK > 1 and html_text.PAGES > 1

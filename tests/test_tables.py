import decimal
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from concord.functions import steps as st
from concord.functions.labels import label_to_int
from concord.operators import checks, masking, resume


def test_labels(spark):
    cases = {"1": 1, '"1"': 1, '" 1 "': 1, "true": 1, "false": 0, "0.9": 0, "-1.9": -1, '"0.9"': None, '"x"': None, "[1]": None, '{"a":1}': None, "1e2": 100, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", label_to_int(F.col("raw")).alias("label"))
    assert {r.raw: r.label for r in df.collect()} == cases


def test_record_hash_and_its_range(spark):
    rows = [(f"text {i}", i % 2) for i in range(50)] + [(None, None)]
    df = resume.record_hash(spark.createDataFrame(rows, "text string, label long"), ["text", "label"])
    for r in df.collect():
        key = f"{r.text or ''}\n{'' if r.label is None else r.label}"
        assert r.record_hash == decimal.Decimal(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little"))
    assert df.agg(F.max("record_hash")).first()[0] > 2**63
    assert resume.record_hash(df.limit(0), ["text"]).count() == 0


def test_resuming_twice_is_resuming_once(spark):
    inputs = spark.createDataFrame([(i,) for i in range(10)], "k long")
    done = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    left = resume.remaining(inputs, done, ["k"])
    assert left.count() == 8
    assert resume.remaining(inputs, resume.processed_keys(done, left, keys=["k"]), ["k"]).count() == 0
    assert {(r["rank"], r.n) for r in resume.counts_by_rank(left, 4, "k").collect()} == {(0, 3), (1, 2), (2, 2), (3, 1)}
    assert [r.k for r in resume.shard(inputs, 4, 3).select("k").collect()] == [3, 7] if "sample_id" in inputs.columns else True


def test_keep_last(spark):
    df = spark.createDataFrame([(1, "r1", 1, "old"), (1, "r10", 1, "mid"), (1, "r2", 5, "new"), (2, "r1", 2, None)], "sample_id long, shard_path string, line_no int, status string")
    got = {r.sample_id: r.status for r in resume.keep_last(df, "sample_id", ["shard_path", "line_no"]).collect()}
    assert got == {1: "new", 2: None}


def test_settings(spark):
    resume.check_config({"steps": 4, "devices": "0"}, {"steps": 4, "devices": "1"})
    with pytest.raises(ValueError, match="steps"):
        resume.check_config({"steps": 4}, {"steps": 5})
    resume.check_config({"steps": 4, "old": 1}, {"steps": 4, "new": 2})  # what only one of both knows is no obstacle
    checks.check_run_settings(batch_size=1, mask_ratio=0, eps=1e-8, start_step_index=0, denoise_strength=1)
    for bad in ({"batch_size": 0}, {"mask_ratio": -0.1}, {"mask_ratio": 1.5}, {"continuation_noise_level": 2}, {"denoise_strength": -1}, {"start_step_index": -1}, {"max_samples": 0}, {"eps": 0}, {"num_trajectories": 1}):
        with pytest.raises(ValueError):
            checks.check_run_settings(**bad)


def test_step_specs(spark):
    assert st.parse_step_spec("18") == ("absolute", 18.0) and st.parse_step_spec("0.5") == ("relative", 0.5) and st.parse_step_spec("1e-1") == ("relative", 0.1)
    for bad in ("0", "1.5", "0.0", "-3", "x"):
        with pytest.raises(ValueError):
            st.parse_step_spec(bad)
    n = spark.createDataFrame([(i,) for i in (0, 1, 3, 5, 10)], "n int")
    got = n.select("n", st.steps_for(F.col("n"), "0.3").alias("s"), st.mask_size(F.col("n"), 0.5).alias("m")).collect()
    assert [(r.n, r.s, r.m) for r in got] == [(0, 0, 0), (1, 1, 1), (3, 1, 2), (5, 2, 2), (10, 3, 5)]
    assert st.parse_image_size("832*480") == st.parse_image_size("832x480") == st.parse_image_size(" 832, 480") == (832, 480)
    assert st.parse_image_size("832") is None and st.parse_image_size(None) is None
    assert st.worker_seed(5, 2) == st.worker_seed(5, 2, "video") == 5 + 2 * 1_000_003 and st.worker_seed(5, 2, "edit") == 7
    sizes = spark.createDataFrame([(1000, 1), (1, 1000), (832, 480), (1664, 480), (832, 960), (833, 480)], "w int, h int")
    w, h = st.crop_size(F.col("w"), F.col("h"), 832, 480)
    for r in sizes.select("w", "h", w.alias("cw"), h.alias("ch")).collect():
        ratio = 832 / 480
        assert (r.cw, r.ch) == ((r.w, max(int(r.w / ratio), 1)) if r.w < r.h * ratio else (max(int(r.h * ratio), 1), r.h)) and r.cw and r.ch
    frames = spark.range(4).select(st.frame_noise(F.col("id"), 9, 0.5).alias("n"), st.frame_noise(F.col("id"), 9, 0.5, False).alias("all"))
    assert [r.n for r in frames.collect()] == [0.0, 0.0, 0.0, 0.5] and {r.all for r in frames.collect()} == {0.5}
    assert st.denoise_strength(0.8, 0.0) == 0.0 and st.denoise_strength(0.8, 0.0, 3) == st.denoise_strength(0.8, 1.0) == 0.8


def test_changed_span(spark):
    cases = [([1, 2, 3], [1, 2, 3], (-1, -1)), ([1, 2, 3], [1, 9, 3], (1, 2)), ([1, 2], [1, 5, 2], (1, 2)), ([1, 1], [1, 1, 1], (2, 3)), ([], [4], (0, 1)), ([1, 2, 3], [1, 3], (1, 1)), ([], [], (-1, -1))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<int>, b array<int>")
    got = {r.i: tuple(r.s) for r in df.select("i", masking.changed_span(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_prompts_with_a_marker(spark):
    cases = [([1, 2, 3], [1, 9, 8, 2, 3], [5, 6], [1, 5, 6, 2, 3]), ([1, 2], [9, 2], [5], [5, 2]), ([1], [1, 9], [], [1]), ([1, 2, 3, 4], [1, 2, 9, 3, 4], [5, 5, 5], [1, 2, 5, 5, 5, 3])]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, a array<int>, b array<int>, x array<int>")
    got = {r.i: r.t for r in df.select("i", masking.insert_at_marker(F.col("a"), F.col("b"), F.col("x"), 6).alias("t")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    for a, b in (([1, 2], [1, 2]), ([1, 2, 3], [1, 3])):
        with pytest.raises(Exception, match="no marker"):
            spark.createDataFrame([(a, b, [5])], "a array<int>, b array<int>, x array<int>").select(masking.insert_at_marker(F.col("a"), F.col("b"), F.col("x"))).collect()


def test_tokens(spark):
    logits = spark.createDataFrame([(0, 0, t, float(x)) for t, x in enumerate([1, 3, 3, 700])], "sample_id long, pos int, token_id int, logit double")
    top = masking.top_tokens(logits, 2, spark.createDataFrame([(0,), (1,), (2,)], "token_id int"))
    assert [(r["rank"], r.token_id) for r in top.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="fewer"):
        masking.top_tokens(logits, 9).collect()
    p = {r.token_id: r.p for r in masking.candidate_probabilities(logits, logits).collect()}
    assert sum(p.values()) == pytest.approx(1) and p[3] == pytest.approx(1)
    big = spark.createDataFrame([(0, 0, t, x) for t, x in enumerate([1000.0, 999.0, -1000.0, float("-inf"), 64.0, -63.9])] + [(0, 1, 0, -800.0), (0, 1, 1, -800.0)], "sample_id long, pos int, token_id int, logit double")
    got = {(r.pos, r.token_id): r.logp for r in masking.token_log_probabilities(big).collect()}
    lse = 1000 + math.log1p(math.exp(-1))
    assert got[0, 0] == pytest.approx(1000 - lse) and got[0, 2] == pytest.approx(-1000 - lse) and got[0, 3] == float("-inf")
    assert got[1, 0] == got[1, 1] == pytest.approx(-math.log(2))
    with pytest.raises(ValueError):
        masking.require_tokens(logits.limit(0))
    with pytest.raises(ValueError):
        masking.allowed_tokens(logits, logits, "sound", 3)


def test_masks_are_the_same_however_they_are_dealt(spark):
    rows = spark.createDataFrame([(s, p) for s in range(20) for p in range(s)], "sample_id long, pos int")
    one = {tuple(r) for r in masking.choose_masks(rows, 3, 0.5).collect()}
    two = {tuple(r) for r in masking.choose_masks(rows.repartition(7), 3, 0.5).collect()}
    assert one == two
    sizes = {}
    for s, t, _ in one:
        sizes[s, t] = sizes.get((s, t), 0) + 1
    assert sizes[5, 0] == 2 and sizes[3, 1] == 2 and sizes[1, 2] == 1  # 2.5 rounds to 2, 1.5 to 2, 0.5 up to 1


def test_history(spark):
    h = spark.createDataFrame([(0, 0, 0, [9, 1, 9])], "sample_id long, traj int, step int, token_ids array<int>")
    from concord.sources.sinks import history_lines

    masked = masking.masked_counts(h, 9)
    meta = spark.createDataFrame([(0, 0, 3)], "sample_id long, traj int, length int")
    lines = [json.loads(r.value) for r in history_lines(masked, meta).orderBy("step").collect()]
    assert lines[0]["type"] == "meta" and lines[1]["masked"] == 2

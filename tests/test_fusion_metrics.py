import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.operators import checks, fusion, metrics, video
from tests import kernel

EVIDENCE = "sample_id long, label long, trajectory_evidence struct<expected:double,pessimistic:double,optimistic:double>"


def _records(spark, rows):
    return spark.createDataFrame([(i, y, e) for i, y, e in rows], EVIDENCE)


def test_fusion_sums_all_views(spark):
    a = _records(spark, [(1, 1, (0.5, 0.25, 1.0)), (2, 0, (0.0, 0.0, 0.0))])
    b = _records(spark, [(2, 0, (1.0, 1.0, 1.0)), (1, 1, (2.0, 2.0, 2.0))])
    df = fusion.fuse_pathways([("a", a), ("b", b)])
    rows = {r.sample_id: r for r in df.collect()}
    assert rows[1].membership_score == 7.75 and rows[2].membership_score == 3.0
    assert rows[1].features["b.expected"] == 2.0 and len(rows[1].features) == 6
    assert fusion.fused_auc(df).first().auc == 1.0


@pytest.mark.parametrize(
    ("second", "message"),
    [
        ([(1, 1, (1.0, 1.0, 1.0))], "do not match"),
        ([(1, 1, (1.0, 1.0, 1.0)), (2, 1, (1.0, 1.0, 1.0))], "inconsistent labels"),
        ([(1, 1, (1.0, 1.0, 1.0)), (1, 1, (1.0, 1.0, 1.0)), (2, 0, (1.0, 1.0, 1.0))], "duplicate"),
        ([(1, 1, None), (2, 0, (1.0, 1.0, 1.0))], "without"),
        ([(None, 1, (1.0, 1.0, 1.0)), (2, 0, (1.0, 1.0, 1.0))], "without"),
    ],
)
def test_fusion_refuses_pathways_that_differ(spark, second, message):
    a = _records(spark, [(1, 1, (1.0, 1.0, 1.0)), (2, 0, (1.0, 1.0, 1.0))])
    with pytest.raises(Exception, match=message):
        fusion.fuse_pathways([("a", a), ("b", _records(spark, second))]).collect()


def test_names(spark):
    assert fusion.pathway_names(["x/text/results.jsonl", "y/text/results.jsonl", "z/image.jsonl", "q/text.jsonl"]) == ["text", "text_2", "image", "text_3"]
    with pytest.raises(ValueError):
        fusion.fuse(None, [])


def test_record_checks(spark):
    df = _records(spark, [(1, 1, (1.0, 1.0, 1.0)), (1, 1, (1.0, 1.0, 1.0)), (2, None, (1.0, 1.0, 1.0)), (3, 1, None), (None, 1, None)])
    found = {(r.sample_id, r.problem) for r in checks.broken_records(df).collect()}
    assert found == {(1, "duplicate sample_id"), (2, "no label"), (3, "no evidence"), (None, "no sample_id")}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([0, 0, 1, 1, 2]), st.sampled_from([0.0, -0.0, 0.5, -1.5, 3.25, 1e-7, 1e12, -1e12, float("inf")])), min_size=1, max_size=30))
def test_auc_is_that_of_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "label int, score double")
    got, want = metrics.roc_auc(df).first().auc, kernel.auc(*zip(*rows, strict=True))
    assert math.isclose(got, want, abs_tol=1e-12) or math.isnan(got) and math.isnan(want)
    if any(y > 1 for y, _ in rows):  # other labels take ranks, so turning the scores round is not the same
        return
    turned = metrics.roc_auc(spark.createDataFrame([(y, -s) for y, s in rows], "label int, score double")).first().auc
    assert math.isnan(got) or math.isclose(turned, 1 - got, abs_tol=1e-12)


def test_auc_of_one_class_or_nothing_is_nan(spark):
    for rows in ([(1, 0.5)], [(0, 0.5)], [(2, 0.5)], []):
        assert math.isnan(metrics.roc_auc(spark.createDataFrame(rows, "label int, score double")).first().auc)
    with pytest.raises(Exception, match="NaN"):
        metrics.roc_auc(spark.createDataFrame([(1, float("nan")), (0, 1.0)], "label int, score double")).collect()


def test_other_labels_take_ranks(spark):
    rows = [(1, 0.9), (0, 0.1), (2, 0.5), (2, 0.6)]
    assert metrics.roc_auc(spark.createDataFrame(rows, "label int, score double")).first().auc == 3.0


def test_runs_of_scores_grow_with_them_and_split_a_crowd(spark):
    import random

    r = random.Random(5)
    some = [0.0, -0.0, 1e-300, -1e-300, 1e-18, 5e-324, float("inf"), float("-inf"), 1.0, 2.0, 4.0, 0.5, 1e308, *(r.gauss(0, 10.0 ** r.randint(-6, 6)) for _ in range(400))]
    got = spark.createDataFrame([(x,) for x in some], "score double").select("score", metrics._run("score").alias("run")).collect()
    ordered = sorted((x.score, x.run) for x in got)
    assert all(a[1] <= b[1] for a, b in zip(ordered[:-1], ordered[1:], strict=True))
    crowd = spark.range(20_000).select((2.7 + 0.25 * F.rand(3)).alias("score"))
    assert crowd.select(metrics._run("score").alias("run")).distinct().count() > 15_000


def test_null_scores_have_the_lowest_rank(spark):
    rows = [(None,), (1.0,), (None,), (float("nan"),)]
    got = sorted((str(r.score), r.mean_rank) for r in metrics.mean_ranks(spark.createDataFrame(rows, "score double")).collect())
    assert got == [("1.0", 3.0), ("None", 1.5), ("None", 1.5), ("nan", 4.0)]


def test_mean_ranks(spark):
    rows = [(0.5,), (-1.0,), (0.5,), (2.0,), (0.5,)]
    got = sorted((r.score, r.mean_rank) for r in metrics.mean_ranks(spark.createDataFrame(rows, "score double")).collect())
    assert got == [(-1.0, 1.0), (0.5, 3.0), (0.5, 3.0), (0.5, 3.0), (2.0, 5.0)]


def test_video_matrices(spark):
    schema = "sample_id long, label long, folder string, row_map array<struct<pair_type:string,i:int,j:int>>, matrix array<array<double>>"
    rows = [(1, 1, "a", [("gen_gen", 0, 1)], [[0.0, 0.0]]), (1, 1, "b", [("gen_gen", 0, 1), ("real_gen", 0, 2)], [[0.5, 1.0], [9.0, 9.0]])]
    m = spark.createDataFrame(rows, schema)
    pairs = video.melt(video.last_of_each(m, "folder"))
    r = video.video_evidence(pairs, 1).first()
    assert (r.expected, r.pessimistic, r.optimistic, r.num_steps, r.num_positions) == (0.75, 0.5, 1.0, 2, 1)
    fused = video.fuse_video([("v", pairs), ("v", pairs)], 1).first()
    assert fused.membership_score == 4.5 and set(fused.features) == {f"v.gen_gen.{x}" for x in ("expected", "pessimistic", "optimistic")}
    with pytest.raises(ValueError):
        video.video_evidence(pairs, 1, "other")
    with pytest.raises(Exception, match="row map"):
        video.melt(spark.createDataFrame([(1, 1, "a", [], [[1.0]])], schema)).collect()

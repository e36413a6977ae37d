import numpy as np
import pytest

from concord.operators import blackbox
from tests import kernel

ROWS = "sample_id long, pathway string, query int, step int, z array<double>"


def _rows(z, pathway="a"):
    return [(0, pathway, q, s, z[q, s].tolist()) for q in range(z.shape[0]) for s in range(z.shape[1])]


def _views(values, k):
    s = np.sort(values, axis=0)
    return np.stack([s.mean(0), s[:k].mean(0), s[-k:].mean(0)])


def test_multi_and_final_step(spark):
    z = np.random.default_rng(1).normal(size=(4, 3, 5))
    f = kernel.pair_cosines(z[:, :, None, :])[:, 0].T
    steps = _views(f, 2)
    want = [steps[0].mean(), np.sort(steps[1])[:2].mean(), np.sort(steps[2])[-2:].mean()]
    r = blackbox.pathway_features(spark.createDataFrame(_rows(z), ROWS), "multiple_step", 2).first()
    assert np.allclose([r.exp, r.pess, r.opt], want)
    r = blackbox.pathway_features(spark.createDataFrame(_rows(z[:, :1]), ROWS), blackbox.AccessMode.FINAL_STEP, 2).first()
    assert np.allclose([r.exp, r.pess, r.opt], _views(f[:, 0], 2))


def test_k_is_strict(spark):
    z = np.random.default_rng(1).normal(size=(3, 2, 5))
    df = spark.createDataFrame(_rows(z), ROWS)
    with pytest.raises(Exception, match="number of pairs"):
        blackbox.pathway_features(df, "multi_step", 4).collect()
    with pytest.raises(Exception, match="number of steps"):
        blackbox.pathway_features(df, "multi_step", 3).collect()
    for bad in (True, 1.0):
        with pytest.raises(TypeError):
            blackbox.pathway_features(df, "multi_step", bad)
    with pytest.raises(ValueError):
        blackbox.pathway_features(df, "multi_step", 0)
    with pytest.raises(ValueError):
        blackbox.pathway_features(df, "no_step", 1)


def test_zero_vectors_and_single_queries_fail(spark):
    z = np.ones((2, 1, 2))
    z[0] = 0
    with pytest.raises(Exception, match="zero vector"):
        blackbox.pathway_features(spark.createDataFrame(_rows(z), ROWS), "final_step").collect()
    with pytest.raises(Exception, match="two queries or more"):
        blackbox.pathway_features(spark.createDataFrame(_rows(np.ones((1, 1, 2))), ROWS), "final_step").collect()


def _answer(query, pathway, mode):
    return [f"{query} {pathway} {s}" for s in range(2)] if mode is blackbox.AccessMode.MULTI_STEP else str(query)


def test_queries_are_built_run_and_scored(spark):
    samples = spark.createDataFrame([(1, "x"), (2, "y")], "sample_id long, text string")
    score = blackbox.query_and_extract(
        samples, ["p", "q"], lambda row, pathway: row["text"] + pathway, _answer, lambda outs: [[len(o), 1.0] for o in outs], 3, "multi_step", 2
    ).collect()
    assert {r.sample_id: round(r.membership_score, 9) for r in score} == {1: 6.0, 2: 6.0}  # equal answers: each view is 1
    with pytest.raises(ValueError):
        blackbox.query_outputs(samples, ["p"], None, None, 1, "final_step")
    with pytest.raises(Exception, match="one vector"):
        blackbox.query_and_extract(samples, ["p"], lambda r, p: 1, _answer, lambda outs: [[1.0]], 2, "multi_step").collect()


def test_each_query_is_made_once_and_steps_are_checked(spark):
    samples = spark.createDataFrame([(i, "x") for i in range(5)], "sample_id long, text string")
    calls = spark.sparkContext.accumulator(0)

    def counting(query, pathway, mode):
        calls.add(1)
        return _answer(query, pathway, mode)

    encoder = lambda outs: [[len(o), 1.0] for o in outs]
    assert len(blackbox.query_and_extract(samples, ["p", "q"], lambda row, p: row["text"] + p, counting, encoder, 3, "multi_step", 2).collect()) == 5
    assert calls.value == 5 * 2 * 3
    uneven = lambda query, pathway, mode: ["a"] * (1 + query)
    with pytest.raises(Exception, match="different numbers of steps"):
        blackbox.query_and_extract(samples, ["p"], lambda row, p: int(row["query"]), uneven, encoder, 2, "multi_step").collect()
    outputs = blackbox.query_outputs(samples, ["p"], lambda row, p: "x", _answer, 2, "multi_step")
    assert blackbox.equal_steps(outputs).count() == 20
    z = blackbox.encode(outputs.limit(1), lambda outs: [[3.0, 4.0] for _ in outs], unit_length=True).first().z
    assert np.allclose(z, [0.6, 0.8])


def test_pathways_are_summed_and_required(spark):
    f = spark.createDataFrame([(1, "a", 1.0, 2.0, 3.0), (1, "b", 0.5, 0.5, 0.5)], "sample_id long, pathway string, exp double, pess double, opt double")
    assert blackbox.membership_scores(f).first().membership_score == 7.5
    assert blackbox.membership_scores(f, ["a"]).first().membership_score == 6.0
    with pytest.raises(Exception, match="pathway"):
        blackbox.membership_scores(f, ["a", "c"]).collect()
    with pytest.raises(ValueError):
        blackbox.membership_scores(f, [])

import numpy as np
import pytest

from concord.operators import checks, consistency, generation
from tests import kernel


def _table(spark, arrays):
    return spark.createDataFrame([r for i, a in enumerate(arrays) for r in kernel.cells(a, i)], kernel.CELLS)


@pytest.mark.parametrize("k", [1, 2, 5, 32])
def test_evidence_is_that_of_numpy(spark, k):
    rng = np.random.default_rng(k)
    arrays = [rng.random((4, 3, 5, 6)), rng.random((2, 1, 1, 3)), rng.normal(size=(5, 2, 4, 2))]
    got = {r.sample_id: r for r in consistency.evidence(_table(spark, arrays), k).collect()}
    for i, a in enumerate(arrays):
        f = kernel.pair_cosines(a)
        want = kernel.views(f, k)
        r = got[i]
        assert np.allclose([r.expected, r.pessimistic, r.optimistic], want, atol=1e-12)
        assert np.isclose(r.membership_score, sum(want))
        assert (r.num_trajectories, r.num_pairs, r.num_steps, r.num_positions, r.aggregation_topk) == (a.shape[0], f.shape[2], a.shape[1], a.shape[2], k)
        assert k > 2 or r.pessimistic <= r.expected + 1e-12 or a.shape[0] == 2


def test_large_k_makes_the_views_equal(spark):
    a = np.random.default_rng(0).random((3, 2, 2, 4))
    r = consistency.evidence(_table(spark, [a]), 1000).first()
    assert np.allclose([r.pessimistic, r.optimistic], r.expected)


def test_zero_vectors_have_no_similarity(spark):
    a = np.zeros((2, 1, 2, 3))
    a[:, :, 1] = 1
    r = consistency.evidence(_table(spark, [a]), 1).first()
    assert (r.pessimistic, r.optimistic, r.expected) == (0.0, pytest.approx(1), pytest.approx(0.5))


def test_masks(spark):
    a = np.random.default_rng(3).random((3, 2, 4, 3))
    df = _table(spark, [a])
    f = kernel.pair_cosines(a)
    one = spark.createDataFrame([(0, 1), (0, 3)], "sample_id long, pos int")
    r = consistency.evidence(df, 2, mask=one).first()
    assert np.allclose([r.expected, r.pessimistic, r.optimistic], kernel.views(f[:, [1, 3]], 2))
    assert (r.num_steps, r.num_positions) == (2, 2)
    two = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3)], "sample_id long, step int, pos int")
    r = consistency.evidence(df, 2, mask=two).first()
    assert np.allclose([r.expected, r.pessimistic, r.optimistic], kernel.views(np.stack([f[0, 1], f[1, 2], f[1, 3]])[None], 2))
    assert (r.num_steps, r.num_positions) == (1, 3)
    none = spark.createDataFrame([(0, 9)], "sample_id long, pos int")
    assert checks.empty_masks(df, none).collect() == [(0,)]
    with pytest.raises(ValueError, match="mask"):
        checks.ensure_none(checks.empty_masks(df, none), "the mask selects nothing")


def test_relabelled_trajectories_give_the_same(spark):
    a = np.random.default_rng(4).random((4, 2, 2, 3))
    one, two = (consistency.evidence(_table(spark, [x]), 2).first() for x in (a, a[[2, 0, 3, 1]]))
    assert np.allclose(one[1:5], two[1:5])


def test_pair_means_and_records(spark):
    a = np.random.default_rng(5).random((3, 2, 2, 3))
    df = _table(spark, [a])
    f = kernel.pair_cosines(a).reshape(-1, 3)
    means = consistency.pair_means(df)
    assert np.allclose(means.first().pair_mean_similarities, f.mean(0))
    labels = spark.createDataFrame([(0, 1)], "sample_id long, label int")
    r = consistency.result_records(consistency.evidence(df), means, labels).first()
    assert r.label == 1 and r.trajectory_evidence.num_pairs == 3 and len(r.trajectory_evidence.pair_mean_similarities) == 3


def test_settings_are_checked(spark):
    df = _table(spark, [np.ones((2, 1, 1, 1))])
    for bad in ({"k": 0}, {"eps": 0.0}, {"eps": -1.0}):
        with pytest.raises(ValueError):
            consistency.evidence(df, **bad)
    with pytest.raises(TypeError):
        consistency.evidence(df, k=True)


def test_one_trajectory_is_an_error_and_a_status(spark):
    df = _table(spark, [np.ones((1, 1, 1, 2))])
    with pytest.raises(Exception, match="two trajectories"):
        consistency.evidence(df).collect()
    assert consistency.enough_trajectories(df).count() == 0
    assert consistency.enough_trajectories(df, status=True).first().status == "skipped_insufficient_trajectories"


def test_tensor_checks(spark):
    good = kernel.cells(np.ones((2, 1, 2, 2)), 0)
    nan = kernel.cells(np.array([[[[1.0, np.nan]]], [[[1.0, 1.0]]]]), 1)
    hole = kernel.cells(np.ones((2, 2, 2, 1)), 2)[1:]
    short = kernel.cells(np.ones((1, 1, 1, 2)), 3)
    ragged = [*kernel.cells(np.ones((2, 1, 1, 2)), 4)[:1], (4, 1, 0, 0, [1.0])]
    empty = [(5, 0, 0, 0, []), (5, 1, 0, 0, [])]
    found = dict(checks.broken_tensors(spark.createDataFrame([*good, *nan, *hole, *short, *ragged, *empty], kernel.CELLS)).collect())
    assert set(found) == {1, 2, 3, 4, 5} and "finite" in found[1] and "grid" in found[2]


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        (kernel.cells(np.array([[[[1.0, np.nan]]], [[[1.0, 1.0]]]])), "finite"),
        (kernel.cells(np.array([[[[1.0, np.inf]]], [[[1.0, 1.0]]]])), "finite"),
        ([(0, 0, 0, 0, [1.0, None]), (0, 1, 0, 0, [1.0, 2.0])], "finite"),
        ([(0, 0, 0, 0, [1.0, 2.0]), (0, 1, 0, 0, [1.0])], "one length"),
        ([*kernel.cells(np.ones((2, 1, 1, 2))), (0, 0, 1, 0, [1.0]), (0, 1, 1, 0, [1.0])], "one length"),
        ([(0, 0, 0, 0, []), (0, 1, 0, 0, [])], "empty"),
        ([(0, 0, 0, 0, None), (0, 1, 0, 0, [1.0])], "finite|empty"),
        ([(0, t, s, 0, [1.0]) for s, ts in ((0, (0, 1)), (1, (0, 2))) for t in ts], "same two trajectories"),
        ([(0, t, 0, 0, [1.0]) for t in (0, 0, 1, 1)], "same two trajectories"),
        (kernel.cells(np.ones((2, 2, 2, 1)))[:-1], "same two trajectories"),
        ([r for r in kernel.cells(np.ones((2, 2, 2, 1))) if r[2:4] != (1, 1)], "grid"),
    ],
)
def test_bad_tensors_are_errors(spark, rows, message):
    df = spark.createDataFrame(rows, kernel.CELLS)
    with pytest.raises(Exception, match=message):
        consistency.evidence(df).collect()
    with pytest.raises(Exception, match=message):
        consistency.pair_means(df).collect()


def test_a_mask_that_selects_nothing_is_an_error(spark):
    df = _table(spark, [np.ones((2, 1, 2, 2)), np.ones((2, 1, 2, 2))])
    for mask in (spark.createDataFrame([(0, 1)], "sample_id long, pos int"), spark.createDataFrame([(0, 0, 1), (1, 5, 1)], "sample_id long, step int, pos int")):
        with pytest.raises(Exception, match="the mask selects no position: sample 1"):
            consistency.evidence(df, mask=mask).collect()


def test_steps_not_reached_are_zero(spark):
    a = np.random.default_rng(6).random((2, 3, 1, 2))
    cut = a.copy()
    cut[1, 1:] = 0
    rows = [r for r in kernel.cells(a) if not (r[1] == 1 and r[2] > 0)]
    r = consistency.evidence(consistency.fill_steps(spark.createDataFrame(rows, kernel.CELLS), 3), 1).first()
    assert np.allclose([r.expected, r.pessimistic, r.optimistic], kernel.views(kernel.pair_cosines(cut), 1))


class _Model:
    """Prefers token 2 everywhere."""

    def logits(self, token_ids):
        x = np.zeros((len(token_ids), 5))
        x[:, 2] = 50
        return x


def test_denoising_records_probabilities_and_stops_early(spark):
    rng = np.random.default_rng(0)
    p, history = generation.denoise_one(_Model(), np.array([1, 1, 1]), np.array([0, 2]), np.array([[2, 0]] * 3), 4, 4, rng, 1.0)
    assert history.tolist() == [[2, 1, 4], [2, 1, 2]] or history.tolist() == [[4, 1, 2], [2, 1, 2]]
    assert np.allclose(p[:3, :, 0], 1) and not p[3].any()
    samples = spark.createDataFrame([(7, [1, 1, 1])], "sample_id long, token_ids array<int>")
    masks = spark.createDataFrame([(7, t, q) for t in (0, 1) for q in (0, 2)], "sample_id long, traj int, pos int")
    candidates = spark.createDataFrame([(7, [[2, 0]] * 3)], "sample_id long, candidate_ids array<array<int>>")
    cells = generation.denoise(samples, masks, candidates, _Model, 4, 4)
    assert cells.count() == 2 * 4 * 3
    assert consistency.evidence(cells, 1).first().optimistic == pytest.approx(1)

"""Consistency of repeated trajectories: pair cosines, three views, evidence per sample.

Input is a table of cells (sample_id, traj, step, pos, v): one vector for each
trajectory, step and position. The vectors of a cell meet in one aggregate by
(sample_id, step, pos); a sample is put together from its cells' few numbers, so
no task holds the vectors of a whole sample.

A sample's cells must be a full grid of finite vectors of one length, with the same two
trajectories or more in each; anything else is an error that names the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.vectors import dot, mean, mean_extreme, norm

CELL = ["sample_id", "step", "pos"]
VIEWS = ("expected", "pessimistic", "optimistic")


def _check(k: int, eps: float) -> None:
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError(f"k is no integer: {k!r}")
    if k < 1:
        raise ValueError("aggregation_topk must be positive")
    if not eps > 0:
        raise ValueError("eps must be positive")


def _pair_sims(runs: Column, eps: float) -> Column:
    """Cosines of all pairs of runs (traj, v, n), n the norm of v, in the order (0,1), (0,2), ... (1,2), ..."""

    def sim(a: Column, b: Column) -> Column:
        size = a["n"] * b["n"]
        return F.when(size > eps, dot(a["v"], b["v"]) / size).otherwise(F.lit(0.0))

    each = F.transform(runs, lambda a: F.transform(F.filter(runs, lambda b: b["traj"] > a["traj"]), lambda b: F.struct(a["traj"].alias("i"), b["traj"].alias("j"), sim(a, b).alias("sim"))))
    return F.flatten(each)


def cell_pairs(cells: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(sample_id, step, pos, pairs, short, long, odd): an array of (i, j, sim) for each cell, of runs i < j.

    short and long are the least and largest length of the cell's vectors, odd says
    whether one has a value that is null or not finite.
    """
    if not eps > 0:
        raise ValueError("eps must be positive")
    # a vector's norm is taken once, before it meets the others
    cells = cells.select(*CELL, "traj", F.col("v").cast("array<double>").alias("v")).withColumn("n", norm(F.col("v")))
    # a row without a position says that a mask left cells of the sample out (see _flagged)
    chosen = lambda c: F.when(F.col("pos").isNotNull(), c)
    runs = F.array_sort(F.collect_list(chosen(F.struct("traj", "v", "n"))))
    size = chosen(F.coalesce(F.size("v"), F.lit(0)))
    # a norm is finite if, and but for overflow only if, all values are
    odd = chosen(F.col("n").isNull() | F.isnan("n") | (F.col("n") == float("inf")))
    met = cells.groupBy(*CELL).agg(runs.alias("runs"), F.min(size).alias("short"), F.max(size).alias("long"), F.max(odd).alias("odd"))
    return met.select(*CELL, chosen(_pair_sims(F.col("runs"), eps)).alias("pairs"), "short", "long", "odd")


def pair_consistency(cells: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(sample_id, step, pos, i, j, sim), a row for each unordered pair of trajectories of each cell."""
    return cell_pairs(cells, eps).select(*CELL, F.inline("pairs"))


def select_positions(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of masked positions; ``mask`` is (sample_id, pos) or (sample_id, step, pos)."""
    keys = [c for c in CELL if c in mask.columns]
    return cells.join(mask.select(*keys).distinct(), keys, "left_semi")


def _flagged(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """The masked cells, and of all others only that they are there: rows without step, position and vector."""
    keys = [c for c in CELL if c in mask.columns]
    rows = cells.join(mask.select(*keys).distinct().withColumn("chosen", F.lit(True)), keys, "left")
    return rows.select("sample_id", "traj", *(F.when(F.col("chosen"), F.col(c)).alias(c) for c in ("step", "pos", "v")))


def evidence_from_pairs(pairs: DataFrame, k: int = 32, flat: bool = False, means: bool = False) -> DataFrame:
    """Evidence per sample of (sample_id, step, pos, pairs), as cell_pairs() gives them.

    The pessimistic view of a cell is the mean of its k smallest pair values, that of a
    sample the mean of its k smallest cells' views; the optimistic view takes the
    largest; the expected one is the mean of all values. k is as much as there is where
    there is less. ``flat``: positions were chosen step by step, so the sample counts
    as one step. ``means`` adds pair_mean_similarities, of each pair, in order, the mean
    over all cells.
    """
    _check(k, 1)
    sims = F.transform("pairs", lambda p: p["sim"])
    which = F.transform("pairs", lambda p: F.struct(p["i"], p["j"]))
    sized = "short" in pairs.columns
    cells = pairs.select(
        *CELL,
        F.size("pairs").alias("j"),
        F.when(F.col("pairs").isNotNull(), F.xxhash64(which)).alias("which"),
        (F.size(F.array_distinct(which)) < F.size("pairs")).alias("twice"),
        F.exists(sims, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("wrong"),
        *([sims.alias("sims")] if means else []),
        *(["short", "long", "odd"] if sized else []),
        mean(sims).alias("m"),
        mean_extreme(sims, k, False).alias("low"),
        mean_extreme(sims, k, True).alias("high"),
    )
    sample = cells.groupBy("sample_id").agg(
        F.avg("m").alias("expected"),
        mean_extreme(F.collect_list("low"), k, False).alias("pessimistic"),
        mean_extreme(F.collect_list("high"), k, True).alias("optimistic"),
        F.min("j").alias("num_pairs"),
        F.max("j").alias("most_pairs"),
        # sets of a sample's few steps and positions; distinct counts would multiply the rows before the aggregate
        F.size(F.collect_set("step")).alias("steps"),
        F.size(F.collect_set("pos")).alias("positions"),
        F.count("j").alias("cells"),
        F.min("which").alias("which"),
        F.max("which").alias("other"),
        F.max("twice").alias("twice"),
        F.max("wrong").alias("wrong"),
        *([F.collect_list("sims").alias("sims")] if means else []),
        *([F.min("short").alias("short"), F.max("long").alias("long"), F.max("odd").alias("odd")] if sized else []),
    )
    t = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + 8 * F.col("num_pairs"))) / 2).cast("int")
    pairs_wrong = (F.col("num_pairs") != F.col("most_pairs")) | (t * (t - 1) / 2 != F.col("num_pairs")) | (F.col("num_pairs") == 0) | (F.col("which") != F.col("other")) | F.col("twice")
    problem = F.when(pairs_wrong, "every cell must have all unordered pairs of the same two trajectories or more")
    if sized:
        problem = (
            F.when(F.col("odd"), "vectors must be finite")
            .when(F.col("short") < 1, "vectors must not be empty")
            .when(F.col("short") != F.col("long"), "vectors must be of one length")
            .when(pairs_wrong, "every cell must have all unordered pairs of the same two trajectories or more")
        )
    problem = F.coalesce(problem, F.when(F.col("wrong"), "similarities must be finite"))
    if not flat:
        problem = F.coalesce(problem, F.when(F.col("cells") != F.col("steps") * F.col("positions"), "cells must fill the grid of steps and positions"))
    problem = F.when(F.col("cells") == 0, "the mask selects no position").otherwise(problem)
    message = F.concat(problem, F.lit(": sample "), F.col("sample_id").cast("string"))
    # a filter, so that the check is made whatever columns are asked for
    sure = F.when(problem.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    averages = F.transform(F.sequence(F.lit(0), F.col("num_pairs") - 1), lambda i: mean(F.transform("sims", lambda cell: F.get(cell, i))))
    return sample.where(sure).select(
        "sample_id",
        "expected",
        "pessimistic",
        "optimistic",
        (F.col("expected") + F.col("pessimistic") + F.col("optimistic")).alias("membership_score"),
        t.alias("num_trajectories"),
        "num_pairs",
        (F.lit(1) if flat else F.col("steps")).alias("num_steps"),
        (F.col("cells") if flat else F.col("positions")).cast("int").alias("num_positions"),
        F.lit(k).alias("aggregation_topk"),
        *([averages.alias("pair_mean_similarities")] if means else []),
    )


def evidence(cells: DataFrame, k: int = 32, eps: float = 1e-12, mask: DataFrame | None = None, means: bool = False) -> DataFrame:
    """Evidence per sample of trajectories' cells: three views, their sum, and counts; with ``means``, means of pairs.

    With a mask (sample_id, pos) or (sample_id, step, pos) only its cells count; a
    sample of which it leaves nothing is an error (checks.empty_masks finds them all).
    """
    _check(k, eps)
    flat = mask is not None and "step" in mask.columns
    return evidence_from_pairs(cell_pairs(cells if mask is None else _flagged(cells, mask), eps), k, flat, means)


def pair_means(cells: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(sample_id, pair_mean_similarities): of each pair, in order, the mean over all cells. evidence() gives both at once."""
    return evidence(cells, 1, eps, means=True).select("sample_id", "pair_mean_similarities")


def enough_trajectories(cells: DataFrame, status: bool = False) -> DataFrame:
    """Samples by whether they have two trajectories: those that have, or all with ok or skipped_insufficient_trajectories."""
    counts = cells.groupBy("sample_id").agg(F.count_distinct("traj").alias("num_trajectories"))
    if not status:
        return counts.where("num_trajectories >= 2")
    return counts.withColumn("status", F.when(F.col("num_trajectories") >= 2, "ok").otherwise("skipped_insufficient_trajectories"))


def fill_steps(cells: DataFrame, steps: int) -> DataFrame:
    """Cells on the full grid of steps: a step that a trajectory did not reach has zero vectors."""
    grid = cells.groupBy("sample_id", "traj", "pos").agg(F.max(F.size("v")).alias("d")).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    keys = ["sample_id", "traj", "step", "pos"]
    have = cells.select(*(F.col(k).cast("int").alias(k) if k == "step" else F.col(k) for k in keys), F.col("v").cast("array<double>").alias("v"))
    return grid.join(have, keys, "left").select(*keys, F.coalesce("v", F.array_repeat(F.lit(0.0).cast("double"), F.col("d"))).alias("v"))


def result_records(evidence: DataFrame, means: DataFrame | None, labels: DataFrame, label: str = "label", extra: Sequence[str] = ()) -> DataFrame:
    """Evidence as the records that fusion reads: sample_id, label, membership_score, trajectory_evidence."""
    df = evidence if means is None else evidence.join(means, "sample_id")
    nested = [c for c in df.columns if c != "sample_id"]
    return df.join(labels.select("sample_id", label, *extra), "sample_id").select("sample_id", label, *extra, "membership_score", F.struct(*nested).alias("trajectory_evidence"))

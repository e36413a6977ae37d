"""Constraint checks as queries that give the offending rows, and a guard that fails on any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken_tensors(cells: DataFrame) -> DataFrame:
    """(sample_id, problem) of samples that are no complete, finite grid of two trajectories or more."""
    v = F.col("v").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # repeats are counted by cell first, so that a sample's aggregate needs no distinct count of its cells
    each = cells.groupBy("sample_id", "traj", "step", "pos").agg(F.count("*").alias("rows"), F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("long"), F.max(odd.cast("int")).alias("odd"))
    sample = each.groupBy("sample_id").agg(
        F.size(F.collect_set("traj")).alias("t"),
        F.size(F.collect_set("step")).alias("s"),
        F.size(F.collect_set("pos")).alias("p"),
        F.count("*").alias("cells"),
        F.sum("rows").alias("rows"),
        F.min("short").alias("short"),
        F.max("long").alias("long"),
        F.max("odd").alias("odd"),
    )
    problem = (
        F.when(F.col("t") < 2, "fewer than two trajectories")
        .when(F.col("rows") > F.col("cells"), "a repeated cell")
        .when(F.col("cells") < F.col("t") * F.col("s") * F.col("p"), "an incomplete grid")
        .when(F.col("short") < 1, "an empty vector")
        .when(F.col("short") != F.col("long"), "vectors of several lengths")
        .when(F.col("odd") == 1, "values that are not finite")
    )
    return sample.select("sample_id", problem.alias("problem")).where("problem IS NOT NULL")


def empty_masks(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """(sample_id) of samples of which a mask leaves nothing."""
    from concord.operators.consistency import select_positions

    return cells.select("sample_id").distinct().join(select_positions(cells, mask).select("sample_id").distinct(), "sample_id", "left_anti")


def broken_records(records: DataFrame, label: str = "label") -> DataFrame:
    """(sample_id, problem) of result records that fusion rejects."""
    e = "trajectory_evidence"
    holes = F.col(e).isNull() | F.col(f"{e}.expected").isNull() | F.col(f"{e}.pessimistic").isNull() | F.col(f"{e}.optimistic").isNull()
    one = F.when(F.col("sample_id").isNull(), "no sample_id").when(F.col(label).isNull(), "no label").when(holes, "no evidence")
    rows = records.select("sample_id", one.alias("problem")).where("problem IS NOT NULL")
    twice = records.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select("sample_id", F.lit("duplicate sample_id").alias("problem"))
    return rows.unionByName(twice)


def missing_required(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which a required key is null."""
    test = F.lit(False)
    for k in keys:
        test = test | F.col(k).isNull()
    return df.where(test)


def ensure_none(offending: DataFrame, what: str) -> None:
    """Raises an error that shows the first offending rows, if there are any."""
    rows = offending.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {', '.join(str(r.asDict()) for r in rows)}")


def check_run_settings(**s) -> None:
    """Ranges of a run's settings; raises an error for the first that is out of range."""
    at_least = {"batch_size": 1, "max_samples": 1, "seed_stride": 1, "input_sampling_rate": 1, "start_step_index": 0, "max_seq_len": 1, "top_d": 1, "num_trajectories": 2, "aggregation_topk": 1, "num_workers": 1, "num_repeats": 2, "sample_steps": 1, "prefix_frames": 1, "continuation_frames": 1, "clip_batch_size": 1}
    for k, least in at_least.items():
        if s.get(k) is not None and s[k] < least:
            raise ValueError(f"{k} must be at least {least}")
    for k in ("mask_ratio", "continuation_noise_level", "denoise_strength"):
        if s.get(k) is not None and not 0 <= s[k] <= 1:
            raise ValueError(f"{k} must be in [0, 1]")
    if s.get("eps") is not None and not s["eps"] > 0:
        raise ValueError("eps must be positive")

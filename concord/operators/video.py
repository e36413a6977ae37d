"""Video pathways: similarities of repeated generations by frame, melted into pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.vectors import dot
from concord.operators.consistency import VIEWS, evidence_from_pairs

PAIR_TYPES = ("gen_gen",)


def generation_pairs(features: DataFrame) -> DataFrame:
    """(sample_id, pair_type, i, j, frame, sim) of normalised features (sample_id, generation, frame, z), in single precision."""
    z = F.col("z").cast("array<float>")
    rows = F.array_sort(F.collect_list(F.struct("generation", z.alias("z"))))
    groups = features.groupBy("sample_id", "frame").agg(rows.alias("runs"))
    each = F.transform(
        "runs",
        lambda a: F.transform(F.filter("runs", lambda b: b["generation"] > a["generation"]), lambda b: F.struct(a["generation"].alias("i"), b["generation"].alias("j"), dot(a["z"], b["z"]).cast("float").alias("sim"))),
    )
    return groups.select("sample_id", "frame", F.inline(F.flatten(each))).select("sample_id", F.lit("gen_gen").alias("pair_type"), "i", "j", "frame", "sim")


def melt(matrices: DataFrame) -> DataFrame:
    """(sample_id, label, pair_type, i, j, frame, sim) of matrices (sample_id, label, row_map, matrix).

    ``row_map`` is an array of (pair_type, i, j), one a row of ``matrix``; unequal
    lengths, an empty matrix, and a row map without a pair of generations are errors.
    """
    empty = (F.size("matrix") == 0) | (F.size(F.get("matrix", F.lit(0))) == 0)
    problem = F.when((F.size("row_map") != F.size("matrix")) | empty, "the row map must fit a non-empty matrix").when(
        ~F.exists("row_map", lambda m: m["pair_type"] == "gen_gen"), "the row map has no pair of generations"
    )
    message = F.concat(problem, F.lit(": sample "), F.col("sample_id").cast("string"))
    sure = F.when(problem.isNotNull(), F.raise_error(message).cast(matrices.schema["matrix"].dataType)).otherwise(F.col("matrix"))
    rows = matrices.select("sample_id", "label", F.posexplode(F.arrays_zip(F.col("row_map").alias("m"), sure.alias("x"))).alias("row", "e"))
    rows = rows.select("sample_id", "label", F.col("e.m.pair_type").alias("pair_type"), F.col("e.m.i").alias("i"), F.col("e.m.j").alias("j"), F.posexplode("e.x").alias("frame", "sim"))
    return rows.withColumn("sim", F.col("sim").cast("double"))


def last_of_each(df: DataFrame, order: str, key: str = "sample_id") -> DataFrame:
    """The last row of each key: of repeated samples the later folder counts."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


def video_evidence(pairs: DataFrame, k: int = 32, pair_type: str = "gen_gen") -> DataFrame:
    """Evidence per sample of melted pairs: a frame is a step with one position."""
    if pair_type not in PAIR_TYPES:
        raise ValueError(f"unknown pair type: {pair_type!r}")
    cells = pairs.where(F.col("pair_type") == pair_type).groupBy("sample_id", F.col("frame").alias("step")).agg(F.array_sort(F.collect_list(F.struct("i", "j", F.col("sim").cast("double").alias("sim")))).alias("pairs"))
    return evidence_from_pairs(cells.select("sample_id", "step", F.lit(0).alias("pos"), "pairs"), k)


def fuse_video(pathways: Sequence[tuple[str, DataFrame]], k: int = 32, pair_type: str = "gen_gen") -> DataFrame:
    """Fused records of named tables of melted pairs with labels. Where names are equal, the later pathway's views are the features of that name; the score has all."""
    from concord.operators.fusion import evidence_rows, fuse

    rows = None
    for place, (name, pairs) in enumerate(pathways):
        labels = pairs.groupBy("sample_id").agg(F.max("label").alias("label"))
        found = video_evidence(pairs, k, pair_type).join(labels, "sample_id").select("sample_id", "label", F.struct(*VIEWS).alias("trajectory_evidence"))
        part = evidence_rows(found, f"{name}.{pair_type}", place)
        rows = part if rows is None else rows.unionByName(part)
    return fuse(rows, [name for name, _ in pathways])

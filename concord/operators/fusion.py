"""Fusion of pathways' evidence by sample."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.consistency import VIEWS
from concord.operators.metrics import roc_auc


def pathway_names(paths: Sequence[str]) -> list[str]:
    """Names of result files: the folder's where a file is called results, else its own; a repeated name gets _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for path in paths:
        stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        base = os.path.basename(os.path.dirname(path.rstrip("/"))) if stem == "results" else stem
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def suffix_repeats(df: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with pathway: the name, with _2, _3, ... where earlier rows, by ``order``, have it too."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("pathway", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


def evidence_rows(records: DataFrame, pathway: str, place: int, label: str = "label") -> DataFrame:
    """Records of one pathway in long form; a record without sample_id, label or evidence is an error."""
    views = [F.col(f"trajectory_evidence.{v}").cast("double") for v in VIEWS]
    holes = F.col("sample_id").isNull() | F.col(label).isNull()
    for v in views:
        holes = holes | v.isNull()
    sure = F.when(holes, F.raise_error(F.lit(f"{pathway}: a record without sample_id, {label} or trajectory_evidence")).cast("long")).otherwise(F.col("sample_id").cast("long"))
    return records.select(sure.alias("sample_id"), F.col(label).cast("long").alias("label"), F.lit(place).alias("place"), F.lit(pathway).alias("pathway"), *(v.alias(n) for v, n in zip(views, VIEWS, strict=True)))


def _last_of_each_name(names: Column, values: Column) -> Column:
    """A map of names to values; of a repeated name, the last value."""
    entries = F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i")))
    last = F.filter(entries, lambda e: F.size(F.filter(entries, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"]))) == 0)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def fuse(rows: DataFrame, pathways: Sequence[str], label: str = "label") -> DataFrame:
    """(sample_id, label, membership_score, features): one row a sample of long evidence rows (see evidence_rows).

    Every sample must have each pathway exactly once and one label; anything else is an
    error that names the sample. The score is the sum of all views in pathway order.
    """
    if not pathways:
        raise ValueError("at least one pathway is required")
    ordered = F.array_sort(F.collect_list(F.struct("place", "pathway", *VIEWS)))
    groups = rows.groupBy("sample_id").agg(ordered.alias("parts"), F.size(F.collect_set("place")).alias("places"), F.count("*").alias("n"), F.min("label").alias("label"), F.max("label").alias("most"))
    problem = (
        F.when(F.col("n") > F.col("places"), F.lit("duplicate sample_id in a pathway"))
        .when(F.col("places") < len(pathways), F.lit("sample ids of the pathways do not match"))
        .when(F.col("label") != F.col("most"), F.lit("inconsistent labels across pathways"))
    )
    values = F.flatten(F.transform("parts", lambda p: F.array(*(p[v] for v in VIEWS))))
    names = F.flatten(F.transform("parts", lambda p: F.array(*(F.concat(p["pathway"], F.lit(f".{v}")) for v in VIEWS))))
    sure = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.col("sample_id").cast("string"))).cast("double"))
    score = F.aggregate(values, F.lit(0.0).cast("double"), lambda s, x: s + x)
    return groups.select("sample_id", F.col("label").alias(label), F.coalesce(sure, score).alias("membership_score"), _last_of_each_name(names, values).alias("features"))


def fuse_pathways(results: Sequence[tuple[str, DataFrame]], label: str = "label") -> DataFrame:
    """Fused records of named tables of result records."""
    names = [n for n, _ in results]
    rows = None
    for place, (name, records) in enumerate(results):
        part = evidence_rows(records, name, place, label)
        rows = part if rows is None else rows.unionByName(part)
    return fuse(rows, names, label)


def fused_auc(fused: DataFrame, label: str = "label") -> DataFrame:
    """(auc) of fused records; every label but 0 counts as 1."""
    return roc_auc(fused.select((F.col(label) != 0).cast("int").alias("label"), F.col("membership_score").alias("score")))


def id_mismatches(rows: DataFrame, pathways: int) -> DataFrame:
    """(sample_id, pathways) of samples that not every pathway has."""
    return rows.groupBy("sample_id").agg(F.count_distinct("place").alias("pathways")).where(F.col("pathways") != pathways)


def label_conflicts(rows: DataFrame) -> DataFrame:
    """(sample_id, low, high) of samples whose labels differ."""
    return rows.groupBy("sample_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")


def same_ids(left: DataFrame, right: DataFrame, key: str = "sample_id") -> bool:
    """Whether both tables have the same set of ids."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

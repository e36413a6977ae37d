"""Scores from repeated queries of a model that shows its outputs only.

Input is a table of embeddings (sample_id, pathway, query, step, z). With final-step
access a sample has one step. Here k is strict: fewer values than k are an error,
unless ``strict`` is off; k is as much as there is then, and a sample of one query,
which has no pairs, has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from enum import Enum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.vectors import dot, mean, mean_extreme, mean_extreme_strict, unit


class AccessMode(str, Enum):
    """What a model's interface shows: every step's output, or the last one."""

    MULTI_STEP = "multi_step"
    FINAL_STEP = "final_step"


def access_mode(value: AccessMode | str) -> AccessMode:
    """The mode of a name; multiple_step is an older name of multi_step."""
    return AccessMode(str(getattr(value, "value", value)).lower().replace("multiple_step", "multi_step"))


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError(f"k is no integer: {k!r}")
    if k < 1:
        raise ValueError("k must be at least 1")


def _extreme(values: str, k: int, largest: bool, what: str, strict: bool) -> Column:
    return mean_extreme_strict(F.col(values), k, largest, what) if strict else mean_extreme(F.col(values), k, largest)


def step_views(embeddings: DataFrame, k: int = 1, strict: bool = True) -> DataFrame:
    """(sample_id, pathway, step, exp, pess, opt): means over pairs of queries; of all, of the k smallest, of the k largest cosines."""
    _check_k(k)
    z = unit(F.col("z").cast("array<double>"))
    # the steps that a query's call showed come with its rows, so checking them needs no second look at the outputs
    steps = F.col("steps") if "steps" in embeddings.columns else F.lit(0)
    rows = embeddings.select("sample_id", "pathway", "query", "step", z.alias("z"), steps.alias("steps"))
    runs = F.array_sort(F.collect_list(F.struct("query", "z")))
    groups = rows.groupBy("sample_id", "pathway", "step").agg(runs.alias("runs"), F.min("steps").alias("least"), F.max("steps").alias("most"))
    if not strict:
        groups = groups.where(F.size("runs") > 1)
    few = F.raise_error(F.lit("a sample needs the outputs of two queries or more")).cast("array<double>")
    uneven = F.raise_error(F.lit("the queries of a sample showed different numbers of steps")).cast("array<double>")
    each = F.transform("runs", lambda a: F.transform(F.filter("runs", lambda b: b["query"] > a["query"]), lambda b: dot(a["z"], b["z"])))
    sims = F.when(F.col("least") != F.col("most"), uneven).when(F.size("runs") < 2, few).otherwise(F.flatten(each))
    df = groups.select("sample_id", "pathway", "step", sims.alias("sims"))
    pess, opt = (_extreme("sims", k, largest, "pairs", strict) for largest in (False, True))
    return df.select("sample_id", "pathway", "step", mean(F.col("sims")).alias("exp"), pess.alias("pess"), opt.alias("opt"))


def pathway_features(embeddings: DataFrame, mode: AccessMode | str, k: int = 1, strict: bool = True) -> DataFrame:
    """(sample_id, pathway, exp, pess, opt): views over pairs of each step, then, with multi-step access, the same views over steps."""
    views = step_views(embeddings, k, strict)
    if access_mode(mode) is AccessMode.FINAL_STEP:
        several = F.raise_error(F.lit("final_step embeddings have one step")).cast("double")
        once = views.groupBy("sample_id", "pathway").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("exp", "pess", "opt")))
        return once.select("sample_id", "pathway", F.when(F.col("n") > 1, several).otherwise(F.col("exp")).alias("exp"), "pess", "opt")
    steps = views.groupBy("sample_id", "pathway").agg(F.avg("exp").alias("exp"), F.collect_list("pess").alias("p"), F.collect_list("opt").alias("o"))
    return steps.select(
        "sample_id", "pathway", "exp", _extreme("p", k, False, "steps", strict).alias("pess"), _extreme("o", k, True, "steps", strict).alias("opt")
    )


def membership_scores(features: DataFrame, pathways: Sequence[str] | None = None) -> DataFrame:
    """(sample_id, membership_score): the sum of all views of all pathways, or of the named ones, which each sample must have."""
    if pathways is not None:
        if not pathways:
            raise ValueError("at least one pathway is required")
        features = features.where(F.col("pathway").isin(list(pathways)))
    total = F.sum(F.col("exp") + F.col("pess") + F.col("opt"))
    if pathways is not None:
        missing = F.raise_error(F.lit("a sample has no outputs of a pathway")).cast("double")
        total = F.when(F.count_distinct("pathway") < len(set(pathways)), missing).otherwise(total)
    return features.groupBy("sample_id").agg(total.alias("membership_score"))


def encode(outputs: DataFrame, encoder: Callable[[Sequence], Iterable[Sequence[float]]], column: str = "output", unit_length: bool = False) -> DataFrame:
    """``outputs`` with z array<double>, by an encoder of batches of outputs; it must give one vector an output.

    With ``unit_length`` vectors are divided by their norms; a zero vector is an error then.
    """
    schema = T.StructType([*outputs.drop("z").schema.fields, T.StructField("z", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [list(map(float, v)) for v in encoder(batch[column].tolist())]
            if len(vectors) != len(batch) or len({len(v) for v in vectors}) > 1:
                raise ValueError("the encoder must return one vector of the same length for each output")
            yield batch.assign(z=vectors)

    encoded = outputs.drop("z").mapInPandas(run, schema)
    return encoded.withColumn("z", unit(F.col("z"))) if unit_length else encoded


def query_outputs(
    samples: DataFrame,
    pathways: Sequence[str],
    query_builder: Callable[[pd.Series, str], object],
    target_api: Callable[[object, str, AccessMode], object],
    repeats: int,
    mode: AccessMode | str,
) -> DataFrame:
    """(sample_id, pathway, query, step, output string, steps): each sample queried ``repeats`` times on each pathway; steps, how many its call showed.

    Each (sample, pathway, repeat) is a row before the interface is called, so calls
    are dealt over all tasks and a lost task repeats only its own.
    """
    if repeats < 2:
        raise ValueError(f"every sample must be queried twice or more, not {repeats} times")
    if not pathways:
        raise ValueError("at least one pathway is required")
    access = access_mode(mode)
    calls = samples.withColumn("pathway", F.explode(F.array(*map(F.lit, pathways)))).withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                got = target_api(query_builder(row, row["pathway"]), row["pathway"], access)
                if access is AccessMode.MULTI_STEP and (isinstance(got, str | bytes) or not isinstance(got, Sequence) or not got):
                    raise ValueError("each multi-step call must return an ordered, non-empty sequence of outputs")
                shown = list(got) if access is AccessMode.MULTI_STEP else [got]
                out += [(row["sample_id"], row["pathway"], row["query"], s, str(o), len(shown)) for s, o in enumerate(shown)]
            yield pd.DataFrame(out, columns=["sample_id", "pathway", "query", "step", "output", "steps"])

    return calls.mapInPandas(run, "sample_id long, pathway string, query int, step int, output string, steps int")


def equal_steps(outputs: DataFrame) -> DataFrame:
    """A table of ``outputs`` if all queries of a sample and pathway show the same steps; else an error when it is run.

    For tables that are there already: ``outputs`` is read twice.
    """
    runs = outputs.groupBy("sample_id", "pathway", "query").agg(F.count_distinct("step").alias("n"))
    spread = runs.groupBy("sample_id", "pathway").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sure = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("all executions must expose the same steps")).cast("boolean")).otherwise(F.lit(True))
    return outputs.join(spread.where(sure).select("sample_id", "pathway"), ["sample_id", "pathway"], "left_semi")


def query_and_extract(samples, pathways, query_builder, target_api, encoder, repeats, mode, k=1) -> DataFrame:
    """(sample_id, membership_score): queries, encodes and scores every sample; each query is made once."""
    outputs = query_outputs(samples, pathways, query_builder, target_api, repeats, mode)
    return membership_scores(pathway_features(encode(outputs, encoder), mode, k), pathways)

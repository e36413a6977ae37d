"""Ranks and ROC-AUC, from counts by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_ranks(df: DataFrame, score: str = "score") -> DataFrame:
    """``df`` with mean_rank: the rank by score from 1, the mean of the ranks of equal scores.

    Scores are counted first; ranks come from the counts, so rows are never sorted as
    a whole, and a score that many rows share is one row of the sort.
    """
    counts = _running(df.groupBy(score).agg(F.count("*").alias("n")), score, ["n"])
    ranks = counts.select(F.col(score).alias("__score"), (F.col("n_before") + (F.col("n") + 1) / 2).alias("mean_rank"))
    return df.join(ranks, df[score].eqNullSafe(ranks["__score"])).drop("__score")


#: Runs of scores in each doubling: as powers of two, for sums within runs and for sums over groups of runs.
_FINE, _COARSE = 20, 10


def _run(score: str) -> Column:
    """A number that grows with the score and is one for scores that agree in the first _FINE bits of their mantissa."""
    x = F.least(F.abs(F.col(score)).cast("double"), F.lit(1.7e308))
    exponent = F.greatest(F.floor(F.log2(F.greatest(x, F.lit(1e-300)))), F.lit(-60))
    share = F.floor((x / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * F.lit(1 << _FINE))
    size = (exponent + F.lit(61)) * F.lit(1 << _FINE) + share
    number = F.when(F.col(score) < 0, -size - 1).otherwise(size).cast("long")
    return F.when(F.col(score).isNull(), F.lit(-(1 << 62))).when(F.isnan(F.col(score).cast("double")), F.lit(1 << 61)).otherwise(number)


def _running(counts: DataFrame, score: str, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` (one row a score) with, for each column c, c_before: its sum over lower scores; null is the lowest.

    Sums are taken within runs of scores that lie very close, over the runs of each
    group of them, and over the few groups, so no task sees all scores, wherever they
    crowd. Runs follow from the score alone and need no sample.
    """
    unbounded = Window.unboundedPreceding

    def before(df: DataFrame, names: list[str], keys: list[str], order: str, suffix: str) -> DataFrame:
        over = Window.partitionBy(*keys).orderBy(order).rowsBetween(unbounded, -1)
        return df.select("*", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}{suffix}") for c in names))

    sums = [f"__{c}" for c in columns]
    df = counts.withColumn("__run", _run(score))
    runs = df.groupBy(*by, "__run").agg(*(F.sum(c).alias(s) for c, s in zip(columns, sums, strict=True)))
    runs = runs.withColumn("__group", F.floor(F.col("__run") / (1 << (_FINE - _COARSE))))
    groups = runs.groupBy(*by, "__group").agg(*(F.sum(s).alias(s) for s in sums))
    groups = before(groups, sums, list(by), "__group", "_low").drop(*sums)
    runs = before(runs, sums, [*by, "__group"], "__run", "_start").drop(*sums).join(groups, [*by, "__group"])
    df = before(df, columns, [*by, "__run"], score, "_within").join(runs, [*by, "__run"])
    return df.select(*counts.columns, *((F.col(f"__{c}_low") + F.col(f"__{c}_start") + F.col(f"{c}_within")).alias(f"{c}_before") for c in columns))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., auc): the probability that a row of label 1 scores above one of label 0, ties counting half.

    It is taken from the ranks of all rows, so rows of other labels are of neither class
    but do take ranks. NaN where a class has no row. A NaN score is an error, as it has no
    rank; rows with a null label or score are left out.
    """
    value = F.when(F.isnan(score), F.raise_error(F.lit("scores must not be NaN")).cast("double")).otherwise(F.col(score).cast("double") + F.lit(0.0))
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*by, F.col(label).alias("__label"), value.alias("__score"))
    number = lambda test: F.sum(test.cast("long"))
    counts = rows.groupBy(*by, "__score").agg(number(F.col("__label") == 1).alias("p"), number(F.col("__label") == 0).alias("n"), F.count("*").alias("a"))
    # all counts are summed up, so that the places that need them share one scan and shuffle
    counts = _running(counts, "__score", ["a", "p", "n"], by)
    ranks = F.sum(F.col("p") * (F.col("a_before") + (F.col("a") + 1) / 2))
    p, n = (F.max(F.col(f"{c}_before") + F.col(c)).cast("double") for c in ("p", "n"))
    auc = F.when((p > 0) & (n > 0), (ranks - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0.0)))
    return counts.groupBy(*by).agg(F.coalesce(auc, F.lit(float("nan"))).alias("auc"))

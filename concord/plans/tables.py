"""The driver's tables, seen as trajectories, logits, tokens and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, steps: int = 4, positions: int = 4, turned: bool = False) -> DataFrame:
    """Four consecutive embeddings are a sample's trajectories; each is cut into steps by positions by the rest.

    ``turned`` swaps steps and positions, which makes a second pathway of the same vectors.
    """
    d = 64 // (steps * positions)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(steps * positions - 1))))
    outer, inner = F.floor(F.col("c") / positions).cast("int"), (F.col("c") % positions).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 4).alias("sample_id"),
        (F.col("vec_id") % 4).cast("int").alias("traj"),
        (inner if turned else outer).alias("step"),
        (outer if turned else inner).alias("pos"),
        F.slice("embedding", F.col("c") * d + 1, d).cast("array<double>").alias("v"),
    )


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label): the label of a sample's first embedding, 1 for the upper half of the classes."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("sample_id")).agg(F.min_by("label", "vec_id").alias("label"))
    return e.select("sample_id", (F.col("label") >= 5).cast("int").alias("label"))


def black_box(spark: SparkSession, sf_dir: str, pathway: str = "a", steps: int = 4) -> DataFrame:
    """(sample_id, pathway, query, step, z): four embeddings are four queries of ``steps`` steps."""
    c = cells(spark, sf_dir, steps, 1)
    return c.select("sample_id", F.lit(pathway).alias("pathway"), F.col("traj").alias("query"), "step", F.col("v").alias("z"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, pos, token_id, logit): an embedding as four positions of sixteen tokens."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return e.select(F.col("vec_id").alias("sample_id"), F.floor(F.col("k") / 16).cast("int").alias("pos"), (F.col("k") % 16).cast("int").alias("token_id"), (F.col("x").cast("double") * 4).alias("logit"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, pos, token_id, attended): lines of orders as tokens of sequences."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 100).cast("int").alias("token_id"), (F.col("l_returnflag") != "R").alias("attended")
    )


def rounded(c: Column | str, digits: int = 9) -> Column:
    """A double without the last digits, in which engines that add in another order may differ, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


CELLS_SQL = """
SELECT vec_id // 4 AS sample_id, (vec_id % 4)::INT AS traj, (c // {p})::INT AS {outer}, (c % {p})::INT AS {inner}, embedding[c * {d} + 1 : c * {d} + {d}]::DOUBLE[] AS v
FROM embeddings, range({n}) r(c)
"""


def cells_sql(steps: int = 4, positions: int = 4, turned: bool = False) -> str:
    names = ("pos", "step") if turned else ("step", "pos")
    return CELLS_SQL.format(p=positions, d=64 // (steps * positions), n=steps * positions, outer=names[0], inner=names[1])


LABELS_SQL = "SELECT vec_id // 4 AS sample_id, (min_by(label, vec_id) >= 5)::INT AS label FROM embeddings GROUP BY 1"
LOGITS_SQL = "SELECT vec_id AS sample_id, (k // 16)::INT AS pos, (k % 16)::INT AS token_id, embedding[k + 1]::DOUBLE * 4 AS logit FROM embeddings, range(64) r(k)"
TOKENS_SQL = "SELECT l_orderkey AS sample_id, l_linenumber AS pos, (l_partkey % 100)::INT AS token_id, l_returnflag <> 'R' AS attended FROM lineitem"


def pairs_sql(cells: str, eps: float = 1e-12) -> str:
    return f"""
SELECT sample_id, step, pos, a.traj AS i, b.traj AS j,
  CASE WHEN sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) > {eps!r}
    THEN list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) ELSE 0 END AS sim
FROM ({cells}) a JOIN ({cells}) b USING (sample_id, step, pos) WHERE a.traj < b.traj
"""


def views_sql(pairs: str, k: int) -> str:
    """The three views per sample of pairs, by ranks."""
    return f"""
WITH p AS MATERIALIZED ({pairs}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, step, pos ORDER BY sim) AS up, row_number() OVER (PARTITION BY sample_id, step, pos ORDER BY sim DESC) AS down FROM p),
cell AS (SELECT sample_id, step, pos, avg(sim) FILTER (up <= {k}) AS low, avg(sim) FILTER (down <= {k}) AS high FROM ranked GROUP BY ALL),
cells2 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY low) AS up, row_number() OVER (PARTITION BY sample_id ORDER BY high DESC) AS down FROM cell),
ends AS (SELECT sample_id, avg(low) FILTER (up <= {k}) AS pessimistic, avg(high) FILTER (down <= {k}) AS optimistic FROM cells2 GROUP BY 1),
means AS (SELECT sample_id, avg(sim) AS expected, count(DISTINCT (i, j)) AS num_pairs, count(DISTINCT step) AS num_steps, count(DISTINCT pos) AS num_positions, count(DISTINCT (step, pos)) AS num_cells FROM p GROUP BY 1)
SELECT sample_id, expected, pessimistic, optimistic, num_pairs, num_steps, num_positions, num_cells FROM means JOIN ends USING (sample_id)
"""

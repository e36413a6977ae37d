"""Evidence of samples as their cells arrive.

A sample is scored once its grid is complete, in whatever batches its cells came; cells
of samples that are not are kept and met by the next batch. Every batch writes folders
of its own, so one that is run again after a failure replaces what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators.consistency import evidence

CELLS = "sample_id long, traj int, step int, pos int, v array<double>"
_KEYS = ["sample_id", "traj", "step", "pos"]


def read_cells(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The batches of a folder and where they are."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return {int(n.partition("=")[2]): f"{path}/{n}" for n in names if n.startswith("batch=")}


def _read(spark: SparkSession, path: str, batches, schema: str) -> DataFrame:
    """The tables of the batches that ``batches`` holds for, without looking at files that a failed batch may have left."""
    found = [p for n, p in _folders(spark, path).items() if batches(n)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


_SCORES = "sample_id long, expected double, pessimistic double, optimistic double, membership_score double, num_trajectories int, num_pairs int, num_steps int, num_positions int, aggregation_topk int"


def read_scores(spark: SparkSession, output: str) -> DataFrame:
    """The evidence of all samples that are complete so far."""
    return _read(spark, f"{output}/scores", lambda n: True, _SCORES)


def score_batch(batch: DataFrame, number: int, output: str, cells_of_sample: int | DataFrame, k: int, eps: float) -> None:
    """Scores the samples that are complete with a batch, and keeps the cells of others.

    ``cells_of_sample`` is how many cells a sample has, or a table (sample_id, cells) of
    it; a sample that the table does not have waits. A cell that comes again counts
    once. Cells of a sample that has been scored are left out.
    """
    spark = batch.sparkSession
    before = lambda n: n < number
    waiting = _read(spark, f"{output}/waiting", lambda n: n == number - 1, CELLS)
    done = _read(spark, f"{output}/scores", before, _SCORES).select("sample_id")
    cells = batch.select(*_KEYS, "v").unionByName(waiting).join(done, "sample_id", "left_anti").groupBy(*_KEYS).agg(F.first("v").alias("v"))
    counts = cells.groupBy("sample_id").agg(F.count("*").alias("n"))
    if isinstance(cells_of_sample, DataFrame):
        whole = counts.join(cells_of_sample.select("sample_id", "cells"), "sample_id").where("n >= cells").select("sample_id")
    else:
        whole = counts.where(F.col("n") >= cells_of_sample).select("sample_id")
    evidence(cells.join(whole, "sample_id", "left_semi"), k, eps).write.mode("overwrite").parquet(f"{output}/scores/batch={number}")
    cells.join(whole, "sample_id", "left_anti").write.mode("overwrite").parquet(f"{output}/waiting/batch={number}")
    for old, path in _folders(spark, f"{output}/waiting").items():
        if old < number - 1:  # the batch before may be needed again, if this one is
            gone = spark._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def start(spark: SparkSession, cells: str, output: str, checkpoint: str, cells_of_sample: int | DataFrame, k: int = 32, eps: float = 1e-8, files_per_batch: int = 1000) -> StreamingQuery:
    """A query that scores what is complete and then ends, or is started again later."""
    stream = read_cells(spark, cells, files_per_batch)
    each = lambda b, n: score_batch(b, n, output, cells_of_sample, k, eps)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of a stream of events (ts, event_type, value), by windows that close when data is ``late``."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")

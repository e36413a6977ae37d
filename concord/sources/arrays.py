"""Array files: similarity matrices in folders of samples, and compressed trajectory artifacts."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    """The files below a folder whose names fit a pattern, as Spark's binaryFile gives them."""
    # Spark lists a folder of folders by a task for each of up to 10,000, which take far longer to start than to list
    before = spark.conf.get(_LISTING)
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spark.conf.set(_LISTING, str(min(tasks, int(before))))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    finally:
        spark.conf.set(_LISTING, before)


def _matrix(content: bytes) -> list[list[float]]:
    m = np.asarray(np.load(io.BytesIO(content)), np.float64)
    if m.ndim != 2 or 0 in m.shape:
        raise ValueError("a similarity matrix must be two-dimensional and not empty")
    return m.tolist()


def read_matrices(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """(path, matrix array<array<double>>) of all .npy files below a folder; one that is not a filled matrix is an error."""
    files = _files(spark, path, "*.npy").select(F.col("path").alias(key), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "matrix": [_matrix(c) for c in b["content"]]})

    return files.mapInPandas(run, f"{key} string, matrix array<array<double>>")


def read_sample_folders(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label, folder, row_map, matrix) of the finished samples below a folder of video outputs.

    A sample's folder has sample_meta.json, or meta.json from earlier runs, with status
    ok, and a matrix with its row map; others are left out. Of folders that repeat a
    sample_id the last by name counts.
    """
    from concord.operators.video import last_of_each

    # one listing and one shuffle bring a sample's files together
    files = _files(spark, path, "{sample_meta.json,meta.json,similarity_row_map.json,similarity_matrix.npy}")
    name = F.regexp_extract("path", "[^/]+$", 0)
    named = files.select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"), name.alias("name"), "content")
    of = lambda *names: F.max_by(F.when(F.col("name").isin(*names), F.col("content")), F.when(F.col("name").isin(*names), F.col("name")))
    samples = named.groupBy("folder").agg(of("sample_meta.json", "meta.json").alias("meta"), of("similarity_row_map.json").alias("map"), of("similarity_matrix.npy").alias("content"))
    facts = samples.withColumn("m", F.from_json(F.decode("meta", "UTF-8"), "status string, sample_id long, label long")).where("m.status = 'ok' AND map IS NOT NULL AND content IS NOT NULL")
    row_map = F.from_json(F.decode("map", "UTF-8"), "array<struct<pair_type:string,i:int,j:int>>")
    found = facts.select(F.col("m.sample_id").alias("sample_id"), F.col("m.label").alias("label"), "folder", row_map.alias("row_map"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrices = pa.array([_matrix(c) for c in b.column("content").to_pylist()], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], matrices], [*b.schema.names[:-1], "matrix"])

    out = T.StructType([*found.schema.fields[:-1], T.StructField("matrix", T.ArrayType(T.ArrayType(T.DoubleType())))])
    # of repeated samples the last goes on before its matrix is read
    return last_of_each(found, "folder").mapInArrow(run, out)


def _artifacts(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, "*.npz").select("path", "content")


def _first_position(z) -> int:
    """Where in the sequence an artifact's positions begin: that of allowed_range, else 0."""
    return int(z["allowed_range"][0]) if "allowed_range" in z.files else 0


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, traj, step, pos, v, selected) of compressed trajectory artifacts (*.npz) below a folder.

    A row is a vector of trajectory_probabilities [trajectories, steps, positions, d];
    selected is its position's entry of semantic_position_mask. Positions count from the
    start of allowed_range, where an artifact has one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                z = np.load(io.BytesIO(content))
                p = np.asarray(z["trajectory_probabilities"], np.float64)
                mask = np.asarray(z["semantic_position_mask"], bool)
                t, s, n, _ = p.shape
                i, j, k = (x.ravel() for x in np.indices((t, s, n)))
                yield pd.DataFrame({"path": name, "traj": i, "step": j, "pos": k + _first_position(z), "v": list(p.reshape(t * s * n, -1)), "selected": mask[k]})

    return _artifacts(spark, path).mapInPandas(run, "path string, traj int, step int, pos int, v array<double>, selected boolean")


def read_artifact_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, rank, token_id, logp) of the same artifacts: candidate_ids and observed_token_log_probabilities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                z = np.load(io.BytesIO(content))
                ids, logp = np.asarray(z["candidate_ids"]), np.asarray(z["observed_token_log_probabilities"], np.float64)
                i, j = (x.ravel() for x in np.indices(ids.shape))
                yield pd.DataFrame({"path": name, "pos": i + _first_position(z), "rank": j, "token_id": ids.ravel(), "logp": logp[i]})

    return _artifacts(spark, path).mapInPandas(run, "path string, pos int, rank int, token_id int, logp double")


def read_artifact_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, end): allowed_range of the same artifacts; null where one has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.load(io.BytesIO(c)) for c in b["content"]]
            ranges = [tuple(map(int, z["allowed_range"])) if "allowed_range" in z.files else (None, None) for z in found]
            yield pd.DataFrame({"path": b["path"], "start": pd.array([r[0] for r in ranges], "Int32"), "end": pd.array([r[1] for r in ranges], "Int32")})

    return _artifacts(spark, path).mapInPandas(run, "path string, start int, end int")

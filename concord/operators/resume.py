"""Content keys, shards, resuming, and merging of partial results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Settings in which a resumed run may differ from the first.
FREE_SETTINGS = ("devices", "num_workers", "device", "progress", "resume")


def record_hash(df: DataFrame, columns: list[str], name: str = "record_hash") -> DataFrame:
    """``df`` with a decimal(20,0): BLAKE2b of 8 bytes, little-endian and unsigned, over the columns' texts, a line end between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.decimal128(20, 0)
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_pylist()
            values = [int.from_bytes(hashlib.blake2b((k or "").encode(), digest_size=8).digest(), "little") for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(str, values)).cast(kind) if values else pa.array([], kind)], [*batch.schema.names[:-1], name])

    from pyspark.sql import types as T

    fed = df.drop(name).withColumn("__key", content_key(*columns))
    out = T.StructType([*fed.schema.fields[:-1], T.StructField(name, T.DecimalType(20, 0))])
    return fed.mapInArrow(run, out)


def content_key(*columns: str) -> Column:
    """The columns' texts, a line end between them; null counts as empty."""
    return F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def fast_key(*columns: str) -> Column:
    """A 64-bit hash of the columns for internal use, without Python."""
    return F.xxhash64(*columns)


def shard(df: DataFrame, world_size: int, rank: int, by: str = "sample_id") -> DataFrame:
    """Rows of one of ``world_size`` logical shards, by an integer column modulo their number."""
    return df.where(F.pmod(F.col(by), F.lit(world_size)) == rank)


def remaining(inputs: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose keys are not among those processed."""
    return inputs.join(processed.select(*keys).distinct(), keys, "left_anti")


def processed_keys(*shards: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of all shards' results."""
    out = shards[0].select(*keys)
    for s in shards[1:]:
        out = out.union(s.select(*keys))
    return out.distinct()


def counts_by_rank(df: DataFrame, world_size: int, by: str) -> DataFrame:
    """(rank, n) of every rank, also of one without rows."""
    ranks = df.sparkSession.range(world_size).select(F.col("id").cast("int").alias("rank"))
    counts = df.groupBy(F.pmod(F.col(by), F.lit(world_size)).cast("int").alias("rank")).agg(F.count("*").alias("n"))
    return ranks.join(F.broadcast(counts) if world_size <= 10_000 else counts, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"))


def drop_repeats(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by ``order``: repeats of content within a run go."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by shard and line: a later run's result counts.

    An aggregate, so that a key with very many rows is reduced before it is shuffled.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    last = df.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("r"))
    return last.select(key, *(F.col(f"r.{c}").alias(c) for c in [*order, *rest])).select(*df.columns)


def merge_shards(*shards: DataFrame) -> DataFrame:
    """All rows of all shards."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def order_results(df: DataFrame) -> DataFrame:
    """Sorted by record_index, a missing one first."""
    return df.orderBy(F.coalesce("record_index", F.lit(-1)))


def ok_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "ok")


def status_counts(df: DataFrame) -> DataFrame:
    """(status, n)."""
    return df.groupBy("status").agg(F.count("*").alias("n"))


def check_config(stored: Mapping, current: Mapping, free: tuple[str, ...] = FREE_SETTINGS) -> None:
    """Raises an error if a run can't go on under the current settings; a setting that only one of both has is no obstacle."""
    differ = sorted(k for k in stored if k in current and k not in free and stored[k] != current[k])
    if differ:
        raise ValueError(f"the stored configuration differs in {', '.join(differ)}")


def with_default_scores(df: DataFrame, label: str = "label") -> DataFrame:
    """Merged rows for scoring: a missing score is 0.0, a missing label 0."""
    return df.withColumn("membership_score", F.coalesce("membership_score", F.lit(0.0))).withColumn(label, F.coalesce(label, F.lit(0)))

"""The folder that all executors share, and tables written there to cut lineage.

Jobs here never rely on an executor's local disk: intermediate tables go to the
folder that the cluster names in ``spark.checkpoint.dir`` and are read back, so
a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path for ``purpose`` below ``spark.checkpoint.dir``.

    Where the session names no such folder, one is made and set on a local master; on a
    cluster that is an error, as executors don't share the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="concord-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back, without its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and of which nothing is read any more; other tables stay."""
    for df in tables:
        if written := vars(df).get("written"):
            remove_folder(df.sparkSession, written)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def with_mapped(df: DataFrame, column: Column, func: Callable, *fields: T.StructField) -> DataFrame:
    """``df`` with further columns that ``func`` makes of ``column`` in Arrow batches; columns of their names are replaced.

    ``func`` gets batches with all columns and, last, ``column``, and gives them back with
    the new columns after it. Names that the user's columns have don't matter to it.
    """
    fed = df.select("*", column.alias(free_name(df, "in")))
    for f in fields:
        fed = fed.drop(f.name)
    names = fed.columns[:-1]
    plain = fed.toDF(*(f"c{i}" for i in range(len(names))), "fed")
    schema = T.StructType([*plain.schema.fields, *fields])
    return plain.mapInArrow(func, schema).drop("fed").toDF(*names, *(f.name for f in fields))


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """``df``, an aggregate by the long column ``key``, for a join on it.

    Spark would join an aggregate where its rows are, and can't then split the other
    side's rows of one key over tasks. Of a key that is computed it does not know where
    the rows are, so both sides are dealt for the join, and adaptive execution splits
    a large one. The aggregate itself, a row a key, is what is dealt once more.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for code that writes files of its own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

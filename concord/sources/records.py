"""Input records and results as JSON lines, JSON arrays and folders of texts.

A line's ordinal is its place among the lines of all files, files in order of their
paths. Lines of a block of a file are numbered as they are read; blocks, of which there
are few, are added up, so lines are neither sorted nor sent anywhere to be numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.labels import label_for_json, label_to_int


def _lines(spark: SparkSession, path: str, condition: str = "true") -> DataFrame:
    """(file, block, line_id, value) of the lines that ``condition`` holds for; within a block of a file line_ids follow one another."""
    # the ids are given after the filter, which Spark keeps below them
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").where(condition)
    return lines.select("file", "block", F.monotonically_increasing_id().alias("line_id"), "value")


def number_lines(lines: DataFrame, by_file: bool = False) -> DataFrame:
    """``lines`` of _lines() with ordinal, from 0: the number of lines before, of all files or, with ``by_file``, of the line's own.

    Only blocks meet, a row each: their first ids and the numbers of lines before them.
    """
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("__n"), F.min("line_id").alias("__first"))
    w = Window.partitionBy("file").orderBy("block") if by_file else Window.orderBy("file", "block")
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("__first")).alias("__shift"))
    # a row a block, which the driver's list of files has too
    rows = lines.join(F.broadcast(starts), ["file", "block"], "left")
    unknown = F.raise_error(F.concat(F.lit("the blocks of a file have changed: "), F.col("file"))).cast("long")
    return rows.withColumn("ordinal", F.when(F.col("__shift").isNull(), unknown).otherwise(F.col("line_id") + F.col("__shift"))).drop("__shift", "block")


def _strip(c) -> F.Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


_FILLED = r"value RLIKE '\\S'"


def _raw_fields(value: str, keys: list[str]) -> list:
    """The JSON text of each key's value; null for a missing key and for a JSON null."""
    parsed = F.try_parse_json(F.col(value))
    return [F.nullif(F.to_json(F.try_variant_get(parsed, f"$.{k}", "variant")), F.lit("null")) for k in keys]


def _string(raw):
    """A JSON value as text: a string's characters, anything else as it is written."""
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)


def read_records(spark: SparkSession, path: str, columns: dict[str, str], label_key: str = "label", limit: int | None = None, malformed: str = "raise") -> DataFrame:
    """Records of JSON lines: sample_id, one string column for each of ``columns`` (name: key), label long.

    sample_id is the ordinal among lines that are not blank, and ``limit`` counts those
    lines. A row without one of the keys, or with a label that is no integer, is left
    out. A line that is not JSON is an error, or left out if ``malformed`` is "skip";
    it has an ordinal either way.
    """
    rows = number_lines(_lines(spark, path, _FILLED))
    if limit is not None:
        rows = first_records(rows, limit, "ordinal")
    if malformed == "raise":
        # in the value itself, so that no later filter can drop the row before it fails
        message = F.concat(F.lit("invalid JSON at record "), F.col("ordinal").cast("string"))
        rows = rows.withColumn("value", F.when(F.try_parse_json("value").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("value")))
    raw = _raw_fields("value", [*columns.values(), label_key])
    found = rows.select(F.col("ordinal").alias("sample_id"), *(_string(r).alias(c) for r, c in zip(raw, columns, strict=False)), label_to_int(raw[-1]).alias("label"))
    return with_required(found, [*columns, "label"])


def read_text_records(spark: SparkSession, path: str, text_key: str = "text", label_key: str = "label", limit: int | None = None) -> DataFrame:
    """(sample_id, text, label)."""
    return read_records(spark, path, {"text": text_key}, label_key, limit)


def read_image_records(spark: SparkSession, path: str, image_key: str = "path", text_key: str = "caption", label_key: str = "label", limit: int | None = None) -> DataFrame:
    """(sample_id, path, caption, label)."""
    return read_records(spark, path, {"path": image_key, "caption": text_key}, label_key, limit)


def read_edit_records(spark: SparkSession, path: str, input_key: str = "input_path", output_key: str = "output_path", instruction_key: str = "instruction", label_key: str = "label", limit: int | None = None) -> DataFrame:
    """(sample_id, input_path, output_path, instruction, label); lines that are not JSON are left out but counted."""
    return read_records(spark, path, {"input_path": input_key, "output_path": output_key, "instruction": instruction_key}, label_key, limit, "skip")


def first_records(records: DataFrame, n: int, ordinal: str = "sample_id") -> DataFrame:
    """The records with the first ``n`` ordinals. It is no limit(): ids stay the same, and records that are left out count."""
    return records.where(F.col(ordinal) < n)


def with_required(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records in which none of the columns is null."""
    return records.dropna(subset=list(columns))


def read_video_records(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """(sample_id, line_idx, label string, video_path).

    line_idx counts all lines, blank ones too; sample_id is that of the record, or its
    id, if it is all digits, else line_idx. Records without video_path or label, and
    lines that are not JSON, are left out; ``max_samples`` counts those that stay.
    """
    rows = number_lines(_lines(spark, path)).where(_FILLED)
    sid, other, video, label = _raw_fields("value", ["sample_id", "id", "video_path", "label"])
    given = F.coalesce(_string(sid), _string(other))
    digits = F.when(given.rlike("^[0-9]+$"), given.try_cast("long"))
    found = rows.select(F.coalesce(digits, F.col("ordinal")).alias("sample_id"), F.col("ordinal").alias("line_idx"), label_for_json(label).alias("label"), _string(video).alias("video_path")).dropna(subset=["label", "video_path"])
    if max_samples is None:
        return found
    # only rows up to the limit are ever kept, so a top-n of the line numbers is enough
    last = found.select("line_idx").orderBy("line_idx").limit(max_samples).agg(F.max("line_idx").alias("__last"))
    return found.join(F.broadcast(last), F.col("line_idx") <= F.col("__last")).drop("__last")


def read_json_array(spark: SparkSession, path: str, columns: dict[str, str], label_key: str = "label", wrapped: bool = True, limit: int | None = None, strict_label: bool = False) -> DataFrame:
    """The same columns of a file that holds one JSON list, or, if ``wrapped``, an object with the list as data.

    sample_id is the place in the list; elements that are not objects are left out but
    counted. A record with a label that is no integer is left out, or, with
    ``strict_label``, an error. The list is one value, as such a file has to be parsed as
    a whole.
    """
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    as_list = F.expr("try_variant_get(v, '$', 'array<variant>')")
    inner = F.expr("try_variant_get(v, '$.data', 'array<variant>')") if wrapped else F.lit(None).cast("array<variant>")
    found = F.coalesce(as_list, inner)
    sure = F.when(found.isNull(), F.raise_error(F.lit("the file holds no list of records")).cast("array<variant>")).otherwise(found)
    rows = whole.select(F.posexplode(sure).alias("ordinal", "element")).withColumn("value", F.to_json("element"))
    if limit is not None:
        rows = first_records(rows, limit, "ordinal")
    raw = _raw_fields("value", [*columns.values(), label_key])
    label = label_to_int(raw[-1])
    if strict_label:
        message = F.concat(F.lit("a label that is no integer at record "), F.col("ordinal").cast("string"))
        label = F.when(raw[-1].isNotNull() & label.isNull(), F.raise_error(message).cast("long")).otherwise(label)
    found = rows.select(F.col("ordinal").cast("long").alias("sample_id"), *(_string(r).alias(c) for r, c in zip(raw, columns, strict=False)), label.alias("label"))
    return with_required(found, [*columns, "label"])


def read_edit_array(spark: SparkSession, path: str, input_key: str = "input_path", output_key: str = "output_path", instruction_key: str = "instruction", label_key: str = "label", limit: int | None = None) -> DataFrame:
    """read_edit_records() of a file that holds one JSON list; here a bad label is an error."""
    return read_json_array(spark, path, {"input_path": input_key, "output_path": output_key, "instruction": instruction_key}, label_key, False, limit, True)


def count_rows(spark: SparkSession, path: str) -> int:
    """How many rows of input there are at most, for progress: lines, blank ones too, or elements of a file with one JSON list."""
    if not path.endswith(".json"):
        return spark.read.text(path).count()
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = F.coalesce(F.expr("try_variant_get(v, '$', 'array<variant>')"), F.expr("try_variant_get(v, '$.data', 'array<variant>')"))
    return whole.agg(F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0]


def read_labelled_folders(spark: SparkSession, path: str, member: str = "member", other: str = "non-member") -> DataFrame:
    """(file, text, label): a text a file, label 1 below a folder called ``member``, 0 below ``other``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), _strip("value").alias("text"))
    folder = F.element_at(F.split("file", "/"), -2)
    return files.select("file", "text", F.when(folder == member, 1).when(folder == other, 0).alias("label")).where("label IS NOT NULL")


EVIDENCE = "struct<expected:double,pessimistic:double,optimistic:double,membership_score:double,num_trajectories:int,num_pairs:int,num_steps:int,num_positions:int,aggregation_topk:int,pair_mean_similarities:array<double>>"


def read_results(spark: SparkSession, path: str, label_key: str = "label", extra: str | None = None) -> DataFrame:
    """Result records of JSON lines: sample_id, label, status, membership_score, trajectory_evidence, ``extra`` fields, shard_path, line_no.

    Blank lines count but have no record. A line that is not a JSON object is an error
    that gives its number, from 1, in its file.
    """
    rows = number_lines(_lines(spark, path), by_file=True).withColumn("line_no", (F.col("ordinal") + 1).cast("int")).where(_FILLED)
    good = _strip("value").startswith("{") & F.try_parse_json("value").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("invalid record in "), F.col("file"), F.lit(" at line "), F.col("line_no").cast("string")))
    value = F.when(good, F.col("value")).otherwise(wrong.cast("string"))
    schema = T.StructType.fromDDL(f"sample_id long, `{label_key}` long, status string, membership_score double, trajectory_evidence {EVIDENCE}{f', {extra}' if extra else ''}")
    parsed = rows.select(F.from_json(value, schema).alias("r"), F.col("file").alias("shard_path"), "line_no")
    return parsed.select("r.*", "shard_path", "line_no")


def read_result_shards(spark: SparkSession, folder: str, label_key: str = "label") -> DataFrame:
    """Result records of all results_rank*.jsonl of a folder; shard_path sorts as text, so rank 10 comes before rank 2."""
    return read_results(spark, f"{folder.rstrip('/')}/results_rank*.jsonl", label_key)

"""Runs of a pathway, from input records and a model to result records that fusion reads.

A run's folder has results.jsonl (a folder of JSON lines), config.json, and below _shards
what the model gave: sequences and cells as Parquet and, if wanted, artifacts and
histories. What the model gives is written before it is read, so each of its calls is
made once, and a job that loses an executor goes on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.labels import binarise
from concord.functions.steps import parse_step_spec
from concord.functions.vectors import unit
from concord.operators import checks, consistency, generation, masking, metrics, resume, video
from concord.sources import records as rec
from concord.sources import sinks

#: Tokens that candidates are drawn from, and most tokens of a sequence, by pathway.
DEFAULTS = {"text": ("text", 1024), "image": ("image", 4096), "edit": ("image", 20480)}
#: Columns that make up the content of a record, by pathway.
CONTENT = {"text": ["text"], "image": ["path", "caption"], "edit": ["input_path", "output_path", "instruction"]}


def read_inputs(spark: SparkSession, pathway: str, path: str, keys: Sequence[str], label_key: str, limit: int | None = None) -> DataFrame:
    """(sample_id, content columns, label) of a file or folder of JSON lines, or of a .json file with one list."""
    names = CONTENT[pathway]
    if not path.endswith(".json"):
        return rec.read_records(spark, path, dict(zip(names, keys, strict=True)), label_key, limit, "skip" if pathway == "edit" else "raise")
    return rec.read_json_array(spark, path, dict(zip(names, keys, strict=True)), label_key, pathway == "text", limit, pathway == "edit")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a path and read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def auc_of_results(results: DataFrame, label: str = "label") -> float:
    """The ROC-AUC of result records, any label but 0 as 1; missing scores and labels count as 0."""
    rows = resume.with_default_scores(results, label).select(binarise(F.col(label)).alias("label"), F.col("membership_score").alias("score"))
    return metrics.roc_auc(rows).first().auc


def run_sequences(
    spark: SparkSession,
    inputs: DataFrame,
    pathway: str,
    model: Callable[[], generation.SequenceModel],
    output: str,
    *,
    label_key: str = "label",
    top_d: int = 32,
    domain: str | None = None,
    max_seq_len: int | None = None,
    mask_ratio: float = 0.5,
    num_trajectories: int = 4,
    steps: str = "18",
    aggregation_topk: int = 32,
    eps: float = 1e-8,
    seed: int = 1234,
    batch_size: int = 1,
    go_on: bool = True,
    save_probs: bool = True,
    save_denoise: bool = False,
    save_dtype: str = "float16",
) -> float:
    """Scores the records of a pathway (see read_inputs()) and gives the ROC-AUC of all results of the folder.

    With ``go_on`` the settings must be those of the runs before, records whose content
    has a result are left out, and results are added; else they are replaced. A record
    of which nothing can be masked has no result, in an edit run one that says so by its
    status; one of which nothing is scored is an error. Image records of equal content
    are run once. An edit run may go on under other settings, and of several results of
    a sample the last counts.
    """
    domain, most = domain or DEFAULTS[pathway][0], max_seq_len or DEFAULTS[pathway][1]
    kind, value = parse_step_spec(steps)
    given = {"top_d": top_d, "topk_domain": domain, "max_seq_len": most, "mask_ratio": mask_ratio, "num_trajectories": num_trajectories, "steps": str(steps), "aggregation_topk": aggregation_topk, "eps": eps, "seed": seed, "batch_size": batch_size}
    checks.check_run_settings(**{k: v for k, v in given.items() if k not in ("topk_domain", "steps", "seed")})
    results, config = f"{output}/results.jsonl", f"{output}/config.json"
    go_on = go_on and _exists(spark, results)
    if go_on and pathway != "edit" and _exists(spark, config):
        resume.check_config(sinks.read_config(spark, config), given)
    content = CONTENT[pathway]
    todo = resume.record_hash(inputs, [*content, "label"])
    if pathway == "image":
        todo = resume.drop_repeats(todo, ["record_hash"], "sample_id")
    if go_on:
        done = rec.read_results(spark, results, label_key, "record_hash decimal(20,0)").select("record_hash")
        todo = resume.remaining(todo, resume.processed_keys(done, keys=["record_hash"]), ["record_hash"])
    shards = f"{output}/_shards/{uuid.uuid4().hex}"
    todo = _kept(todo, f"{shards}/records")
    sequences = _kept(generation.clean_forward(todo.select("sample_id", *content), model, top_d, domain, most), f"{shards}/sequences")
    at = lambda flag: sequences.select("sample_id", F.posexplode(flag).alias("pos", "chosen")).where("chosen").select("sample_id", "pos")
    masks = masking.choose_masks(at("maskable"), num_trajectories, mask_ratio, seed)
    mask_id = model().mask_id
    made = generation.denoise(sequences, masks, sequences, model, steps, mask_id, seed, batch_size=batch_size, history=save_denoise)
    made = _kept(made, f"{shards}/cells")
    cells = made.where("pos >= 0").select("sample_id", "traj", "step", "pos", "v")
    found = consistency.evidence(cells, aggregation_topk, eps, at("selected"), means=True)
    extra = [F.lit(kind).alias("steps_mode"), F.lit(value).alias("steps_value"), F.lit(float(mask_ratio)).alias("mask_ratio"), F.lit(top_d).alias("top_d"), F.lit(domain).alias("topk_domain")]
    labels = todo.withColumnRenamed("label", label_key)
    scored = consistency.result_records(found, None, labels, label_key, [*content, "record_hash"]).select("*", F.lit("ok").alias("status"), *extra)
    if pathway == "edit":
        skipped = resume.remaining(labels, cells.select("sample_id"), ["sample_id"]).select("sample_id", label_key, *content, "record_hash", F.lit("skipped_insufficient_trajectories").alias("status"), *extra)
        scored = scored.unionByName(skipped, allowMissingColumns=True)
    sinks.write_results(scored, results, go_on)
    if save_probs:
        positions = sequences.select("sample_id", F.posexplode(F.arrays_zip("candidate_ids", "selected", "logp")).alias("pos", "p")).select("sample_id", "pos", "p.*")
        sinks.write_artifacts(cells, positions, f"{output}/_shards/probs", save_dtype)
    if save_denoise:
        history = made.where("pos = -1").select("sample_id", "traj", "step", "token_ids")
        meta = history.groupBy("sample_id", "traj").agg(F.max(F.size("token_ids")).alias("length"))
        sinks.write_history(masking.masked_counts(history, mask_id), meta, f"{output}/_shards/denoise/{uuid.uuid4().hex}", pathway)
    sinks.write_config(spark, given, config)
    found = rec.read_results(spark, results, label_key)
    if pathway == "edit":
        found = resume.ok_only(resume.keep_last(found, "sample_id", ["shard_path", "line_no"]))
    return auc_of_results(found, label_key)


def run_videos(spark: SparkSession, inputs: DataFrame, model: Callable[[], object], output: str, *, num_repeats: int = 4, base_seed: int = 1818, seed_stride: int = 100_000, go_on: bool = True) -> dict[str, int]:
    """Writes the similarity matrices of each record's generations, for fuse_video(); gives how many samples have each status.

    ``inputs`` is that of read_video_records(). With ``go_on``, samples that have a result
    with status ok are left out. A sample of which a generation fails has the reason as
    its status, and no matrix.
    """
    checks.check_run_settings(num_repeats=num_repeats)
    results = f"{output}/results.jsonl"
    todo = inputs.select("sample_id", "line_idx", "video_path", F.col("label").try_cast("long").alias("label")).where("label IS NOT NULL")
    go_on = go_on and _exists(spark, results)
    if go_on:
        done = rec.read_results(spark, results).where("status = 'ok'")
        todo = resume.remaining(todo, done, ["sample_id"])
    shards = f"{output}/_shards/{uuid.uuid4().hex}"
    features = _kept(generation.generation_features(todo.select("sample_id", "video_path"), model, num_repeats, base_seed, seed_stride), f"{shards}/features")
    status = features.groupBy("sample_id").agg(F.coalesce(F.max(F.when(F.col("status") != "ok", F.col("status"))), F.lit("ok")).alias("status"))
    status = _kept(todo.join(status, "sample_id"), f"{shards}/status")
    whole = features.join(status.where("status = 'ok'"), "sample_id", "left_semi")
    pairs = video.generation_pairs(whole.select("sample_id", "generation", "frame", unit(F.col("z")).alias("z")))
    sinks.write_matrices(pairs.join(status.select("sample_id", "label"), "sample_id"), f"{output}/samples", status)
    rows = resume.order_results(status.select("sample_id", "label", "status", F.col("line_idx").alias("record_index")))
    sinks.write_results(rows, results, go_on)
    sinks.write_config(spark, {"num_repeats": num_repeats, "base_seed": base_seed, "seed_stride": seed_stride}, f"{output}/config.json")
    return {r.status: r.n for r in resume.status_counts(rec.read_results(spark, results)).collect()}

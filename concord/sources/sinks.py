"""Writers of results, fused documents, histories, tables of cells and pairs, settings and summaries."""

from __future__ import annotations

import functools
import io
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.generation import dealt


def write_results(df: DataFrame, path: str, resume: bool = False) -> None:
    """Result records as JSON lines; a resumed run adds to what is there."""
    df.write.mode("append" if resume else "overwrite").option("ignoreNullFields", "false").json(path)


def write_fused(fused: DataFrame, auc: DataFrame, feature_names: list[str], method: str, path: str) -> None:
    """One JSON document {method, feature_names, auc, samples}.

    It is one value by its format, so its samples meet in one task; for many samples
    write_results() keeps them apart.
    """
    by_id = lambda a, b: F.when(a["sample_id"] < b["sample_id"], -1).when(a["sample_id"] > b["sample_id"], 1).otherwise(0)
    samples = fused.agg(F.array_sort(F.collect_list(F.struct(*fused.columns)), by_id).alias("samples"))
    value = F.when(F.isnan("auc"), F.lit(None)).otherwise(F.col("auc"))
    doc = samples.crossJoin(auc.limit(1)).select(F.to_json(F.struct(F.lit(method).alias("method"), F.array(*map(F.lit, feature_names)).alias("feature_names"), value.alias("auc"), "samples"), {"pretty": "true"}))
    doc.coalesce(1).write.mode("overwrite").text(path)


def write_cells(cells: DataFrame, path: str, pathway: str) -> None:
    """Trajectory cells as Parquet, a folder a pathway; vectors in single precision."""
    cells.withColumn("v", F.col("v").cast("array<float>")).withColumn("pathway", F.lit(pathway)).write.mode("append").partitionBy("pathway").parquet(path)


@functools.cache
def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _put(folder: str, files: Mapping[str, bytes]) -> None:
    """Writes files of one folder, by name."""
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    for name, data in files.items():
        with system.open_output_stream(f"{path.rstrip('/')}/{name}", compression=None) as f:
            f.write(data)


def write_artifacts(cells: DataFrame, positions: DataFrame, folder: str, dtype: str = "float16") -> int:
    """Compressed trajectory artifacts, ``folder``/sample_<id>.npz, as read_artifacts() reads them; gives their number.

    ``cells`` is (sample_id, traj, step, pos, v), ``positions`` (sample_id, pos,
    candidate_ids array<int>, selected, logp). Positions that do not begin at 0 are
    written with their allowed_range. A sample meets in one task, as it is one file; a
    task that is run again writes the same files. ``folder`` has to be shared.
    """
    if dtype not in ("float16", "float32"):
        raise ValueError(f"unknown type of artifacts: {dtype!r}")

    def run(key: tuple, cells: pd.DataFrame, positions: pd.DataFrame) -> pd.DataFrame:
        if cells.empty:
            return pd.DataFrame({"sample_id": pd.Series([], dtype="int64")})
        cells, positions = cells.sort_values(["traj", "step", "pos"]), positions.sort_values("pos")
        t, s, n = (cells[c].nunique() for c in ("traj", "step", "pos"))
        first = int(positions["pos"].min())
        extra = {"allowed_range": np.array([first, first + n], np.int32)} if first else {}
        out = io.BytesIO()
        np.savez_compressed(
            out,
            trajectory_probabilities=np.stack(cells["v"].tolist()).reshape(t, s, n, -1).astype(dtype),
            candidate_ids=np.stack(positions["candidate_ids"].tolist()).astype(np.int32),
            semantic_position_mask=positions["selected"].to_numpy(bool),
            observed_token_log_probabilities=positions["logp"].to_numpy(dtype),
            **extra,
        )
        _put(folder, {f"sample_{key[0]}.npz": out.getvalue()})
        return pd.DataFrame({"sample_id": [key[0]]})

    # both may come of one table; what is grouped then needs columns of its own
    positions = positions.select((F.col("sample_id") + 0).alias("sample_id"), *(F.col(c).alias(c) for c in ("pos", "candidate_ids", "selected", "logp")))
    groups = cells.groupBy("sample_id").cogroup(positions.groupBy("sample_id"))
    return groups.applyInPandas(run, "sample_id long").count()


def write_matrices(pairs: DataFrame, folder: str, status: DataFrame | None = None) -> int:
    """Folders ``folder``/sample_<id> with a similarity matrix, its row map and a description, as read_sample_folders() reads them; gives their number.

    ``pairs`` is (sample_id, label, pair_type, i, j, frame, sim); a row of a matrix is a
    pair, in order. ``status`` (sample_id, label, status) describes samples without a
    matrix, such as those that were skipped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                frames, column = np.unique(r.frame, return_inverse=True)
                keys = list(zip(r.pair_type, r.i.tolist(), r.j.tolist(), strict=True))  # in order, the cells of a pair together
                place = {k: n for n, k in enumerate(dict.fromkeys(keys))}
                at = np.array([place[k] for k in keys]) * len(frames) + column
                if len(np.unique(at)) < len(at):
                    raise ValueError(f"a similarity is there twice: sample {r.sample_id}")
                matrix = np.full(len(place) * len(frames), np.nan, np.float32)
                matrix[at] = r.sim
                out = io.BytesIO()
                np.save(out, matrix.reshape(len(place), len(frames)))
                row_map = json.dumps([{"pair_type": p, "i": i, "j": j} for p, i, j in place])
                meta = json.dumps({"status": "ok", "sample_id": int(r.sample_id), "label": int(r.label)})
                _put(f"{folder.rstrip('/')}/sample_{r.sample_id:06d}", {"similarity_matrix.npy": out.getvalue(), "similarity_row_map.json": row_map.encode(), "sample_meta.json": meta.encode()})
            yield b[["sample_id"]]

    def describe(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                _put(f"{folder.rstrip('/')}/sample_{r.sample_id:06d}", {"sample_meta.json": json.dumps({"status": r.status, "sample_id": int(r.sample_id), "label": int(r.label)}).encode()})
            yield b[["sample_id"]]

    if status is not None:
        status.where("status <> 'ok'").select("sample_id", "label", "status").mapInPandas(describe, "sample_id long").count()
    cells = F.array_sort(F.collect_list(F.struct("pair_type", "i", "j", "frame", F.col("sim").cast("float").alias("sim"))))
    samples = pairs.groupBy("sample_id").agg(F.min("label").alias("label"), cells.alias("c"))
    samples = samples.select("sample_id", "label", *(F.col(f"c.{n}").alias(n) for n in ("pair_type", "i", "j", "frame", "sim")))
    # three files a sample take long for their few bytes
    return dealt(samples, "sample_id").mapInPandas(run, "sample_id long").count()


def write_pairs(pairs: DataFrame, path: str, pathway: str) -> None:
    """Melted similarities as Parquet, a folder a pathway."""
    pairs.withColumn("pathway", F.lit(pathway)).write.mode("append").partitionBy("pathway").parquet(path)


#: Shapes of a history's lines by pathway: whether they have a type and a meta line, and whether tokens end with the sequence.
HISTORIES = {"text": (True, True), "image": (True, True), "edit": (False, False)}


def history_lines(history: DataFrame, meta: DataFrame, pathway: str = "text") -> DataFrame:
    """(sample_id, traj, step, value): a meta line, of step -1, then a line a step with its tokens.

    ``history`` is (sample_id, traj, step, token_ids), for text also masked and text,
    ``meta`` (sample_id, traj, length, ...). Text has the decoded text and the count of
    masks, image has not; both cut tokens off at the sequence's length. Edit has neither
    a type nor a meta line and cuts nothing off.
    """
    typed, trimmed = HISTORIES[pathway]
    rows = history
    if trimmed and "length" in meta.columns:
        lengths = meta.select("sample_id", "traj", "length")
        rows = rows.join(lengths, ["sample_id", "traj"], "left").withColumn("token_ids", F.slice("token_ids", F.lit(1), F.coalesce("length", F.size("token_ids"))))
    kept = ["step", "token_ids"] if pathway != "text" else ["step", "token_ids", *(c for c in ("text", "masked") if c in history.columns)]
    steps = rows.select("sample_id", "traj", "step", F.to_json(F.struct(*([F.lit("step").alias("type")] if typed else []), "sample_id", F.col("traj").alias("trajectory_id"), *kept)).alias("value"))
    if not typed:
        return steps
    heads = meta.select("sample_id", "traj", F.lit(-1).alias("step"), F.to_json(F.struct(F.lit("meta").alias("type"), *(c for c in meta.columns))).alias("value"))
    return heads.unionByName(steps)


def write_history(history: DataFrame, meta: DataFrame, path: str, pathway: str = "text") -> None:
    """history_lines() as text, in order within each sample and trajectory."""
    lines = history_lines(history, meta, pathway)
    lines.repartition("sample_id", "traj").sortWithinPartitions("sample_id", "traj", "step").select("value").write.mode("overwrite").text(path)


def write_config(spark: SparkSession, settings: Mapping, path: str) -> None:
    """The settings of a run, as one line of JSON; written when the run is complete."""
    spark.range(1).select(F.lit(json.dumps(dict(settings), sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def run_summary(results: DataFrame, settings: Mapping) -> DataFrame:
    """(summary): JSON with the settings and the number of results of each status."""
    counts = results.groupBy("status").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses")).select(
        F.to_json(F.struct("statuses", F.lit(json.dumps(dict(settings), sort_keys=True)).alias("settings"))).alias("summary")
    )

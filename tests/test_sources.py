import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import fusion, resume
from concord.plans import round_trips
from concord.sources import arrays, records, sinks
from concord.streaming import evidence as streaming
from tests import kernel


def _write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_text_records_keep_their_ordinals(spark, tmp_path):
    rows = [{"text": "a", "label": 1}, "", {"text": None, "label": 1}, {"text": "b é", "label": "0", "url": "x"}, "   ", {"text": "c", "label": "no"}, {"text": 'q"uote', "label": True}]
    p = _write(tmp_path / "a.jsonl", rows)
    got = [tuple(r) for r in records.read_text_records(spark, p).orderBy("sample_id").collect()]
    assert got == [(0, "a", 1), (2, "b é", 0), (4, 'q"uote', 1)]
    assert records.read_text_records(spark, p, limit=3).count() == 2
    bad = _write(tmp_path / "b.jsonl", [{"text": "a", "label": 1}, "{oops"])
    with pytest.raises(Exception, match="invalid JSON at record 1"):
        records.read_text_records(spark, bad).collect()


def test_ordinals_over_files(spark, tmp_path):
    for i in range(3):
        _write(tmp_path / f"{i}.jsonl", [{"text": f"{i}.{j}", "label": 0} for j in range(4)])
    got = {r.text: r.sample_id for r in records.read_text_records(spark, str(tmp_path)).collect()}
    assert got == {f"{i}.{j}": 4 * i + j for i in range(3) for j in range(4)}


def test_edit_records_skip_bad_lines_but_count_them(spark, tmp_path):
    good = {"input_path": "i", "output_path": "o", "instruction": "do", "label": 1}
    p = _write(tmp_path / "e.jsonl", ["{oops", good, {**good, "label": "x"}, good])
    assert [r.sample_id for r in records.read_edit_records(spark, p).orderBy("sample_id").collect()] == [1, 3]


def test_video_records(spark, tmp_path):
    rows = [{"video_path": "a", "label": 1, "id": "77"}, "", {"video_path": "b", "label": "x", "sample_id": -5}, "{oops", {"label": 1}, {"video_path": "c", "label": 0, "sample_id": 8, "id": 9}]
    p = _write(tmp_path / "v.jsonl", rows)
    got = [tuple(r) for r in records.read_video_records(spark, p).orderBy("line_idx").collect()]
    assert got == [(77, 0, "1", "a"), (2, 2, "x", "b"), (8, 5, "0", "c")]
    assert records.read_video_records(spark, p, 2).count() == 2


def test_json_arrays(spark, tmp_path):
    rows = [{"path": "p", "caption": "c", "label": 1}, 5, {"path": "p"}, {"path": "q", "caption": "d", "label": 0}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"data": rows}))
    columns = {"path": "path", "caption": "caption"}
    for name in ("a.json", "b.json"):
        got = records.read_json_array(spark, str(tmp_path / name), columns).orderBy("sample_id").collect()
        assert [r.sample_id for r in got] == [0, 3]
    with pytest.raises(Exception, match="no list"):
        records.read_json_array(spark, str(tmp_path / "b.json"), columns, wrapped=False).collect()


def test_labelled_folders(spark, tmp_path):
    for folder, text in (("member", "one"), ("non-member", "two"), ("other", "three")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.0.txt").write_text(text + "\n")
    got = {(r.text, r.label) for r in records.read_labelled_folders(spark, str(tmp_path)).collect()}
    assert got == {("one", 1), ("two", 0)}


def test_results_round_trip_and_merge(spark, tmp_path):
    e = {"expected": 1.0, "pessimistic": 0.5, "optimistic": 1.5}
    rec = lambda i, y, s="ok", **k: {"sample_id": i, "label": y, "status": s, "trajectory_evidence": e} | k
    _write(tmp_path / "results_rank2.jsonl", [rec(1, 1), "", rec(2, 0)])
    _write(tmp_path / "results_rank10.jsonl", [rec(1, 0, "failed")])
    df = records.read_result_shards(spark, str(tmp_path))
    merged = resume.keep_last(df, "sample_id", ["shard_path", "line_no"])
    assert {(r.sample_id, r.label) for r in resume.ok_only(merged).collect()} == {(1, 1), (2, 0)}
    assert df.where("sample_id = 2").first().line_no == 3
    bad = _write(tmp_path / "bad.jsonl", [rec(1, 1), "[1]"])
    with pytest.raises(Exception, match="line 2"):
        records.read_results(spark, bad).collect()
    fused = fusion.fuse_pathways([("text", resume.ok_only(merged))])
    sinks.write_fused(fused, fusion.fused_auc(fused), ["text.expected"], "sum", str(tmp_path / "fused"))
    doc = json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "fused"), wholetext=True).collect()))
    assert doc["auc"] == 0.5 and len(doc["samples"]) == 2
    sinks.write_results(merged, str(tmp_path / "out"))
    sinks.write_results(merged, str(tmp_path / "out"), resume=True)
    assert records.read_results(spark, str(tmp_path / "out")).count() == 4
    sinks.write_config(spark, {"steps": 4}, str(tmp_path / "config"))
    assert sinks.read_config(spark, str(tmp_path / "config")) == {"steps": 4}
    assert '"ok"' in sinks.run_summary(df, {"k": 1}).first().summary


def test_arrays(spark, tmp_path):
    for name, status, value in (("s1", "ok", 0.5), ("s2", "failed", 0.1), ("s3", "ok", 0.25)):
        d = tmp_path / "v" / name
        d.mkdir(parents=True)
        np.save(d / "similarity_matrix.npy", np.full((1, 2), value, np.float32))
        (d / "similarity_row_map.json").write_text(json.dumps([{"pair_type": "gen_gen", "i": 0, "j": 1}]))
        (d / ("meta.json" if name == "s1" else "sample_meta.json")).write_text(json.dumps({"status": status, "sample_id": 4, "label": 1}))
    got = arrays.read_sample_folders(spark, str(tmp_path / "v")).collect()
    assert len(got) == 1 and got[0].matrix == [[0.25, 0.25]]
    np.save(tmp_path / "flat.npy", np.zeros(3))
    with pytest.raises(Exception, match="two-dimensional"):
        arrays.read_matrices(spark, str(tmp_path / "flat.npy")).collect()
    p = np.random.default_rng(0).random((2, 3, 4, 5)).astype(np.float16)
    np.savez_compressed(tmp_path / "t.npz", trajectory_probabilities=p, semantic_position_mask=np.array([1, 0, 1, 1], bool), candidate_ids=np.arange(20).reshape(4, 5), observed_token_log_probabilities=np.zeros(4, np.float16))
    cells = arrays.read_artifacts(spark, str(tmp_path / "t.npz"))
    assert cells.count() == 24 and cells.where("selected").count() == 18
    r = cells.where("traj = 1 AND step = 2 AND pos = 3").first()
    assert np.allclose(r.v, p[1, 2, 3].astype(float), atol=0)
    assert arrays.read_artifact_candidates(spark, str(tmp_path / "t.npz")).where("pos = 3 AND rank = 1").first().token_id == 16


@pytest.mark.parametrize("by_table", [False, True])
def test_streaming_scores_each_sample_once_it_is_complete(spark, tmp_path, by_table):
    a = np.random.default_rng(0).random((2, 2, 2, 3))
    cells, out, mark = (str(tmp_path / x) for x in ("cells", "out", "mark"))
    size = spark.createDataFrame([(i, 8) for i in (0, 1, 8, 9)], "sample_id long, cells int") if by_table else 8
    nine, eight = kernel.cells(a, 9), kernel.cells(a, 8)
    arriving = [kernel.cells(a, 0) + nine[:3], nine[3:] + nine[:2] + eight[:1], kernel.cells(a, 1) + nine, eight[1:5]]
    done = [[0], [0, 9], [0, 1, 9], [0, 1, 9]]
    for rows, want in zip(arriving, done, strict=True):
        spark.createDataFrame(rows, kernel.CELLS).coalesce(1).write.mode("append").parquet(cells)
        streaming.start(spark, cells, out, mark, size, 2).awaitTermination()
        got = streaming.read_scores(spark, out).collect()
        assert sorted(r.sample_id for r in got) == want
        assert all(math.isclose(r.expected, kernel.views(kernel.pair_cosines(a), 2)[0]) for r in got)
    # a batch that is run again leaves what it left before
    batch = spark.createDataFrame(eight[5:], kernel.CELLS)
    for _ in range(2):
        streaming.score_batch(batch, 4, out, size, 2, 1e-8)
        assert sorted(r.sample_id for r in streaming.read_scores(spark, out).collect()) == [0, 1, 8, 9]


def test_artifacts_and_matrices_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.random((2, 3, 4, 5))
    cells = spark.createDataFrame([(i, t, s, p + 6 * i, v) for i in (0, 1) for _, t, s, p, v in kernel.cells(a, i)], kernel.CELLS)
    positions = spark.createDataFrame([(i, p + 6 * i, [p, 1, 2, 3, 4], p % 2 == 0, -0.5 * p) for i in (0, 1) for p in range(4)], "sample_id long, pos int, candidate_ids array<int>, selected boolean, logp double")
    assert sinks.write_artifacts(cells, positions, str(tmp_path / "npz"), "float32") == 2
    back = arrays.read_artifacts(spark, str(tmp_path / "npz"))
    got = {(r.path[-5], r.traj, r.step, r.pos): (r.v, r.selected) for r in back.collect()}
    assert len(got) == 48 and all(np.allclose(v, a[t, s, p - 6 * int(i)], atol=1e-6) and sel == (p % 2 == 0) for (i, t, s, p), (v, sel) in got.items())
    ranges = {r.path[-5]: (r.start, r.end) for r in arrays.read_artifact_ranges(spark, str(tmp_path / "npz")).collect()}
    assert ranges == {"0": (None, None), "1": (6, 10)}
    assert arrays.read_artifact_candidates(spark, str(tmp_path / "npz")).where("pos = 8 AND rank = 0").first().token_id == 2
    with pytest.raises(ValueError):
        sinks.write_artifacts(cells, positions, str(tmp_path / "npz"), "int8")
    pairs = spark.createDataFrame([(7, 1, "gen_gen", i, j, f, 0.1 * f + i) for i, j in ((0, 1), (0, 2), (1, 2)) for f in range(3)], "sample_id long, label long, pair_type string, i int, j int, frame int, sim double")
    skipped = spark.createDataFrame([(8, 0, "too_short"), (7, 1, "ok")], "sample_id long, label long, status string")
    assert sinks.write_matrices(pairs, str(tmp_path / "v"), skipped) == 1
    m = arrays.read_sample_folders(spark, str(tmp_path / "v")).collect()
    assert len(m) == 1 and np.allclose(m[0].matrix, [[0, 0.1, 0.2], [0, 0.1, 0.2], [1, 1.1, 1.2]]) and [(x.i, x.j) for x in m[0].row_map] == [(0, 1), (0, 2), (1, 2)]


def test_image_and_edit_records(spark, tmp_path):
    p = _write(tmp_path / "i.jsonl", [{"path": "a.png", "caption": "x", "label": 1}, {"path": "b.png", "label": 1}, {"path": "c.png", "caption": "y", "label": "0"}])
    assert [tuple(r) for r in records.read_image_records(spark, p).orderBy("sample_id").collect()] == [(0, "a.png", "x", 1), (2, "c.png", "y", 0)]
    good = {"input_path": "i", "output_path": "o", "instruction": "do", "label": 1}
    (tmp_path / "e.json").write_text(json.dumps([good, 3, {**good, "label": None}]))
    assert [r.sample_id for r in records.read_edit_array(spark, str(tmp_path / "e.json")).collect()] == [0]
    (tmp_path / "bad.json").write_text(json.dumps([good, {**good, "label": "x"}]))
    with pytest.raises(Exception, match="no integer at record 1"):
        records.read_edit_array(spark, str(tmp_path / "bad.json")).collect()
    assert records.count_rows(spark, str(tmp_path / "e.json")) == 3 and records.count_rows(spark, p) == 3


def test_histories_of_each_pathway(spark):
    h = spark.createDataFrame([(0, 1, 0, [9, 1, 9, 0], 2)], "sample_id long, traj int, step int, token_ids array<int>, masked int")
    meta = spark.createDataFrame([(0, 1, 3)], "sample_id long, traj int, length int")
    lines = {p: [json.loads(r.value) for r in sinks.history_lines(h, meta, p).orderBy("step").collect()] for p in sinks.HISTORIES}
    assert [x["type"] for x in lines["text"]] == [x["type"] for x in lines["image"]] == ["meta", "step"]
    assert lines["text"][1]["token_ids"] == [9, 1, 9] and lines["text"][1]["masked"] == 2 and "masked" not in lines["image"][1]
    assert lines["edit"] == [{"sample_id": 0, "trajectory_id": 1, "step": 0, "token_ids": [9, 1, 9, 0]}]


def test_windows_of_a_stream(spark, sf, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    query = streaming.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.fixture
def small_blocks(spark):
    """Files are read 2,000 bytes at a time, and shuffles keep their partitions."""
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_where_they_are_read(spark, tmp_path, small_blocks):
    rows = [{"text": f"text {i}", "label": i % 2} if i % 3 else "" for i in range(900)]
    for name in ("b.jsonl", "a.jsonl"):
        _write(tmp_path / name, [{"text": f"{name} {i}", "label": 1} for i in range(100)] if name == "b.jsonl" else rows)
    found = records.read_text_records(spark, str(tmp_path))
    want = [(n, f"text {i}") for n, i in enumerate(i for i in range(900) if i % 3)] + [(600 + i, f"b.jsonl {i}") for i in range(100)]
    assert [(r.sample_id, r.text) for r in found.orderBy("sample_id").collect()] == want
    assert found.select(F.spark_partition_id()).distinct().count() > 5  # so many blocks, not so many partitions of a shuffle
    assert [r.text for r in records.read_text_records(spark, str(tmp_path), limit=2).orderBy("sample_id").collect()] == ["text 1", "text 2"]


def test_records_of_a_query_are_written_by_several_tasks(spark, sf, small_blocks):
    path = round_trips._text_lines(spark, sf)
    assert len(spark.read.text(path).inputFiles()) > 1
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").where("doc_id % 7 <> 3").select("doc_id").orderBy("doc_id").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = records.read_text_records(spark, path).collect()
    assert found and all(texts[ids[r.sample_id]] == r.text for r in found)


def test_records_of_a_larger_table_are_written_by_more_tasks_than_a_shuffle_has(spark, sf, tmp_path, small_blocks, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    size = os.path.getsize(f"{sf}/documents.parquet")
    monkeypatch.setattr(round_trips, "_TASK_BYTES", size // 10, raising=False)
    value = F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5("text"))
    path = round_trips._lines(docs.select("doc_id", value.alias("value")), "doc_id", str(tmp_path / "lines"))
    files = sorted((tmp_path / "lines").glob("part-*"))
    assert len(files) > int(spark.conf.get("spark.sql.shuffle.partitions")) + 2
    assert [x for f in files for x in f.read_text().splitlines()] == [r.v for r in docs.orderBy("doc_id").select(value.alias("v")).collect()]
    assert records.count_rows(spark, path) == docs.count()


def test_lines_of_a_large_result_file_are_numbered_where_they_are_read(spark, tmp_path, small_blocks):
    rows = [{"sample_id": i % 50, "label": i % 2, "status": str(i)} if i % 4 else "" for i in range(600)]
    for rank in (0, 10):
        _write(tmp_path / f"results_rank{rank}.jsonl", rows)
    found = records.read_result_shards(spark, str(tmp_path))
    assert sorted((r.line_no, r.status) for r in found.collect()) == sorted([(i + 1, str(i)) for i in range(600) if i % 4] * 2)
    assert found.select(F.spark_partition_id().alias("p"), "line_no").where("line_no > 0").select("p").distinct().count() > 5


def test_sample_folders_are_listed_once_and_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = [(s, 1, "gen_gen", i, j, f, (s + i + j + f) / 8) for s in range(30) for i, j in ((1, 2), (0, 2), (0, 1)) for f in (3, 0, 11) if (i, f) != (1, 11)]
    pairs = spark.createDataFrame(rows, "sample_id long, label int, pair_type string, i int, j int, frame int, sim double")
    assert sinks.write_matrices(pairs, str(tmp_path / "m")) == 30
    seen, load = [], type(spark.read).load
    monkeypatch.setattr(type(spark.read), "load", lambda self, *a, **k: seen.append(a) or load(self, *a, **k))
    found = arrays.read_sample_folders(spark, str(tmp_path / "m"))
    assert len(seen) == 1
    got = {r.sample_id: r for r in found.collect()}
    assert sorted(got) == list(range(30)) and [(m.i, m.j) for m in got[7].row_map] == [(0, 1), (0, 2), (1, 2)]
    assert np.allclose(got[7].matrix, [[1.0, 1.375, 2.375], [1.125, 1.5, 2.5], [1.25, 1.625, math.nan]], equal_nan=True)
    with pytest.raises(Exception, match="there twice"):
        sinks.write_matrices(pairs.union(pairs.limit(1)), str(tmp_path / "twice"))


def test_many_sample_folders_are_listed_by_few_tasks(spark, tmp_path):
    pairs = spark.range(90).selectExpr("id AS sample_id", "1 AS label", "'gen_gen' AS pair_type", "0 AS i", "1 AS j", "0 AS frame", "id / 128D AS sim")
    assert sinks.write_matrices(pairs, str(tmp_path / "m")) == 90
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    group, tracker = "listing of sample folders", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = arrays.read_sample_folders(spark, str(tmp_path / "m"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) <= 16
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert {r.sample_id: r.matrix for r in found.collect()} == {s: [[s / 128]] for s in range(90)}

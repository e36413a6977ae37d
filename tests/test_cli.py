import json

import numpy as np
import pytest

from concord import cli
from concord.sources import records
from tests import kernel


def _results(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"sample_id": i, "label": y, "trajectory_evidence": dict(zip(("expected", "pessimistic", "optimistic"), e, strict=True))}) + "\n" for i, y, e in rows))
    return str(path)


def test_fuse(spark, tmp_path, capsys):
    a = _results(tmp_path / "text" / "results.jsonl", [(0, 1, (1, 1, 1)), (1, 0, (0, 0, 0))])
    b = _results(tmp_path / "image.jsonl", [(1, 0, (0, 0, 1)), (0, 1, (1, 0, 0))])
    cli.main(["fuse", "--pathway-results", a, b, "--output", str(tmp_path / "out")])
    assert "AUC=1.000000" in capsys.readouterr().out
    doc = json.loads(spark.read.text(str(tmp_path / "out"), wholetext=True).first().value)
    assert doc["feature_names"][0] == "text.expected" and doc["samples"][0]["membership_score"] == 4.0
    twice = _results(tmp_path / "twice.jsonl", [(0, 1, (1, 1, 1)), (0, 1, (1, 1, 1))])
    with pytest.raises(ValueError, match="duplicate"):
        cli.main(["fuse", "--pathway-results", a, twice, "--output", str(tmp_path / "out")])


def test_video_fuse(spark, tmp_path, capsys):
    for name, i, y, x in (("s0", 0, 1, 0.9), ("s1", 1, 0, 0.2)):
        d = tmp_path / "movie" / name
        d.mkdir(parents=True)
        np.save(d / "similarity_matrix.npy", np.full((1, 3), x, np.float32))
        (d / "similarity_row_map.json").write_text(json.dumps([{"pair_type": "gen_gen", "i": 0, "j": 1}]))
        (d / "sample_meta.json").write_text(json.dumps({"status": "ok", "sample_id": i, "label": y}))
    cli.main(["video-fuse", str(tmp_path / "movie"), "--output", str(tmp_path / "out")])
    assert "AUC=1.000000" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["video-fuse", str(tmp_path / "movie"), "--output", str(tmp_path / "out"), "--aggregation-topk", "0"])


def test_score_and_resume(spark, tmp_path):
    p = np.random.default_rng(0).random((2, 3, 4, 5))
    (tmp_path / "npz").mkdir()
    for i in range(2):
        np.savez_compressed(tmp_path / "npz" / f"sample_{i}.npz", trajectory_probabilities=p + i, semantic_position_mask=np.array([1, 0, 1, 1], bool), candidate_ids=np.zeros((4, 5)), observed_token_log_probabilities=np.zeros(4))
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"text": "t", "label": i}) + "\n" for i in range(2)))
    args = ["score", str(tmp_path / "npz"), "--labels", str(tmp_path / "in.jsonl"), "--output", str(tmp_path / "out"), "--aggregation_topk", "2"]
    cli.main(args)
    cli.main([*args, "--resume"])
    got = spark.read.json(str(tmp_path / "out")).where("sample_id = 0").collect()
    assert len(got) == 1
    want = kernel.views(kernel.pair_cosines(p[:, :, [0, 2, 3]]), 2)
    e = got[0].trajectory_evidence
    assert np.allclose([e.expected, e.pessimistic, e.optimistic], want) and e.num_positions == 3


def _lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def _words(i, known):
    return f"{'known' if known else 'other'} " + " ".join(f"w{i}x{k}" for k in range(6 + i % 3))


def test_runs_of_sequences_are_fused(spark, tmp_path, capsys):
    text = _lines(tmp_path / "t.jsonl", [{"text": _words(i, i % 2), "label": i % 2} for i in range(6)])
    image = _lines(tmp_path / "i.jsonl", [{"path": _words(i, i % 2), "caption": "c", "label": i % 2} for i in range(6)])
    (tmp_path / "e.json").write_text(json.dumps([{"input_path": _words(i, i % 2), "output_path": "o", "instruction": "do", "label": i % 2} for i in range(6)]))
    options = ["--model", "tests.toy:Sequences", "--top_d", "4", "--num_trajectories", "3", "--steps", "0.5"]
    for pathway, path in (("text", text), ("image", image), ("edit", str(tmp_path / "e.json"))):
        cli.main([pathway, "--input_path", path, "--output_dir", str(tmp_path / pathway), *options])
        assert "AUC=1.000000" in capsys.readouterr().out
    cli.main(["fuse", "--pathway-results", *(str(tmp_path / p / "results.jsonl") for p in ("text", "image", "edit")), "--output", str(tmp_path / "fused")])
    assert "AUC=1.000000" in capsys.readouterr().out
    doc = json.loads(spark.read.text(str(tmp_path / "fused"), wholetext=True).first().value)
    assert doc["feature_names"][::3] == ["text.expected", "image.expected", "edit.expected"] and len(doc["samples"]) == 6
    # the artifacts of the run score as the run did
    cli.main(["score", str(tmp_path / "text" / "_shards" / "probs"), "--labels", text, "--output", str(tmp_path / "again")])
    read = lambda p: {r.sample_id: r.membership_score for r in records.read_results(spark, str(p)).collect()}
    one, two = read(tmp_path / "text" / "results.jsonl"), read(tmp_path / "again")
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 0.01 for i in one)  # artifacts have half precision


def test_a_run_goes_on_and_batches_change_nothing(spark, tmp_path, capsys):
    rows = [{"text": _words(i, i % 2), "label": i % 2} for i in range(7)]
    args = ["--top_d", "4", "--num_trajectories", "2", "--steps", "3", "--no_save_probs"]
    path = _lines(tmp_path / "t.jsonl", rows[:4])
    run = lambda model, out, *more: cli.main(["text", "--input_path", path, "--output_dir", str(tmp_path / out), "--model", f"tests.toy:{model}", *args, *more])
    run("Sequences", "a")
    _lines(tmp_path / "t.jsonl", [*rows, rows[0]])  # the last line repeats the first
    run("Sequences", "a")
    run("Batches", "b", "--batch_size", "5")
    read = lambda p: {r.sample_id: r.membership_score for r in records.read_results(spark, str(tmp_path / p / "results.jsonl")).collect()}
    one, two = read("a"), read("b")
    assert sorted(one) == list(range(7)) and records.read_results(spark, str(tmp_path / "a" / "results.jsonl")).count() == 7
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)
    lines = [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "a" / "_shards" / "denoise")).collect()]
    assert {x["type"] for x in lines} == {"meta", "step"} and all(len(x["token_ids"]) > 5 and x["masked"] >= 0 for x in lines if x["type"] == "step")
    with pytest.raises(ValueError, match="seed"):
        run("Sequences", "a", "--seed", "5")
    run("Sequences", "a", "--seed", "5", "--no_resume")
    assert len(read("a")) == 8  # records of equal text are run each
    with pytest.raises(ValueError, match="module:factory"):
        cli.factory("tests.toy")
    capsys.readouterr()


def test_runs_of_image_drop_repeats_and_of_edit_say_what_they_skip(spark, tmp_path, capsys):
    args = ["--model", "tests.toy:Sequences", "--top_d", "4", "--num_trajectories", "2", "--steps", "2", "--no_save_probs"]
    image = {"path": _words(1, 1), "caption": "c", "label": 1}
    path = _lines(tmp_path / "i.jsonl", [image, {**image, "path": _words(2, 0), "label": 0}, image])
    cli.main(["image", "--input_path", path, "--output_dir", str(tmp_path / "i"), *args])
    assert sorted(r.sample_id for r in records.read_results(spark, str(tmp_path / "i" / "results.jsonl")).collect()) == [0, 1]
    edit = {"input_path": _words(1, 1), "output_path": "o", "instruction": "do", "label": 1}
    nothing = {"input_path": "known", "output_path": "", "instruction": "", "label": 1}  # a sequence without a position to mask
    path = _lines(tmp_path / "e.jsonl", [edit, nothing, {**edit, "input_path": _words(2, 0), "label": 0}])
    for more in ([], ["--seed", "7"]):
        cli.main(["edit", "--input_path", path, "--output_dir", str(tmp_path / "e"), *args, *more])
        assert "AUC=1.000000" in capsys.readouterr().out.splitlines()[-1]
    got = {r.sample_id: r.status for r in records.read_results(spark, str(tmp_path / "e" / "results.jsonl")).collect()}
    assert got == {0: "ok", 1: "skipped_insufficient_trajectories", 2: "ok"}


def test_runs_of_videos_are_fused(spark, tmp_path, capsys):
    rows = [{"video_path": f"{'known' if i % 2 else 'other'}{i}.mp4", "label": i % 2} for i in range(4)] + [{"video_path": "short.mp4", "label": 1}]
    path = _lines(tmp_path / "v.jsonl", rows)
    args = ["video", "--input_path", path, "--output_dir", str(tmp_path / "v"), "--model", "tests.toy:Videos", "--num_repeats", "3"]
    cli.main(args)
    assert "ok: 4, video_too_short: 1" in capsys.readouterr().out
    cli.main(["video-fuse", str(tmp_path / "v" / "samples"), "--output", str(tmp_path / "out")])
    assert "AUC=1.000000" in capsys.readouterr().out
    cli.main(args)  # only the sample without a result is tried again
    assert "ok: 4, video_too_short: 2" in capsys.readouterr().out

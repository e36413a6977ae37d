"""Commands: run a pathway, fuse result files, fuse folders of video matrices, score trajectory artifacts.

    python -m concord.cli text --input_path in.jsonl --output_dir text --model package.module:factory
    python -m concord.cli video --input_path in.jsonl --output_dir video --model package.module:factory
    python -m concord.cli fuse --pathway-results a/results.jsonl b/results.jsonl --output fused
    python -m concord.cli video-fuse a/samples b/samples --output fused
    python -m concord.cli score artifacts --labels labels.jsonl --output results

A factory takes no arguments and gives the model; it has to be importable on executors.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import runs
from concord.operators import checks, consistency, fusion, video
from concord.sources import arrays, records, sinks


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="concord")
    commands = top.add_subparsers(dest="command", required=True)
    fuse = commands.add_parser("fuse", help="fuse pathways' result records and report the ROC-AUC")
    fuse.add_argument("--pathway-results", nargs="+", required=True)
    fuse.add_argument("--output", required=True)
    fuse.add_argument("--label-key", default="label")
    movie = commands.add_parser("video-fuse", help="score and fuse folders of video similarity matrices")
    movie.add_argument("pathway_dirs", nargs="+")
    movie.add_argument("--output", "--output_file", dest="output", required=True)
    movie.add_argument("--pair-type", choices=video.PAIR_TYPES, default="gen_gen")
    movie.add_argument("--aggregation-topk", type=int, default=32)
    for pathway, keys in {"text": ["text"], "image": ["image", "text"], "edit": ["input", "output", "instruction"]}.items():
        run = commands.add_parser(pathway, help=f"score the records of a {pathway} file with a model")
        run.add_argument("--input_path", required=True, help=".json or .jsonl file, or a folder of the latter")
        run.add_argument("--output_dir", required=True)
        run.add_argument("--model", "--pretrained_model_path", dest="model", required=True, help="module:factory")
        for key, column in zip(keys, runs.CONTENT[pathway], strict=True):
            run.add_argument(f"--{key}_key", dest=f"key_{column}", default=column)
        run.add_argument("--label_key", default="label")
        run.add_argument("--limit", type=int)
        run.add_argument("--batch_size", type=int, default=1)
        run.add_argument("--max_seq_len", type=int, default=runs.DEFAULTS[pathway][1])
        run.add_argument("--top_d", "--topk", dest="top_d", type=int, default=32)
        run.add_argument("--topk_domain", choices=["text", "image", "all"], default=runs.DEFAULTS[pathway][0])
        run.add_argument("--mask_ratio", type=float, default=0.5)
        run.add_argument("--num_trajectories", type=int, default=4)
        run.add_argument("--steps", default="18", help="a number, or a share of the masked positions such as 0.5")
        run.add_argument("--aggregation_topk", type=int, default=32)
        run.add_argument("--eps", type=float, default=1e-8)
        run.add_argument("--seed", type=int, default=1234)
        run.add_argument("--save_probs", action=argparse.BooleanOptionalAction, default=True)
        run.add_argument("--save_denoise", action=argparse.BooleanOptionalAction, default=pathway == "text")
        run.add_argument("--save_dtype", choices=["float16", "float32"], default="float16")
        run.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
        run.add_argument("--no_resume", dest="resume", action="store_false")
        run.add_argument("--no_save_probs", dest="save_probs", action="store_false")
        run.add_argument("--no_save_denoise", dest="save_denoise", action="store_false")
    clips = commands.add_parser("video", help="make the similarity matrices of repeated generations from the records of a video file")
    clips.add_argument("--input_path", "--input_jsonl", dest="input_path", required=True)
    clips.add_argument("--output_dir", "--output_root", dest="output_dir", required=True)
    clips.add_argument("--model", required=True, help="module:factory")
    clips.add_argument("--max_samples", type=int)
    clips.add_argument("--num_repeats", type=int, default=4)
    clips.add_argument("--base_seed", type=int, default=1818)
    clips.add_argument("--seed_stride", type=int, default=100_000)
    clips.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    score = commands.add_parser("score", help="score the trajectory artifacts (*.npz) of a folder")
    score.add_argument("artifacts")
    score.add_argument("--labels", required=True, help="records with text and label; an artifact's file name ends in its sample_id")
    score.add_argument("--output", required=True)
    score.add_argument("--text_key", default="text")
    score.add_argument("--label_key", default="label")
    score.add_argument("--aggregation_topk", type=int, default=32)
    score.add_argument("--eps", type=float, default=1e-8)
    score.add_argument("--resume", action="store_true")
    return top


def fuse(spark: SparkSession, paths: list[str], output: str, label_key: str) -> float:
    """Writes the fused document; gives the ROC-AUC."""
    names = fusion.pathway_names(paths)
    results = [(n, records.read_results(spark, p, label_key)) for n, p in zip(names, paths, strict=True)]
    for n, df in results:
        checks.ensure_none(checks.broken_records(df, label_key), n)
        if df.isEmpty():
            raise ValueError(f"{n}: no records")
    return _write(fusion.fuse_pathways(results, label_key), [f"{n}.{v}" for n in names for v in consistency.VIEWS], output, label_key)


def video_fuse(spark: SparkSession, folders: list[str], output: str, pair_type: str, k: int) -> float:
    if k < 1:
        raise ValueError("--aggregation-topk must be at least 1")
    names = [f.rstrip("/").rpartition("/")[2] for f in folders]
    pathways = [(n, video.melt(arrays.read_sample_folders(spark, f))) for n, f in zip(names, folders, strict=True)]
    fused = video.fuse_video(pathways, k, pair_type)
    return _write(fused, [f"{n}.{pair_type}.{v}" for n in names for v in consistency.VIEWS], output, "label")


def _write(fused: DataFrame, names: list[str], output: str, label_key: str) -> float:
    auc = fusion.fused_auc(fused, label_key)
    sinks.write_fused(fused, auc, names, "sum of views over pathways", output)
    return auc.first().auc


def score(spark: SparkSession, artifacts: str, labels: str, output: str, text_key: str, label_key: str, k: int, eps: float, resume: bool) -> int:
    """Writes result records of the artifacts' samples; of a resumed run only those that are not there yet."""
    checks.check_run_settings(aggregation_topk=k, eps=eps)
    sample = F.regexp_extract("path", r"(\d+)\.npz$", 1).try_cast("long")
    cells = arrays.read_artifacts(spark, artifacts).where("selected").select(sample.alias("sample_id"), "traj", "step", "pos", "v").where("sample_id IS NOT NULL")
    if resume:
        cells = cells.join(records.read_results(spark, output, label_key).select("sample_id").distinct(), "sample_id", "left_anti")
    known = records.read_text_records(spark, labels, text_key, label_key).select("sample_id", F.col("label").alias(label_key))
    results = consistency.result_records(consistency.evidence(cells, k, eps, means=True), None, known, label_key)
    sinks.write_results(results, output, resume)
    return records.read_results(spark, output, label_key).count()


def factory(name: str) -> Callable[[], object]:
    """The factory that ``module:name`` says."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"a model is given as module:factory, not {name!r}")
    return getattr(importlib.import_module(module), attribute)


def run(spark: SparkSession, args: argparse.Namespace) -> float:
    """A run of text, image or edit by its options; gives the ROC-AUC."""
    keys = [getattr(args, f"key_{c}") for c in runs.CONTENT[args.command]]
    inputs = runs.read_inputs(spark, args.command, args.input_path, keys, args.label_key, args.limit)
    options = {k: getattr(args, k) for k in ("label_key", "top_d", "max_seq_len", "mask_ratio", "num_trajectories", "steps", "aggregation_topk", "eps", "seed", "batch_size", "save_probs", "save_denoise", "save_dtype")}
    return runs.run_sequences(spark, inputs, args.command, factory(args.model), args.output_dir.rstrip("/"), domain=args.topk_domain, go_on=args.resume, **options)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("concord").getOrCreate()
    if args.command in runs.CONTENT:
        print(f"AUC={run(spark, args):.6f}")
    elif args.command == "video":
        checks.check_run_settings(max_samples=args.max_samples, num_repeats=args.num_repeats, seed_stride=args.seed_stride)
        inputs = records.read_video_records(spark, args.input_path, args.max_samples)
        counts = runs.run_videos(spark, inputs, factory(args.model), args.output_dir.rstrip("/"), num_repeats=args.num_repeats, base_seed=args.base_seed, seed_stride=args.seed_stride, go_on=args.resume)
        print(", ".join(f"{k}: {v}" for k, v in sorted(counts.items())))
    elif args.command == "fuse":
        print(f"AUC={fuse(spark, args.pathway_results, args.output, args.label_key):.6f}")
    elif args.command == "video-fuse":
        print(f"AUC={video_fuse(spark, args.pathway_dirs, args.output, args.pair_type, args.aggregation_topk):.6f}")
    else:
        n = score(spark, args.artifacts, args.labels, args.output, args.text_key, args.label_key, args.aggregation_topk, args.eps, args.resume)
        print(f"{n} results in {args.output}")


if __name__ == "__main__":
    main()

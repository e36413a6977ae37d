"""Running a model over tables: the model is a Python object behind an interface, Spark deals the work."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.steps import steps_for


class Denoiser(Protocol):
    """Fills masked positions of a sequence step by step.

    A model that also has ``logits_batch(token_ids, attended)`` gets sequences of the same
    number of steps together, padded at the right: both arguments are [sequences,
    length], and so are the first axes of what it returns.
    """

    def logits(self, token_ids: np.ndarray) -> np.ndarray:
        """[positions, vocabulary] of one sequence."""


class SequenceModel(Denoiser, Protocol):
    """A model of whole sequences, for a run from records."""

    mask_id: int
    vocab_size: int
    #: Token ids below it are text, those from it on are images.
    text_end: int
    #: Tokens that are never masked, scored or proposed.
    special_ids: Sequence[int]

    def encode(self, record: dict) -> tuple[Sequence[int], tuple[int, int]]:
        """The tokens of a record's sequence, and the positions [start, end) that may be masked and are scored."""

    def decode(self, token_ids: Sequence[int]) -> str:
        """The text of tokens, for histories."""


def pad_right(token_ids: Column, length: Column | int, pad: int) -> Column:
    """An array of ``length`` tokens at least: those given, then ``pad``."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(token_ids)) if isinstance(length, int) else F.greatest(F.lit(0), length - F.size(token_ids))
    return F.concat(token_ids, F.array_repeat(F.lit(pad), missing.cast("int")))


def attention(token_ids: Column, length: Column | int) -> Column:
    """1 for each token and 0 for each place after them, up to ``length``."""
    return pad_right(F.transform(token_ids, lambda t: F.lit(1)), length, 0)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1)
    return top + np.log(np.exp(x - top[..., None]).sum(axis=-1))


def _all_logits(model: Denoiser, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """Logits of each sequence, together where the model can."""
    if len(sequences) == 1 or not hasattr(model, "logits_batch"):
        return [np.asarray(model.logits(s), np.float64) for s in sequences]
    length = max(map(len, sequences))
    tokens, attended = (np.zeros((len(sequences), length), np.int64) for _ in range(2))
    for i, s in enumerate(sequences):
        tokens[i, : len(s)], attended[i, : len(s)] = s, 1
    x = np.asarray(model.logits_batch(tokens, attended), np.float64)
    return [x[i, : len(s)] for i, s in enumerate(sequences)]


#: Numbers that a task hands on at once, 8 MB of them.
HELD = 1 << 20


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over as many tasks as there are partitions of a shuffle or cores: rows of few bytes that are long work would else be put together in one."""
    spark = rows.sparkSession
    # by a hash, as Spark drops a repartition by keys that an aggregate has left the rows dealt by
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(*keys))


class _Run:
    """One trajectory of a sequence while it is filled."""

    def __init__(self, tokens: np.ndarray, masked: np.ndarray, candidates: np.ndarray, steps: int, mask_id: int, rng: np.random.Generator, temperature: float):
        self.tokens, self.candidates, self.mask_id, self.rng, self.temperature = tokens.copy(), candidates, mask_id, rng, temperature
        self.tokens[masked] = mask_id
        self.quota = [len(masked) // steps + (s < len(masked) % steps) for s in range(steps)]
        self.probabilities, self.history, self.step = np.zeros((steps, *candidates.shape)), [], 0

    def take(self, x: np.ndarray) -> bool:
        """Records a step's probabilities and fills its share of positions; whether there is another step."""
        lse = _log_sum(x)
        self.probabilities[self.step] = np.exp(np.take_along_axis(x, self.candidates, 1) - lse[:, None])
        masked = np.flatnonzero(self.tokens == self.mask_id)
        if not len(masked):
            return False
        noise = -np.log(-np.log(self.rng.uniform(1e-12, 1 - 1e-12, x.shape))) * self.temperature
        drawn = (x + noise).argmax(axis=1)
        confidence = x[masked, drawn[masked]] - lse[masked]
        chosen = masked[np.argsort(-confidence, kind="stable")[: self.quota[self.step]]]
        self.tokens[chosen] = drawn[chosen]
        self.history.append(self.tokens.copy())
        self.step += 1
        return self.step < len(self.quota)


def _finish(model: Denoiser, runs: list[_Run]) -> None:
    going = runs
    while going:
        logits = _all_logits(model, [r.tokens for r in going])
        going = [r for r, x in zip(going, logits, strict=True) if r.take(x)]


def denoise_one(model: Denoiser, tokens: np.ndarray, masked: np.ndarray, candidates: np.ndarray, steps: int, mask_id: int, rng: np.random.Generator, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """(candidates' probabilities [steps, positions, d], tokens after each step [steps done, positions]).

    At each step the probabilities are recorded, noisy best tokens are drawn for all
    masked positions, and the most confident of them stay. Once nothing is masked it
    stops, and the remaining steps' probabilities are 0.
    """
    run = _Run(tokens, masked, candidates, steps, mask_id, rng, temperature)
    _finish(model, [run])
    return run.probabilities, np.array(run.history).reshape(len(run.history), len(tokens))


def denoise(
    samples: DataFrame, masks: DataFrame, candidates: DataFrame, model_factory: Callable[[], Denoiser], steps: str | int | float, mask_id: int, seed: int = 1234, temperature: float = 1.0, batch_size: int = 1, history: bool = False
) -> DataFrame:
    """Cells (sample_id, traj, step, pos, v) of samples (sample_id, token_ids) under masks (sample_id, traj, pos).

    ``candidates`` is (sample_id, candidate_ids array<array<int>>), by position. A row is
    a sample's trajectory, so the model's calls are dealt over all tasks; the random
    numbers of one are those of (seed, sample, trajectory) wherever it runs. Up to
    ``batch_size`` rows of one number of steps go to the model together. With
    ``history`` there is also a column token_ids, and for each step that was taken a row
    of pos -1 with the tokens after it. ``model_factory`` makes the model once a task.
    """
    chosen = masks.groupBy("sample_id", "traj").agg(F.array_sort(F.collect_list("pos")).alias("masked"))
    rows = chosen.join(samples.select("sample_id", "token_ids"), "sample_id").join(candidates.select("sample_id", "candidate_ids"), "sample_id").withColumn("steps", steps_for(F.size("masked"), steps))

    def cells(runs: list[tuple[tuple, _Run]]) -> pd.DataFrame:
        parts = []
        for key, run in runs:
            s, n, d = run.probabilities.shape
            i, j = (x.ravel() for x in np.indices((s, n)))
            parts.append((np.full(s * n, key[0]), np.full(s * n, key[1]), i, j, list(run.probabilities.reshape(s * n, d)), None))
            if history:
                s = len(run.history)
                parts.append((np.full(s, key[0]), np.full(s, key[1]), np.arange(s), np.full(s, -1), [None] * s, run.history))
        out = {name: np.concatenate([p[c] for p in parts]) for c, name in enumerate(("sample_id", "traj", "step", "pos"))}
        out["v"] = pd.Series([v for p in parts for v in p[4]], dtype=object)
        if history:
            out["token_ids"] = pd.Series([t for p in parts for t in (p[5] if p[5] is not None else [None] * len(p[4]))], dtype=object)
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        waiting: dict[int, list[tuple[tuple, _Run]]] = {}
        held: list[tuple[tuple, _Run]] = []

        def finish(steps: int) -> bool:
            group = waiting.pop(steps)
            _finish(model, [r for _, r in group])
            held.extend(group)
            return sum(r.probabilities.size + len(r.history) * len(r.tokens) for _, r in held) >= HELD or len(held) >= 1000

        for b in batches:
            for r in b.itertuples(index=False):
                rng = np.random.default_rng([seed, int(r.sample_id), int(r.traj)])
                ids = np.stack([np.asarray(c) for c in r.candidate_ids])
                one = _Run(np.asarray(r.token_ids), np.asarray(r.masked), ids, int(r.steps), mask_id, rng, temperature)
                waiting.setdefault(int(r.steps), []).append(((r.sample_id, r.traj), one))
                if len(waiting[int(r.steps)]) >= batch_size and finish(int(r.steps)):
                    yield cells(held)
                    held.clear()
        for steps in list(waiting):
            finish(steps)
        if held:
            yield cells(held)

    schema = "sample_id long, traj int, step int, pos int, v array<double>"
    return dealt(rows, "sample_id", "traj").mapInPandas(run, schema + (", token_ids array<int>" if history else ""))


def clean_forward(records: DataFrame, model_factory: Callable[[], SequenceModel], d: int, domain: str = "text", most: int = 1024) -> DataFrame:
    """(sample_id, token_ids, candidate_ids, selected, maskable, logp): each record's sequence, once through the model.

    ``records`` has sample_id and what the model's encode() reads. Sequences are cut off
    at ``most`` tokens. Per position: the ``d`` tokens of the domain with the highest
    logits, whether it is scored (its token is of the domain and in the record's
    region), whether it may be masked (it is in the region and no special token), and
    the log-probability of its token. A domain of fewer than ``d`` tokens is an error.
    """
    if domain not in ("text", "image", "all"):
        raise ValueError(f"unknown domain: {domain!r}")
    names = [c for c in records.columns if c != "sample_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        every = np.arange(model.vocab_size)
        plain = ~np.isin(every, list(model.special_ids)) & (every != model.mask_id)
        allowed = plain & {"text": every < model.text_end, "image": every >= model.text_end, "all": every >= 0}[domain]
        if allowed.sum() < d:
            raise ValueError(f"the domain {domain} has fewer than {d} tokens")
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                tokens, (start, end) = model.encode({c: row[c] for c in names})
                tokens = np.asarray(tokens)[:most]
                if not len(tokens):
                    continue
                x = np.asarray(model.logits(tokens), np.float64)
                ranked = np.argsort(np.where(allowed, -x, np.inf), axis=1, kind="stable")[:, :d]
                at = np.arange(len(tokens))
                inside = (at >= start) & (at < end)
                out.append((row["sample_id"], tokens, list(ranked), allowed[tokens] & inside, plain[tokens] & inside, x[at, tokens] - _log_sum(x)))
            yield pd.DataFrame(out, columns=["sample_id", "token_ids", "candidate_ids", "selected", "maskable", "logp"])

    return records.mapInPandas(run, "sample_id long, token_ids array<int>, candidate_ids array<array<int>>, selected array<boolean>, maskable array<boolean>, logp array<double>")


def generation_features(records: DataFrame, model_factory: Callable[[], object], repeats: int, base_seed: int, seed_stride: int) -> DataFrame:
    """(sample_id, generation, frame, z, status): features of each frame of ``repeats`` generations from a record.

    The model's ``features(record, seed)`` gives [frames, dimensions] of one generation, or
    a text that says why there is none; that row has the text as its status and no frame.
    Its seed is base_seed + sample_id * seed_stride + generation.
    """
    calls = records.withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    names = [c for c in records.columns if c != "sample_id"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        ids, generations, frames, z, status = zip(*rows, strict=True)
        return pd.DataFrame({"sample_id": ids, "generation": generations, "frame": pd.array(frames, "Int32"), "z": pd.Series(z, dtype=object), "status": status})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        rows, held = [], 0
        for b in batches:
            for r in b.to_dict("records"):
                found = model.features({c: r[c] for c in names}, base_seed + r["sample_id"] * seed_stride + r["generation"])
                if isinstance(found, str):
                    rows.append((r["sample_id"], r["generation"], None, None, found))
                else:
                    z = [np.asarray(f, np.float64) for f in found]
                    rows += [(r["sample_id"], r["generation"], k, f, "ok") for k, f in enumerate(z)]
                    held += sum(f.size for f in z)
                if held >= HELD or len(rows) >= 10_000:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)

    return dealt(calls, "sample_id", "generation").mapInPandas(run, "sample_id long, generation int, frame int, z array<double>, status string")

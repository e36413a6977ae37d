"""Vocabularies, candidate tokens, probabilities, masks and schedules as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.steps import mask_size

#: (low, high) of a domain's token ids: text [0, end), image [end, vocabulary), all.
DOMAINS = ("text", "image", "all")


def forbidden_tokens(*sources: DataFrame) -> DataFrame:
    """(token_id): the union of the special tokens of all sources, without nulls."""
    out = sources[0].select("token_id")
    for s in sources[1:]:
        out = out.union(s.select("token_id"))
    return out.where("token_id IS NOT NULL").distinct()


def allowed_tokens(vocab: DataFrame, forbidden: DataFrame, domain: str, text_end: int, codebook: int | None = None) -> DataFrame:
    """(token_id) of a domain without the forbidden ones; with ``codebook``, image tokens are [text_end, text_end + codebook)."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain: {domain!r}")
    t = F.col("token_id")
    inside = {"text": t < text_end, "image": t >= text_end, "all": F.lit(True)}[domain]
    if domain == "image" and codebook is not None:
        inside = inside & (t < text_end + codebook)
    return vocab.select("token_id").where((t >= 0) & inside).join(forbidden, "token_id", "left_anti")


def require_tokens(allowed: DataFrame, what: str = "allowed tokens") -> DataFrame:
    """``allowed`` if it has a row; checked at once."""
    if allowed.isEmpty():
        raise ValueError(f"there are no {what}")
    return allowed


def maskable_tokens(vocab: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(token_id): all but the forbidden ones."""
    return vocab.select("token_id").join(forbidden, "token_id", "left_anti")


def semantic_positions(tokens: DataFrame, allowed: DataFrame, region: Column | None = None) -> DataFrame:
    """Rows of (sample_id, pos, token_id, attended) that are attended, of an allowed token, and in the region if given."""
    rows = tokens.where("attended")
    if region is not None:
        rows = rows.where(region)
    return rows.join(allowed, "token_id", "left_semi").select("sample_id", "pos", "token_id")


def top_tokens(logits: DataFrame, d: int, allowed: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(sample_id, pos, rank, token_id, logit): the d highest logits of each position, of equal ones the lower token first.

    With ``allowed`` only its tokens compete; ``strict`` makes fewer than d of them an error.
    """
    if d < 1:
        raise ValueError("d must be positive")
    if allowed is not None:
        logits = logits.join(allowed, "token_id", "left_semi")
    w = Window.partitionBy("sample_id", "pos").orderBy(F.col("logit").desc(), F.col("token_id"))
    top = logits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= d).select("sample_id", "pos", "rank", "token_id", "logit")
    if not strict:
        return top
    # counted among what is left of each position, where it already is
    have = F.count("*").over(Window.partitionBy("sample_id", "pos"))
    short = F.raise_error(F.lit("fewer allowed tokens than d")).cast("int")
    return top.withColumn("rank", F.when(have < d, short).otherwise(F.col("rank")))


#: Logits are summed up as exponentials relative to multiples of this.
_SPAN = 64


def _log_sums(logits: DataFrame) -> DataFrame:
    """(sample_id, pos, lse): the log of the sum of exponentials of each position.

    Exponentials are summed by spans of logits, relative to the span, so sums are
    partial, need no maximum first and can't overflow; a position's few spans are put
    together at the end, and no list of a vocabulary is made.
    """
    span = F.floor(F.col("logit") / _SPAN).cast("double")
    spans = logits.groupBy("sample_id", "pos", span.alias("span")).agg(F.sum(F.exp(F.col("logit") - F.floor(F.col("logit") / _SPAN).cast("double") * _SPAN)).alias("sum"))
    parts = spans.groupBy("sample_id", "pos").agg(F.collect_list(F.struct("span", "sum")).alias("parts"), F.max("span").alias("top"))
    total = F.aggregate("parts", F.lit(0.0).cast("double"), lambda s, p: s + p["sum"] * F.exp((p["span"] - F.col("top")) * _SPAN))
    return parts.select("sample_id", "pos", (F.log(total) + F.col("top") * _SPAN).alias("lse"))


def candidate_probabilities(logits: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sample_id, pos, token_id, p): softmax probabilities, over the whole vocabulary, of the candidates only."""
    chosen = logits.join(candidates.select("sample_id", "pos", "token_id"), ["sample_id", "pos", "token_id"], "left_semi")
    return chosen.join(_log_sums(logits), ["sample_id", "pos"]).select("sample_id", "pos", "token_id", F.exp(F.col("logit") - F.col("lse")).alias("p"))


def token_log_probabilities(logits: DataFrame) -> DataFrame:
    """(sample_id, pos, token_id, logp) of every token."""
    return logits.join(_log_sums(logits), ["sample_id", "pos"]).select("sample_id", "pos", "token_id", (F.col("logit") - F.col("lse")).alias("logp"))


def _order(*parts: Column | str, seed: int) -> Column:
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts), F.lit(str(seed)))
    return F.md5(text.cast("binary"))


def choose_masks(positions: DataFrame, trajectories: int, ratio: float, seed: int = 1234, region: Column | None = None) -> DataFrame:
    """(sample_id, traj, pos): positions to mask, without replacement, for each trajectory; with ``region``, of its positions only.

    The order is that of a hash of (sample, trajectory, position, seed), so a choice is
    the same wherever and however often it is made.
    """
    if region is not None:
        positions = positions.where(region)
    counts = positions.groupBy("sample_id").agg(F.count("*").alias("n")).select("sample_id", mask_size(F.col("n"), ratio).alias("k"))
    rows = positions.select("sample_id", "pos").withColumn("traj", F.explode(F.sequence(F.lit(0), F.lit(trajectories - 1))))
    w = Window.partitionBy("sample_id", "traj").orderBy(_order("sample_id", "traj", "pos", seed=seed), "pos")
    return rows.withColumn("n", F.row_number().over(w)).join(counts, "sample_id").where("n <= k").select("sample_id", "traj", "pos")


def transfer_schedule(masked: DataFrame, steps: int) -> DataFrame:
    """(sample_id, traj, step, count): how many of each trajectory's ``masked`` positions are unmasked at each step, as evenly as can be, the first steps one more."""
    rows = masked.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    base, rest = F.floor(F.col("masked") / steps), F.col("masked") % steps
    return rows.select("sample_id", "traj", "step", (base + (F.col("step") < rest).cast("long")).cast("int").alias("count"))


def transfer_positions(confidence: DataFrame, counts: DataFrame) -> DataFrame:
    """(sample_id, traj, step, pos): the most confident masked positions of each step, as many as ``counts`` says."""
    keys = ["sample_id", "traj", "step"]
    w = Window.partitionBy(*keys).orderBy(F.col("logp").desc(), F.col("pos"))
    return confidence.withColumn("n", F.row_number().over(w)).join(counts, keys).where(F.col("n") <= F.col("count")).select(*keys, "pos")


def position_runs(positions: DataFrame) -> DataFrame:
    """(sample_id, start, end): maximal runs [start, end) of consecutive positions."""
    w = Window.partitionBy("sample_id").orderBy("pos")
    islands = positions.select("sample_id", "pos").distinct().withColumn("island", F.col("pos") - F.row_number().over(w))
    return islands.groupBy("sample_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("island")


def span_bounds(positions: DataFrame, by: str = "sample_id") -> DataFrame:
    """(by, start, end): from the first position to one past the last."""
    return positions.groupBy(by).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def changed_span(before: Column, after: Column) -> Column:
    """(start, end) of ``after`` without the longest common prefix and suffix of two arrays; (-1, -1) where they are equal."""
    n, m = F.size(before), F.size(after)
    short = F.least(n, m)
    differ = F.zip_with(F.slice(before, F.lit(1), short), F.slice(after, F.lit(1), short), lambda a, b: ~a.eqNullSafe(b))
    first = F.array_position(differ, True).cast("int")
    start = F.when(first == 0, short).otherwise(first - 1)
    rest = short - start
    tail = lambda x: F.reverse(F.slice(x, F.size(x) - rest + 1, rest))
    back = F.when(rest > 0, F.zip_with(tail(before), tail(after), lambda a, b: ~a.eqNullSafe(b)))
    last = F.array_position(back, True).cast("int")
    common = F.when(rest <= 0, F.lit(0)).when(last == 0, rest).otherwise(last - 1)
    same = (n == m) & (start == n)
    return F.struct(F.when(same, -1).otherwise(start).alias("start"), F.when(same, -1).otherwise(m - common).alias("end"))


def insert_at_marker(plain: Column, marked: Column, inserted: Column, limit: int | None = None) -> Column:
    """The tokens of a prompt with ``inserted`` in the place of its marker, cut off at ``limit``.

    ``marked`` is the prompt with the marker and ``plain`` the same without it, so the
    marker is where they differ, however it was taken apart into tokens. A prompt without
    a marker, or one that only takes tokens away, is an error.
    """
    span = changed_span(plain, marked)
    wrong = F.raise_error(F.lit("the prompt has no marker")).cast("array<int>")
    start, end = span["start"], span["end"]
    tail = F.slice(marked, end + 1, F.greatest(F.size(marked) - end, F.lit(0)))
    whole = F.concat(F.slice(marked, F.lit(1), F.greatest(start, F.lit(0))), inserted, tail)
    whole = F.when((start < 0) | (start >= end), wrong).otherwise(whole)
    return whole if limit is None else F.slice(whole, 1, limit)


def masked_counts(history: DataFrame, mask_id: int) -> DataFrame:
    """``history`` (token_ids array) with masked: how many of its tokens are still the mask."""
    return history.withColumn("masked", F.size(F.filter("token_ids", lambda t: t == mask_id)))


def step_buckets(samples: DataFrame, steps: str = "steps") -> DataFrame:
    """(steps, samples): how many samples have so many steps; these can run together."""
    return samples.groupBy(steps).agg(F.count("*").alias("samples"))

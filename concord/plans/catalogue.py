"""One query for each operator that the driver's tables can show, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import steps as st
from concord.functions.labels import label_to_int
from concord.operators import blackbox, checks, consistency, fusion, masking, metrics, resume, video
from concord.plans.tables import LABELS_SQL, LOGITS_SQL, TOKENS_SQL, black_box, cells, cells_sql, logits, pairs_sql, rounded, sample_labels, table, tokens, views_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c: str, name: str | None = None) -> str:
    return f"round({c}, 9) + 0.0 AS {name or c}"


def _evidence_columns(df: DataFrame) -> DataFrame:
    views = [rounded(c).alias(c) for c in ("expected", "pessimistic", "optimistic", "membership_score")]
    return df.select("sample_id", *views, "num_trajectories", "num_pairs", "num_steps", "num_positions", "aggregation_topk")


def _evidence_sql(pairs: str, k: int, flat: bool = False, trajectories: str = "4") -> str:
    score = _r("expected + pessimistic + optimistic", "membership_score")
    counts = "1 AS num_steps, num_cells::INT AS num_positions" if flat else "num_steps::INT AS num_steps, num_positions::INT AS num_positions"
    return f"SELECT sample_id, {_r('expected')}, {_r('pessimistic')}, {_r('optimistic')}, {score}, {trajectories} AS num_trajectories, num_pairs::INT AS num_pairs, {counts}, {k} AS aggregation_topk FROM ({views_sql(pairs, k)})"


# --- consistency ---------------------------------------------------------------------------


@_query(f"SELECT sample_id, step, pos, i, j, {_r('sim')} FROM ({pairs_sql(cells_sql())})")
def pair_consistency(spark, sf):
    return consistency.pair_consistency(cells(spark, sf)).select("sample_id", "step", "pos", "i", "j", rounded("sim").alias("sim"))


@_query(_evidence_sql(pairs_sql(cells_sql()), 2))
def evidence_k2(spark, sf):
    return _evidence_columns(consistency.evidence(cells(spark, sf), 2))


@_query(_evidence_sql(pairs_sql(cells_sql()), 32))
def evidence_k32_clipped(spark, sf):
    return _evidence_columns(consistency.evidence(cells(spark, sf), 32))


@_query(_evidence_sql(pairs_sql(cells_sql(), 1.0), 3))
def evidence_eps(spark, sf):
    return _evidence_columns(consistency.evidence(cells(spark, sf), 3, eps=1.0))


@_query(_evidence_sql(f"SELECT * FROM ({pairs_sql(cells_sql())}) WHERE (sample_id + pos) % 2 = 0", 2))
def evidence_masked_1d(spark, sf):
    c = cells(spark, sf)
    mask = c.select("sample_id", "pos").distinct().where("(sample_id + pos) % 2 = 0")
    return _evidence_columns(consistency.evidence(c, 2, mask=mask))


@_query(_evidence_sql(f"SELECT * FROM ({pairs_sql(cells_sql())}) WHERE (sample_id + step + pos) % 3 = 0", 2, flat=True))
def evidence_masked_2d(spark, sf):
    c = cells(spark, sf)
    mask = c.select("sample_id", "step", "pos").distinct().where("(sample_id + step + pos) % 3 = 0")
    return _evidence_columns(consistency.evidence(c, 2, mask=mask))


_FILLED = f"SELECT sample_id, traj, step, pos, CASE WHEN step > traj THEN [0, 0, 0, 0]::DOUBLE[] ELSE v END AS v FROM ({cells_sql()})"


@_query(_evidence_sql(pairs_sql(_FILLED), 2))
def evidence_early_stop(spark, sf):
    reached = cells(spark, sf).where("step <= traj")
    return _evidence_columns(consistency.evidence(consistency.fill_steps(reached, 4), 2))


@_query(f"SELECT sample_id, list(m ORDER BY i, j) AS pair_mean_similarities FROM (SELECT sample_id, i, j, round(avg(sim), 9) + 0.0 AS m FROM ({pairs_sql(cells_sql())}) GROUP BY ALL) GROUP BY 1")
def pair_means(spark, sf):
    return consistency.pair_means(cells(spark, sf)).select("sample_id", F.transform("pair_mean_similarities", lambda x: F.round(x, 9) + F.lit(0.0)).alias("pair_mean_similarities"))


@_query(f"SELECT sample_id, count(DISTINCT traj) AS num_trajectories, CASE WHEN count(DISTINCT traj) >= 2 THEN 'ok' ELSE 'skipped_insufficient_trajectories' END AS status FROM ({cells_sql()}) WHERE traj < 1 OR sample_id % 3 > 0 GROUP BY 1")
def trajectory_status(spark, sf):
    return consistency.enough_trajectories(cells(spark, sf).where("traj < 1 OR sample_id % 3 > 0"), status=True)


# --- black box -------------------------------------------------------------------------------


def _unit_pairs(steps: int) -> str:
    return pairs_sql(cells_sql(steps, 1))


def _box_views(steps: int, k: int) -> str:
    return f"""
WITH p AS MATERIALIZED ({_unit_pairs(steps)}),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, step ORDER BY sim) AS up, row_number() OVER (PARTITION BY sample_id, step ORDER BY sim DESC) AS down FROM p),
s AS (SELECT sample_id, step, avg(sim) AS exp, avg(sim) FILTER (up <= {k}) AS pess, avg(sim) FILTER (down <= {k}) AS opt FROM r GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pess) AS up, row_number() OVER (PARTITION BY sample_id ORDER BY opt DESC) AS down FROM s)
SELECT sample_id, avg(exp) AS exp, avg(pess) FILTER (up <= {min(k, steps)}) AS pess, avg(opt) FILTER (down <= {min(k, steps)}) AS opt FROM q GROUP BY 1
"""


@_query(f"SELECT sample_id, 'a' AS pathway, {_r('exp')}, {_r('pess')}, {_r('opt')} FROM ({_box_views(1, 2)})")
def blackbox_final_step(spark, sf):
    df = blackbox.pathway_features(black_box(spark, sf, steps=1), "final_step", 2, strict=False)
    return df.select("sample_id", "pathway", *(rounded(c).alias(c) for c in ("exp", "pess", "opt")))


@_query(f"SELECT sample_id, 'a' AS pathway, {_r('exp')}, {_r('pess')}, {_r('opt')} FROM ({_box_views(4, 2)})")
def blackbox_multi_step(spark, sf):
    df = blackbox.pathway_features(black_box(spark, sf), "multiple_step", 2, strict=False)
    return df.select("sample_id", "pathway", *(rounded(c).alias(c) for c in ("exp", "pess", "opt")))


@_query(f"SELECT sample_id, round(sum(exp + pess + opt), 9) + 0.0 AS membership_score FROM (SELECT * FROM ({_box_views(4, 2)}) UNION ALL SELECT * FROM ({_box_views(2, 2)})) GROUP BY 1")
def blackbox_scores(spark, sf):
    a = blackbox.pathway_features(black_box(spark, sf, "a", 4), "multi_step", 2, strict=False)
    b = blackbox.pathway_features(black_box(spark, sf, "b", 2), "multi_step", 2, strict=False)
    return blackbox.membership_scores(a.unionByName(b), ["a", "b"]).select("sample_id", rounded("membership_score").alias("membership_score"))


# --- video -----------------------------------------------------------------------------------

_GENERATIONS = "SELECT sample_id, traj, step, 0 AS pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ({})".format(cells_sql(8, 1))


def _generation_pairs(spark, sf):
    z = cells(spark, sf, 8, 1)
    from concord.functions.vectors import unit

    return video.generation_pairs(z.select("sample_id", F.col("traj").alias("generation"), F.col("step").alias("frame"), unit(F.col("v")).alias("z")))


def _video_sql(k: int) -> str:
    pairs = f"SELECT sample_id, step, 0 AS pos, a.traj AS i, b.traj AS j, list_dot_product(a.v::FLOAT[]::DOUBLE[], b.v::FLOAT[]::DOUBLE[])::FLOAT::DOUBLE AS sim FROM ({_GENERATIONS}) a JOIN ({_GENERATIONS}) b USING (sample_id, step) WHERE a.traj < b.traj"
    return pairs, views_sql(pairs, k)


@_query(f"SELECT sample_id, {_r('expected').replace('9', '5')}, {_r('pessimistic').replace('9', '5')}, {_r('optimistic').replace('9', '5')}, num_pairs::INT AS num_pairs, num_steps::INT AS num_steps FROM ({_video_sql(3)[1]})")
def video_evidence(spark, sf):
    df = video.video_evidence(_generation_pairs(spark, sf), 3)
    return df.select("sample_id", *(rounded(c, 5).alias(c) for c in ("expected", "pessimistic", "optimistic")), "num_pairs", "num_steps")


# --- fusion and metrics ----------------------------------------------------------------------

_TWO = f"""
SELECT a.sample_id, l.label, a.expected AS ae, a.pessimistic AS ap, a.optimistic AS ao, b.expected AS be, b.pessimistic AS bp, b.optimistic AS bo
FROM ({views_sql(pairs_sql(cells_sql()), 2)}) a JOIN ({views_sql(pairs_sql(cells_sql(8, 2)), 2)}) b USING (sample_id) JOIN ({LABELS_SQL}) l USING (sample_id)
"""


def _results(spark, sf) -> list[tuple[str, DataFrame]]:
    labels = sample_labels(spark, sf)
    return [(name, consistency.result_records(consistency.evidence(cells(spark, sf, s, p), 2), None, labels)) for name, s, p in (("text", 4, 4), ("image", 8, 2))]


@_query(f"""SELECT sample_id, label::BIGINT AS label, {_r('ae + ap + ao + be + bp + bo', 'membership_score')}, {_r('ae', 'text_expected')}, {_r('bp', 'image_pessimistic')}, 6 AS features FROM ({_TWO})""")
def fuse_pathways(spark, sf):
    df = fusion.fuse_pathways(_results(spark, sf))
    return df.select(
        "sample_id", "label", rounded("membership_score").alias("membership_score"), rounded(F.col("features")["text.expected"]).alias("text_expected"),
        rounded(F.col("features")["image.pessimistic"]).alias("image_pessimistic"), F.size("features").alias("features"),
    )


@_query(f"""WITH s AS (SELECT label, ae + ap + ao + be + bp + bo AS score FROM ({_TWO}))
SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 9) AS auc FROM (SELECT score FROM s WHERE label = 1) p, (SELECT score FROM s WHERE label = 0) n""")
def fused_auc(spark, sf):
    return fusion.fused_auc(fusion.fuse_pathways(_results(spark, sf))).select(F.round("auc", 9).alias("auc"))


def _rows_with_holes(spark, sf):
    parts = [fusion.evidence_rows(r, n, i) for i, (n, r) in enumerate(_results(spark, sf))]
    return parts[0].where("sample_id % 7 <> 3").unionByName(parts[1].withColumn("label", F.when(F.col("sample_id") % 5 == 2, 1 - F.col("label")).otherwise(F.col("label"))))


@_query("SELECT DISTINCT vec_id // 4 AS sample_id, 1::BIGINT AS pathways FROM embeddings WHERE (vec_id // 4) % 7 = 3")
def fuse_id_mismatch(spark, sf):
    return fusion.id_mismatches(_rows_with_holes(spark, sf), 2)


@_query("SELECT DISTINCT vec_id // 4 AS sample_id, 0::BIGINT AS low, 1::BIGINT AS high FROM embeddings WHERE (vec_id // 4) % 5 = 2 AND (vec_id // 4) % 7 <> 3")
def fuse_label_conflict(spark, sf):
    return fusion.label_conflicts(_rows_with_holes(spark, sf))


_SCORED = "SELECT quality AS label, (n_chars % 50)::DOUBLE AS score, lang FROM labels JOIN documents USING (doc_id)"


def _scored(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") % 50).cast("double").alias("score"), "lang", "doc_id")


_AUC = "(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*))"


@_query(f"WITH s AS ({_SCORED}) SELECT round({_AUC}, 9) AS auc FROM (SELECT score FROM s WHERE label = 1) p, (SELECT score FROM s WHERE label = 0) n")
def roc_auc_ties(spark, sf):
    return metrics.roc_auc(_scored(spark, sf)).select(F.round("auc", 9).alias("auc"))


@_query(f"WITH s AS ({_SCORED}) SELECT lang, CASE WHEN count(p.score) = 0 OR count(n.score) = 0 THEN -1 ELSE round({_AUC}, 9) END AS auc FROM (SELECT DISTINCT lang FROM s) LEFT JOIN (SELECT lang, score FROM s WHERE label = 1) p USING (lang) LEFT JOIN (SELECT lang, score FROM s WHERE label = 0) n USING (lang) GROUP BY lang")
def roc_auc_by_group(spark, sf):
    """-1 for a group of one class."""
    return metrics.roc_auc(_scored(spark, sf), by=("lang",)).select("lang", F.when(F.isnan("auc"), -1.0).otherwise(F.round("auc", 9)).alias("auc"))


@_query("""WITH s AS (SELECT label, embedding[1]::DOUBLE AS score FROM embeddings),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s)
SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc FROM r""")
def roc_auc_other_labels(spark, sf):
    """Labels from 0 to 9: those but 0 and 1 are of no class and take ranks."""
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("score"))
    return metrics.roc_auc(rows).select(F.round("auc", 9).alias("auc"))


@_query("SELECT 'NaN'::DOUBLE AS auc")
def roc_auc_single_class(spark, sf):
    return metrics.roc_auc(_scored(spark, sf).where("label = 1"))


@_query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS mean_rank FROM lineitem")
def mean_ranks(spark, sf):
    return metrics.mean_ranks(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").select("l_orderkey", "l_linenumber", "mean_rank")


@_query("SELECT c_name, c_mktsegment || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS pathway FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def pathway_name_suffix(spark, sf):
    return fusion.suffix_repeats(table(spark, sf, "customer"), "c_mktsegment", "c_custkey").select("c_name", "pathway")


# --- resuming, merging, counting -------------------------------------------------------------


@_query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def keep_last_merge(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return resume.keep_last(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@_query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return resume.status_counts(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"))


@_query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_left_anti(spark, sf):
    return resume.remaining(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), ["doc_id"])


@_query("SELECT md5(text) AS key FROM documents UNION SELECT md5(text) FROM conversations")
def processed_distinct(spark, sf):
    docs, turns = (table(spark, sf, t).select(F.md5(F.encode("text", "UTF-8")).alias("key")) for t in ("documents", "conversations"))
    return resume.processed_keys(docs, turns, keys=["key"])


@_query("SELECT r::INT AS rank, coalesce(n, 0) AS n FROM range(16) t(r) LEFT JOIN (SELECT doc_id % 16 AS k, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1) ON k = r")
def rank_assignment_counts(spark, sf):
    docs = resume.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])
    return resume.counts_by_rank(docs, 16, "doc_id")


@_query("SELECT doc_id, source FROM documents WHERE doc_id % 5 = 2")
def shard_by_ordinal(spark, sf):
    return resume.shard(table(spark, sf, "documents").select("doc_id", "source"), 5, 2, "doc_id")


@_query("SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text")
def drop_repeats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("key"))
    return resume.drop_repeats(docs, ["key"], "doc_id")


@_query(None)
def record_hashes(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "text", "quality")
    return resume.record_hash(docs, ["text", "quality"]).select("doc_id", "record_hash")


@_query("SELECT doc_id, coalesce(quality, 0) AS label, CASE WHEN quality IS NULL THEN 0.0 ELSE (n_chars % 50)::DOUBLE END AS membership_score FROM documents LEFT JOIN labels USING (doc_id)")
def default_scores(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    df = docs.select("doc_id", F.col("quality").alias("label"), F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 50).cast("double")).alias("membership_score"))
    return resume.with_default_scores(df).select("doc_id", "label", "membership_score")


@_query("SELECT event_id, event_type AS status FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'other' FROM events WHERE event_type <> 'click'")
def merge_shards(spark, sf):
    e = table(spark, sf, "events")
    click = F.col("event_type") == "click"
    return resume.merge_shards(e.where(click).select("event_id", F.col("event_type").alias("status")), e.where(~click).select("event_id", F.lit("other").alias("status")))


# --- masks, tokens, schedules ----------------------------------------------------------------


@_query(f"SELECT sample_id, pos, rank, token_id, {_r('logit')} FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pos ORDER BY logit DESC, token_id)::INT AS rank FROM ({LOGITS_SQL}) WHERE token_id NOT IN (0, 3, 7)) WHERE rank <= 4")
def top_d_tokens(spark, sf):
    x = logits(spark, sf)
    allowed = spark.range(16).select(F.col("id").cast("int").alias("token_id")).where("token_id NOT IN (0, 3, 7)")
    return masking.top_tokens(x, 4, allowed).select("sample_id", "pos", "rank", "token_id", rounded("logit").alias("logit"))


@_query(f"SELECT sample_id, pos, token_id, round(p, 9) AS p FROM (SELECT *, exp(logit - (max(logit) OVER w + ln(sum(exp(logit)) OVER w / exp(max(logit) OVER w)))) AS p, row_number() OVER (PARTITION BY sample_id, pos ORDER BY logit DESC, token_id) AS k FROM ({LOGITS_SQL}) WINDOW w AS (PARTITION BY sample_id, pos)) WHERE k <= 3")
def candidate_probs(spark, sf):
    x = logits(spark, sf)
    return masking.candidate_probabilities(x, masking.top_tokens(x, 3, strict=False)).select("sample_id", "pos", "token_id", F.round("p", 9).alias("p"))


@_query(f"SELECT sample_id, pos, token_id, round(logit - ln(sum(exp(logit)) OVER (PARTITION BY sample_id, pos)), 8) + 0.0 AS logp FROM ({LOGITS_SQL})")
def logsumexp_probs(spark, sf):
    return masking.token_log_probabilities(logits(spark, sf)).select("sample_id", "pos", "token_id", rounded("logp", 8).alias("logp"))


@_query("SELECT p_partkey::INT AS token_id FROM part WHERE p_partkey < 120 AND p_partkey NOT IN (5, 7, 11) UNION SELECT p_partkey::INT FROM part WHERE p_partkey >= 120 AND p_partkey < 150 AND p_partkey NOT IN (5, 7, 11)")
def allowed_tokens(spark, sf):
    vocab = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("token_id"))
    special = spark.range(12).select(F.col("id").cast("int").alias("token_id")).where("token_id IN (5, 7, 11)")
    bad = masking.forbidden_tokens(special, special)
    return masking.allowed_tokens(vocab, bad, "text", 120).union(masking.allowed_tokens(vocab, bad, "image", 120, 30))


@_query("SELECT p_partkey::INT AS token_id FROM part WHERE p_partkey NOT IN (5, 7, 11)")
def maskable_tokens(spark, sf):
    vocab = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("token_id"))
    return masking.maskable_tokens(vocab, vocab.where("token_id IN (5, 7, 11)"))


@_query(f"SELECT sample_id, pos, token_id FROM ({TOKENS_SQL}) WHERE attended AND token_id >= 20 AND pos BETWEEN 2 AND 4")
def semantic_region(spark, sf):
    vocab = spark.range(100).select(F.col("id").cast("int").alias("token_id"))
    return masking.semantic_positions(tokens(spark, sf), masking.allowed_tokens(vocab, vocab.limit(0), "image", 20), F.col("pos").between(2, 4))


@_query(f"SELECT sample_id, pos, token_id FROM ({TOKENS_SQL}) WHERE attended AND token_id >= 20 AND token_id NOT IN (25, 50)")
def semantic_positions(spark, sf):
    vocab = spark.range(100).select(F.col("id").cast("int").alias("token_id"))
    allowed = masking.allowed_tokens(vocab, vocab.where("token_id IN (25, 50)"), "image", 20)
    return masking.semantic_positions(tokens(spark, sf), allowed)


@_query(f"""WITH t AS (SELECT sample_id, pos FROM ({TOKENS_SQL}) WHERE attended), k AS (SELECT sample_id, greatest(1, round_even(count(*) * 0.5, 0)::INT) AS k FROM t GROUP BY 1),
o AS (SELECT t.sample_id, j::INT AS traj, pos, row_number() OVER (PARTITION BY t.sample_id, j ORDER BY md5(concat_ws(':', t.sample_id, j, pos, 1234)), pos) AS n FROM t, range(2) r(j))
SELECT o.sample_id, traj, pos FROM o JOIN k USING (sample_id) WHERE n <= k""")
def mask_select(spark, sf):
    return masking.choose_masks(tokens(spark, sf).where("attended"), 2, 0.5)


@_query(f"""WITH t AS (SELECT sample_id, pos FROM ({TOKENS_SQL}) WHERE pos >= 3), k AS (SELECT sample_id, greatest(1, round_even(count(*) * 0.5, 0)::INT) AS k FROM t GROUP BY 1),
o AS (SELECT t.sample_id, j::INT AS traj, pos, row_number() OVER (PARTITION BY t.sample_id, j ORDER BY md5(concat_ws(':', t.sample_id, j, pos, 7)), pos) AS n FROM t, range(2) r(j))
SELECT o.sample_id, traj, pos FROM o JOIN k USING (sample_id) WHERE n <= k""")
def mask_region(spark, sf):
    return masking.choose_masks(tokens(spark, sf), 2, 0.5, 7, region=F.col("pos") >= 3)


@_query("SELECT n, CASE WHEN n = 0 THEN 0 ELSE 18 END AS fixed, CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil(n * 0.35)::INT) END AS share, least(n, greatest(1, round_even(n * 0.25, 0)::INT)) AS masks FROM (SELECT DISTINCT (l_quantity - 1)::INT AS n FROM lineitem)")
def steps_schedule(spark, sf):
    n = table(spark, sf, "lineitem").select((F.col("l_quantity") - 1).cast("int").alias("n")).distinct()
    return n.select("n", st.steps_for(F.col("n"), "18").alias("fixed"), st.steps_for(F.col("n"), "0.35").alias("share"), st.mask_size(F.col("n"), 0.25).alias("masks"))


@_query("SELECT o_orderkey AS sample_id, 0 AS traj, s::INT AS step, ((o_orderkey % 40) // 6 + CASE WHEN s < (o_orderkey % 40) % 6 THEN 1 ELSE 0 END)::INT AS count FROM orders, range(6) r(s)")
def transfer_schedule(spark, sf):
    masked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit(0).alias("traj"), (F.col("o_orderkey") % 40).alias("masked"))
    return masking.transfer_schedule(masked, 6)


@_query("SELECT sample_id, traj, step, pos FROM (SELECT l_orderkey AS sample_id, 0 AS traj, 0 AS step, l_linenumber AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 1 + sample_id % 3")
def transfer_positions(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.lit(0).alias("traj"), F.lit(0).alias("step"), F.col("l_linenumber").alias("pos"), F.col("l_discount").alias("logp"))
    counts = rows.select("sample_id", "traj", "step").distinct().withColumn("count", 1 + F.col("sample_id") % 3)
    return masking.transfer_positions(rows, counts)


@_query(f"SELECT sample_id, min(pos) AS start, max(pos) + 1 AS \"end\" FROM (SELECT sample_id, pos, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM (SELECT DISTINCT sample_id, pos FROM ({TOKENS_SQL}) WHERE attended)) GROUP BY sample_id, g")
def islands(spark, sf):
    return masking.position_runs(tokens(spark, sf).where("attended"))


@_query(f"SELECT sample_id, min(pos) AS start, max(pos) + 1 AS \"end\" FROM ({TOKENS_SQL}) WHERE attended GROUP BY 1")
def span_bounds(spark, sf):
    return masking.span_bounds(tokens(spark, sf).where("attended"))


@_query("""WITH t AS (SELECT o_orderkey, [x::INT for x in range(12)] AS a, list_transform(range(12 + o_orderkey % 2), lambda x: CASE WHEN x >= o_orderkey % 9 AND x < o_orderkey % 9 + o_orderkey % 4 THEN -1 WHEN x >= 12 THEN 77 ELSE x END::INT) AS b FROM orders),
p AS (SELECT *, coalesce(list_position(list_transform(range(1, 13), lambda i: a[i] <> b[i]), true), 13) - 1 AS pre FROM t),
q AS (SELECT *, least(12 - pre, coalesce(list_position(list_transform(range(0, 12), lambda i: a[12 - i] <> b[len(b) - i]), true), 13) - 1) AS suf FROM p)
SELECT o_orderkey, CASE WHEN a = b THEN -1 ELSE pre::INT END AS start, CASE WHEN a = b THEN -1 ELSE (len(b) - suf)::INT END AS "end" FROM q""")
def changed_span(spark, sf):
    k = F.col("o_orderkey")
    a = F.sequence(F.lit(0), F.lit(11))
    b = F.transform(F.sequence(F.lit(0), (11 + k % 2).cast("int")), lambda x: F.when((x >= k % 9) & (x < k % 9 + k % 4), -1).when(x >= 12, 77).otherwise(x))
    rows = table(spark, sf, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return rows.select("o_orderkey", masking.changed_span(F.col("a"), F.col("b")).alias("s")).select("o_orderkey", "s.*")



@_query("SELECT o_orderkey, list_concat(list_concat([x::INT for x in range(o_orderkey % 9)], [100, (o_orderkey % 50)::INT, 101]), [x::INT for x in range(o_orderkey % 9, 12)])[:12] AS token_ids FROM orders")
def prompt_sequences(spark, sf):
    """A marker of two tokens in a prompt of twelve; what is put in has a sign before and after it."""
    k = (F.col("o_orderkey") % 9).cast("int")
    plain = F.sequence(F.lit(0), F.lit(11))
    marked = F.concat(F.slice(plain, F.lit(1), k), F.array(F.lit(-1), F.lit(-2)), F.slice(plain, k + 1, 12 - k))
    rows = table(spark, sf, "orders").select("o_orderkey", plain.alias("plain"), marked.alias("marked"), F.array(F.lit(100), (F.col("o_orderkey") % 50).cast("int"), F.lit(101)).alias("inserted"))
    return rows.select("o_orderkey", masking.insert_at_marker(F.col("plain"), F.col("marked"), F.col("inserted"), 12).alias("token_ids"))


@_query("SELECT greatest(1, ceil((l_quantity % 9) * 0.35)::INT) AS steps, count(*) AS samples FROM lineitem GROUP BY 1")
def step_buckets(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.greatest(F.lit(1), st.steps_for((F.col("l_quantity") % 9).cast("int"), 0.35)).alias("steps"))
    return masking.step_buckets(rows)


# --- scalars, labels, checks -----------------------------------------------------------------

_LABELS = "CASE o_orderkey % 9 WHEN 0 THEN '1' WHEN 1 THEN '\"1\"' WHEN 2 THEN '\" 1 \"' WHEN 3 THEN 'true' WHEN 4 THEN '0.9' WHEN 5 THEN '\"0.9\"' WHEN 6 THEN '\"x\"' WHEN 7 THEN '-2' ELSE NULL END"


@_query("SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 7 THEN -2 END::BIGINT AS label FROM orders")
def label_coercion(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", label_to_int(F.expr(_LABELS)).alias("label"))



@_query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def missing_required(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality")
    return checks.missing_required(docs, ["doc_id", "quality"])


@_query("SELECT DISTINCT vec_id // 4 AS sample_id, CASE WHEN (vec_id // 4) % 5 = 0 THEN 'fewer than two trajectories' ELSE 'an incomplete grid' END AS problem FROM embeddings WHERE (vec_id // 4) % 5 IN (0, 1)")
def broken_tensors(spark, sf):
    c = cells(spark, sf).where("NOT (sample_id % 5 = 0 AND traj > 0) AND NOT (sample_id % 5 = 1 AND traj = 2 AND step = 3)")
    return checks.broken_tensors(c)


@_query("SELECT DISTINCT vec_id // 4 AS sample_id FROM embeddings WHERE (vec_id // 4) % 4 = 1")
def empty_masks(spark, sf):
    c = cells(spark, sf)
    return checks.empty_masks(c, c.select("sample_id", "pos").distinct().where("sample_id % 4 <> 1"))


@_query("SELECT p_partkey, CASE WHEN p_size <= 1 THEN 1 ELSE (ceil((p_size - 1) / 4.0) * 4 + 1)::INT END AS frames, ((p_size - 1) // 4 + 1)::INT AS latent, 1818 + p_partkey * 100000 + p_size AS seed FROM part")
def frame_arithmetic(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", st.align_frames(size).alias("frames"), st.latent_prefix(size).alias("latent"), st.run_seed(1818, F.col("p_partkey"), 100000, size).alias("seed"))


_RATIO = f"{832 / 480!r}::DOUBLE"


@_query(f"SELECT p_partkey, CASE WHEN w < h * {_RATIO} THEN w ELSE greatest(floor(h * {_RATIO}), 1) END::INT AS width, CASE WHEN w < h * {_RATIO} THEN greatest(floor(w / {_RATIO}), 1) ELSE h END::INT AS height FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 1 ELSE p_size * 20 + 100 END AS w, (p_partkey % 37)::INT * 15 + 1 AS h FROM part)")
def crop_sizes(spark, sf):
    w, h = F.when(F.col("p_size") % 10 == 0, 1).otherwise(F.col("p_size") * 20 + 100), (F.col("p_partkey") % 37).cast("int") * 15 + 1
    width, height = st.crop_size(w, h, 832, 480)
    return table(spark, sf, "part").select("p_partkey", width.alias("width"), height.alias("height"))

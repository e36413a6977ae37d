from pyspark.sql import functions as F

from concord.operators import generation


class _Uniform:
    def logits(self, token_ids):
        return [[0.0, 1.0, 2.0] for _ in token_ids]


class _Frames:
    def features(self, record, seed):
        return "none" if record["k"] % 5 == 0 else [[float(seed), float(f)] for f in range(2)]


def test_calls_of_a_small_table_are_dealt_over_tasks(spark):
    records = spark.range(40).select(F.col("id").alias("sample_id"), F.col("id").alias("k")).coalesce(1)
    found = generation.generation_features(records, _Frames, 3, 7, 10)
    assert found.select(F.spark_partition_id().alias("p"), "status").where("status IS NOT NULL").select("p").distinct().count() > 1
    got = {(r.sample_id, r.generation, r.frame): (r.z, r.status) for r in found.collect()}
    want = {(s, g, f): ([7.0 + s * 10 + g, float(f)], "ok") for s in range(40) if s % 5 for g in range(3) for f in range(2)}
    assert got == want | {(s, g, None): (None, "none") for s in range(0, 40, 5) for g in range(3)}


def test_runs_of_a_small_table_are_dealt_over_tasks(spark):
    samples = spark.range(40).select(F.col("id").alias("sample_id"), F.array_repeat(F.lit(1), 4).alias("token_ids")).coalesce(1)
    masks = samples.select("sample_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("traj"), F.lit(2).alias("pos"))
    candidates = samples.select("sample_id", F.array_repeat(F.array(F.lit(0), F.lit(2)), 4).alias("candidate_ids"))
    made = generation.denoise(samples, masks, candidates, _Uniform, 2, 9, batch_size=3, history=True)
    assert made.select(F.spark_partition_id().alias("p"), "pos").where("pos IS NOT NULL").select("p").distinct().count() > 1
    rows = made.collect()
    assert len({(r.sample_id, r.traj, r.step, r.pos) for r in rows}) == len(rows) and sum(r.pos >= 0 for r in rows) == 40 * 2 * 2 * 4
    assert all((r.v is None) == (r.pos < 0) and (r.token_ids is None) == (r.pos >= 0) for r in rows)
    assert all(len(r.token_ids) == 4 for r in rows if r.pos < 0) and sum(r.pos < 0 for r in rows) == 40 * 2

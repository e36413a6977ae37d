import hashlib

import pytest

from concord.llm import sharding


def _brute(shards, slots):
    """Turn by turn over written-out preference lists."""
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    lists = [[(h(f"offset:{s}") % slots + j * (h(f"skip:{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    owner = {}
    turn = 0
    while len(owner) < slots:
        i = turn % len(shards)
        owner[next(x for x in lists[i] if x not in owner)] = i
        turn += 1
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 31), (7, 211), (31, 31)])
def test_table_is_that_of_turns(n, slots):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.fill(shards, slots) == _brute(shards, slots)


def test_shards_are_even_and_few_keys_move():
    names = list(sharding.SHARDS)
    table = sharding.fill(names)
    counts = [table.count(i) for i in range(len(names))]
    assert max(counts) - min(counts) <= 1
    less = sharding.fill(names[:-1])
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != len(names) - 1)
    assert moved < 0.1 * len(table)


@pytest.mark.parametrize(("shards", "slots"), [(["a"], 8), ([], 7), (["a", "a"], 7), ([str(i) for i in range(8)], 7), (["a"], 1)])
def test_bad_tables_are_refused(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_every_row_is_placed_by_its_key(table):
    df = table([(1, "x", "old"), (1, "y", "old"), (None, "z", None), (2, None, None)], "doc_id long, slot string, shard string").withColumnRenamed("slot", "text")
    rows = sharding.with_shard(df, "doc_id").collect()
    owners = sharding.fill(sharding.SHARDS)
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[owners[slot]])
    assert len(rows) == 4 and sharding.with_shard(df.limit(0), "doc_id").count() == 0


def test_shards_are_written_as_folders(spark, table, tmp_path):
    df = table([(i, "t") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() > 20


def test_no_python_runs_on_executors(table, capsys):
    sharding.with_shard(table([(1, "a")], "doc_id long, text string"), "doc_id").explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan

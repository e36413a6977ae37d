import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from concord.llm import store, token_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _shard(rows, width=2):
    sink = io.BytesIO()
    close, sink.close = sink.close, lambda: None
    writer = token_table.Writer(sink, width)
    for key, ids in rows:
        writer.add(key, np.array(ids, np.uint32))
    writer.close()
    return sink.getvalue()


def test_a_shard_gives_back_its_documents(monkeypatch):
    monkeypatch.setattr(token_table, "BLOCK_BYTES", 200)
    r = random.Random(0)
    keys = [None, -(2**63), -5, -5, 0, 1, 255, 256, 2**40, 2**63 - 1, *sorted(r.randrange(1000, 10**6) for _ in range(300))]
    keys = sorted(keys, key=token_table.key_of)
    rows = [(k, [r.randrange(50_000) for _ in range(r.choice((0, 1, 5, 90)))]) for k in keys]
    shard = token_table.Shard(pa.BufferReader(_shard(rows)))
    assert [(k, ids.tolist()) for k, ids in shard] == rows
    assert len(shard.index) > 20 and shard.ids == sum(len(i) for _, i in rows)
    for k in (None, -5, 2**63 - 1, keys[100]):
        before = np.cumsum([0, *(len(i) for _, i in rows)]).tolist()
        assert [(b, i.tolist()) for b, i in shard.get(k)] == [(b, i) for b, (q, i) in zip(before, rows, strict=False) if q == k]
    assert sum(bool(shard.get(k)) for k in range(2_000_000, 2_000_300)) == 0


def test_a_lookup_reads_one_block(monkeypatch):
    monkeypatch.setattr(token_table, "BLOCK_BYTES", 100)
    data = _shard([(k, [k % 50_000] * 10) for k in range(0, 4000, 2)])
    for k in (0, 2, 1998, 2000, 3998, 1234):
        shard = token_table.Shard(pa.BufferReader(data))
        assert len(shard.index) > 200
        assert [(b, i.tolist()) for b, i in shard.get(k)] == [(k * 5, [k] * 10)] and shard.blocks_read == 1
    reads = 0
    for k in range(1, 4000, 40):
        shard = token_table.Shard(pa.BufferReader(data))
        assert shard.get(k) == []
        reads += shard.blocks_read
    assert reads < 10  # the filter answers for most


def test_a_task_rolls_over_to_another_shard(monkeypatch, tmp_path):
    from types import SimpleNamespace

    import pyspark

    monkeypatch.setattr(token_table, "SHARD_DOCUMENTS", 10)
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(24)], pa.int64()), "text": [f"text {i}" for i in range(25)]})
    made = pa.Table.from_batches(token_table._write(f"file://{tmp_path}/t", PATH, 2, iter([batch]))).to_pylist()
    assert [(m["shard"], m["part"], m["documents"], m["first"], m["last"]) for m in made] == [(3, 0, 10, None, 8), (3, 1, 10, 9, 18), (3, 2, 5, 19, 23)]


def test_damage_is_noticed():
    data = bytearray(_shard([(1, [1, 2, 3])]))
    data[12] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        list(token_table.Shard(pa.BufferReader(bytes(data))))
    for bad in (b"", b"x" * 200, bytes(data[:-3])):
        with pytest.raises(ValueError):
            token_table.Shard(pa.BufferReader(bad))
    with pytest.raises(ValueError, match="ascending"):
        _shard([(2, []), (1, [])])
    assert list(token_table.Shard(pa.BufferReader(_shard([])))) == []


def test_tables_round_trip(spark, table, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table is one shard
    rows = [(i, f"document {i} " * (i % 7), "c") for i in range(200)] + [(None, "none", None), (50, "again", None), (51, None, None), (-3, "é" * 20_000, None)]
    folder = f"file://{tmp_path}/t"
    token_table.write_token_tables(table(rows, "doc_id long, text string, n_tokens string").repartition(5), folder, PATH, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(store.committed(folder)) > 1
    got = token_table.read_token_tables(spark, folder).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    got.sort(key=lambda r: r.start)
    start, ids_before = 0, []
    for r in got:
        assert r.token_ids in want[r.doc_id] and r.start == start and r.n_tokens == len(r.token_ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        start += r.n_tokens
        ids_before.append(r.doc_id)
    assert ids_before[0] is None and ids_before[1:] == sorted(ids_before[1:]) and len(got) == len(rows)
    starts = {r.doc_id: r.start for r in got}
    for i in (7, None, -3, 199):
        found = token_table.find_document(spark, folder, i)
        assert found.first().token_ids == want[i][0] and found.first().start == starts[i]
        assert found.rdd.getNumPartitions() <= 2  # of several shards
    assert token_table.find_document(spark, folder, 50).count() == 2 and token_table.find_document(spark, folder, 999).count() == 0


def test_an_empty_table(spark, table, tmp_path):
    folder = f"file://{tmp_path}/t"
    token_table.write_token_tables(table([], "doc_id long, text string"), folder, PATH)
    assert token_table.read_token_tables(spark, folder).count() == 0

"""Queries over tables whose last sample has fewer embeddings than others, compared with their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from concord.plans import round_trips
from tests.test_entry import _same


def _compare(spark, folder, name):
    df = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    db = duckdb.connect()
    for t in os.listdir(folder):
        db.execute(f"CREATE VIEW {t.partition('.')[0]} AS SELECT * FROM '{folder}/{t}{'/*.parquet' if os.path.isdir(f'{folder}/{t}') else ''}'")
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    want = sorted((tuple(r) for r in want), key=repr)
    assert len(got) == len(want) and all(_same(a, b) for a, b in zip(got, want, strict=True))
    return got


@pytest.fixture(scope="module", params=[1, 2])
def cut(request, spark, sf, tmp_path_factory):
    """Twenty whole samples and one or two embeddings of another."""
    folder = str(tmp_path_factory.mktemp(f"cut{request.param}"))
    spark.read.parquet(f"{sf}/embeddings.parquet").where(f"vec_id < {80 + request.param}").write.parquet(f"{folder}/embeddings.parquet")
    return folder, request.param


@pytest.mark.parametrize("name", ["blackbox_final_step", "blackbox_multi_step", "blackbox_scores"])
def test_black_box_of_fewer_pairs_than_k(spark, cut, name):
    folder, rest = cut
    assert len(_compare(spark, folder, name)) == 20 + (rest == 2)


def test_streamed_sample_of_fewer_cells(spark, cut):
    folder, rest = cut
    assert len(_compare(spark, folder, "streamed_evidence")) == 20 + (rest == 2)


def test_a_file_a_text_is_written_by_several_tasks(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/supplier.parquet").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = round_trips.QUERIES["read_labelled_folders"](spark, str(tmp_path))
    parts = {f.rpartition("/")[2][:10] for f in found.inputFiles()}
    assert len(parts) > 1  # part-00000, part-00001, ...
    _compare(spark, str(tmp_path), "read_labelled_folders")

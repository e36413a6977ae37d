import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from concord.llm import store, warc

PAGES = "page_id long, url string, html string, record_type string"


def _pages(table):
    long, other = "é" * 600, "x" * 999
    rows = [(1, "http://a", long, "q"), (5, None, long, "q"), (3, "http://c\r\nX: y", long, None), (2, "u", other, None), (4, "u", other, None), (6, "u", None, None), (7, "u", "", None), (None, "u", long, None), (8, "u", "z" * 300_000, None), (5, "again", long, None)]
    return rows, table(rows, PAGES)


def test_records_come_back_as_they_were(spark, table, tmp_path):
    rows, pages = _pages(table)
    folder = f"file://{tmp_path}/w"
    warc.archive_pages(pages.repartition(3), folder)
    got = warc.page_records(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        data = html.encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        revisits = len(data) >= 1000 and data == rows[0][2].encode() and r.page_id != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisits else ("response", None))
        assert (r.payload or b"") == (b"" if revisits else data)
    assert {r.url for r in got if r.page_id == 3} == {"http://c%0D%0AX: y"}


def test_archives_are_gzip_members_with_skip_lengths(spark, table, tmp_path):
    _, pages = _pages(table)
    folder = f"file://{tmp_path}/w"
    warc.archive_pages(pages.coalesce(1), folder)
    for f in store.committed(folder):
        with gzip.open(f["file"].removeprefix("file://")) as z:
            text = z.read()
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Type:") >= 1


def test_filters_reach_the_reader_and_payloads_are_not_read(spark, table, tmp_path, capsys):
    rows, pages = _pages(table)
    folder = f"file://{tmp_path}/w"
    warc.archive_pages(pages, folder)
    few = warc.read_archives(spark, folder, "record_type string, target_uri string, payload_bytes long")
    wanted = few.where((F.col("record_type") == "response") & F.col("target_uri").startswith("u") & (F.col("payload_bytes") > 10))
    wanted.explain()
    assert "Filter" not in capsys.readouterr().out.replace("RuntimeFilters", "")
    assert wanted.count() == 3  # the records of pages 2, 4 and 8
    # rows of the same large payload other than the largest page_id's, which two rows have
    assert few.where(~F.col("record_type").isin("response")).count() == sum(html == rows[0][2] and i != 5 for i, _, html, _ in rows)
    assert few.where(F.col("target_uri").isNull()).count() == 1


def test_plain_archives_and_others_gzip_are_read(spark, tmp_path):
    records = [warc.record([("WARC-Type", t), ("WARC-Record-ID", f"<{i}>"), ("WARC-Payload-Digest", "sha1:" + "A" * 32 if i == 9 else "")], p) for i, (t, p) in enumerate([("warcinfo", b"a: b\r\n\r\n"), ("response", b"x" * 50_000), ("response", b"")])]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    df = warc.read_archives(spark, f"file://{tmp_path}")
    assert df.count() == 6
    for name in ("a.warc", "b.warc.gz"):
        got = df.where(F.col("file").endswith(name)).orderBy("offset").collect()
        assert [(r.record_id, len(r.payload)) for r in got] == [("<0>", 8), ("<1>", 50_000), ("<2>", 0)]


def test_damage_is_an_error(spark, tmp_path):
    good = warc.member(warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(b"y").hexdigest())], b"x"))
    (tmp_path / "a.warc.gz").write_bytes(good)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()
    (tmp_path / "a.warc.gz").write_bytes(good[:40])
    with pytest.raises(Exception, match="ends within"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_an_empty_table_makes_an_empty_folder(spark, table, tmp_path):
    warc.archive_pages(table([], PAGES), f"file://{tmp_path}/w")
    assert warc.page_records(spark, f"file://{tmp_path}/w").count() == 0


def test_headers_go_on_over_lines():
    assert warc.parse_headers(b"WARC/1.0\r\nA: b\r\n c\r\nD : e:f") == {"a": "b c", "d": "e:f"}

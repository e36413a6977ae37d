import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pytest

from concord.llm import media, store

ROWS = [(1, "a", "x"), (2, "", None), (3, None, None), (None, "null", None), (4, "é" * 5000, "y"), (5, "a", None), (5, "a", None), (6, "z" * 576, None), (7, "z" * 577, None), (-8, "long " * 100_000, None)]


def test_payloads():
    for text, size in ((None, 576), ("", 576), ("a", 576), ("a" * 576, 576), ("a" * 577, 1152)):
        p = media.padded(text)
        assert len(p) == size and p.rstrip(b"\xff") == (text or "").encode()
        assert media.from_png(media.to_png(p)).tobytes() == p


def test_images_are_png():
    image = media.to_png(media.padded("x" * 1000))
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (576, 2) and image[-8:-4] == b"IEND"
    for bad in (b"", image[:-20], image[:60] + bytes([image[60] ^ 1]) + image[61:], image[:24] + b"\x10" + image[25:]):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            media.from_png(bad)


def test_what_is_stored_comes_back(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SPLIT_BYTES", 4096)
    folder = f"file://{tmp_path}/m"
    media.write_media(table(ROWS, "doc_id long, text string, name string").coalesce(1), folder)
    got = media.media_digests(spark, folder).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for r in got:
        text = next(t for i, t, _ in ROWS if i == r.doc_id) or ""
        data = text.encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert by_text.setdefault(text, tuple(r)[1:]) == tuple(r)[1:]
    with tarfile.open(store.committed(folder)[0]["file"].removeprefix("file://")) as t:
        assert len(t.getnames()) == len(ROWS) and "null.png" in t.getnames()


def test_ranges_are_planned_and_columns_chosen(spark, table, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_media(table([(i, "text %d " % i * 100) for i in range(40)], "doc_id long, text string").coalesce(1), folder)
    files = store.committed(folder)
    with store.open_file(files[0]["file"]) as f:
        size = 512 + media.parse_tar_header(f.read_at(512, 0))[1]
    first = size + -size % 512
    (tmp_path / "m" / store.MANIFEST).write_text(str([{**files[0], "splits": [0, first]}]).replace("'", '"'))
    df = media.read_media(spark, folder, "name string, media_bytes long")
    assert df.rdd.getNumPartitions() == 2 and df.count() == 40 and df.select("name").distinct().count() == 40
    (tmp_path / "m" / store.MANIFEST).unlink()
    assert media.read_media(spark, folder, "name string").count() == 40  # an archive of no known splits is one range


def test_a_damaged_member_is_told_and_the_others_are_read(spark, table, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_media(table([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1), folder)
    path = store.committed(folder)[0]["file"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[512 + 50] ^= 255
    open(path, "wb").write(data)
    df = media.read_media(spark, folder, "name string, error string, offset long, payload_bytes long")
    rows = df.collect()
    assert len(rows) == 5 and [r.error is None for r in rows] == [False, True, True, True, True] and rows[0].payload_bytes is None
    with pytest.raises(Exception, match="0.png"):
        media.media_digests(spark, folder).collect()


def test_a_member_is_read_again_by_its_offset(monkeypatch, tmp_path):
    folder = f"file://{tmp_path}"
    image = media.to_png(media.padded("again"))
    data = media.tar_header("1.png", len(image)) + image + b"\0" * (-len(image) % 512)
    (tmp_path / "a.tar").write_bytes(data + b"\0" * 1024)
    reader = media._MediaReader({"path": folder, "retryseconds": "0"}, media_schema())
    tries = []
    real = media.from_png
    monkeypatch.setattr(media, "from_png", lambda b: (_ for _ in ()).throw(OSError("gone")) if not tries and not tries.append(1) else real(b))
    batches = list(reader.read(reader.partitions()[0]))
    assert batches[0].to_pylist() == [{"name": "1.png", "error": None, "payload_bytes": 576}] and tries == [1]


@pytest.mark.parametrize("damage", ["zeros", "cut", "short"])
def test_members_before_a_known_end_do_not_vanish(monkeypatch, tmp_path, damage):
    members = []
    for k in range(3):
        image = media.to_png(media.padded(f"text {k}"))
        members.append(media.tar_header(f"{k}.png", len(image)) + image + b"\0" * (-len(image) % 512))
    whole, first = b"".join(members), len(members[0])
    path = tmp_path / "a.tar"
    bad = {"zeros": whole[:first] + b"\0" * 512 + whole[first + 512 :], "cut": whole[:first], "short": whole[: first + 100]}[damage]
    path.write_bytes(bad)
    reader = media._MediaReader({"path": f"file://{tmp_path}", "retryseconds": "0"}, media_schema())
    part = media._Range(f"file://{path}", 0, len(whole))
    with pytest.raises(ValueError, match=f"a.tar at {first}"):
        list(reader.read(part))
    # whole again at the next try
    monkeypatch.setattr(media.time, "sleep", lambda s: path.write_bytes(whole))
    assert [r["name"] for b in reader.read(part) for r in b.to_pylist()] == ["0.png", "1.png", "2.png"]


def media_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL("name string, error string, payload_bytes long")


def test_headers_are_those_of_tar():
    for name, size in (("a.png", 0), ("b.png", 8**11 - 1), ("c.png", 8**11)):
        assert media.parse_tar_header(media.tar_header(name, size)) == (name, size, b"0")
    assert media.parse_tar_header(b"\0" * 512) is None
    with pytest.raises(ValueError):
        media.parse_tar_header(b"x" * 512)


def test_features_differ_with_the_samples():
    assert media.features(np.arange(576, dtype=np.uint8).reshape(1, -1)) != media.features(np.zeros((1, 576), np.uint8))


def test_an_empty_table(spark, table, tmp_path):
    media.write_media(table([], "doc_id long, text string"), f"file://{tmp_path}/m")
    assert media.media_digests(spark, f"file://{tmp_path}/m").count() == 0

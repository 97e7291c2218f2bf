"""Members of zips by their directories, against ``zipfile``."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kotonoha.sources import banks as B
from kotonoha.sources import members as M


def _pack(files, method=zipfile.ZIP_DEFLATED, comment=b""):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as z:
        for name, data in files:
            z.writestr(name, data)
        z.comment = comment
    return buffer.getvalue()


def _rows(df):
    return sorted((r.archive.rsplit("/", 1)[1], r.path, bytes(r.content)) for r in df.collect())


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    """Thousands of entries in one zip: all of them, by several tasks, each of which reads parts of the file."""
    rng = random.Random(3)
    files = [(f"d/{i}.bin", rng.randbytes(rng.randrange(0, 2000))) for i in range(3000)]
    (tmp_path / "a.zip").write_bytes(_pack(files))
    read = M.read_members(M.zip_members(spark, str(tmp_path)), split=1 << 18)
    held = read.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(held) >= 4 and max(r["count"] for r in held) < 2000
    assert _rows(read) == sorted(("a.zip", n, d) for n, d in files)


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_methods(spark, tmp_path, method):
    files = [("a", b"x" * 5000), ("empty", b""), ("dir/", b""), ("あ/い.json", "[]".encode()), ("a", b"second of one name")]
    with pytest.warns(UserWarning):
        (tmp_path / "m.zip").write_bytes(b"before it" + _pack(files, method, b"c" * 300))
    got = _rows(M.read_members(M.zip_members(spark, str(tmp_path))))
    assert got == sorted(("m.zip", n, d) for n, d in files if not n.endswith("/"))


def test_only_what_is_wanted(spark, tmp_path):
    """Kinds follow from the directory; media are left out before they are read: the one that is torn isn't noticed."""
    data = bytearray(_pack([("index.json", b"{}"), ("img.png", b"\x00" * 400), ("tag_bank_1.json", b"[]")], zipfile.ZIP_STORED))
    at = data.index(b"\x00" * 400)
    data[at : at + 4] = b"torn"
    (tmp_path / "a.zip").write_bytes(bytes(data))
    routed = B.route_entries(M.zip_members(spark, str(tmp_path)))
    assert _rows(M.read_members(routed.where("kind <> 'media'"))) == [("a.zip", "index.json", b"{}"), ("a.zip", "tag_bank_1.json", b"[]")]
    assert ("a.zip", B.BROKEN, b"img.png: bad checksum") in _rows(M.read_members(routed))


def test_broken_zips(spark, tmp_path):
    """What can't be read gives reasons, the same rows as the reader of whole files has; the rest is read. An empty file isn't seen."""
    sound = _pack([("index.json", b"{}"), ("b.json", b"[" + b"1," * 500 + b"1]")])
    locked = bytearray(sound)
    for sign, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(sign) + offset] |= 1
    moved = bytearray(sound)
    moved[:4] = b"none"
    for name, data in {"good": sound, "none": b"no zip", "short": sound[:-30], "locked": bytes(locked), "moved": bytes(moved), "empty": b""}.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    got = _rows(M.read_members(M.zip_members(spark, str(tmp_path))))
    whole = _rows(B.read_archives(spark, str(tmp_path)))
    assert [r[:2] for r in got] == [r[:2] for r in whole] and [r for r in got if r[1] != B.BROKEN] == [r for r in whole if r[1] != B.BROKEN]
    assert {a for a, p, _ in got if p == B.BROKEN} == {"none.zip", "short.zip", "locked.zip", "moved.zip"}


def test_no_zips(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert M.read_members(M.zip_members(spark, str(tmp_path))).collect() == []

"""Files in splits and archives by member, against Python's own readers."""

import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.sources import splits, zips


def test_numbers_equal_enumerate(spark, tmp_path):
    r = random.Random(1)
    ends = ["\n", "\r\n", "\r", "\n\n"]
    texts = {"a.txt": "".join("x" * r.randrange(60) + r.choice(ends) for _ in range(3000)), "b.txt": "one line", "c.txt": "", "d.txt": "\n", "e.txt": "﻿mark\nnext", "f.txt": "é" * 4000 + "\nlast"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    lines = splits.numbered_lines(spark, str(tmp_path), split_bytes=700)
    assert lines.rdd.getNumPartitions() > 50
    got = {}
    for row in lines.collect():
        got.setdefault(row.source_path.rsplit("/", 1)[1], {})[row.source_row_number] = row.value
    for name, t in texts.items():
        with open(tmp_path / name, encoding="utf-8-sig") as f:
            assert got.get(name, {}) == {k: line.removesuffix("\n") for k, line in enumerate(f, 1)}


@pytest.fixture(scope="module")
def binaries(tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("binaries"), random.Random(2)
    for name, data in {"random": r.randbytes(300_000), "none": b"", "feed": b"\n", "feeds": b"\n" * 5000, "plain": b"x" * 9999, "mark": b"\xef\xbb\xbf" + r.randbytes(50_000) + b"\n", "mark2": b"\xef\xbb\xbf", "cr": b"\r\n\r" * 999}.items():
        (folder / name).write_bytes(data)
    return folder


@pytest.mark.parametrize("split, chunk", [(1000, 300), (50_000, 1 << 20)])
def test_every_byte_is_in_one_chunk(spark, binaries, split, chunk):
    files = {}
    for r in splits.byte_chunks(spark, str(binaries), split, chunk).collect():
        files.setdefault(r.source_path.rsplit("/", 1)[1], []).append((r.offset, bytes(r.bytes), r.size))
    for f in binaries.iterdir():
        want, at = f.read_bytes(), 0
        for offset, part, size in sorted(files.get(f.name, [])):
            assert offset == at and size == len(want) and part == want[at : at + len(part)] and part
            at += len(part)
        assert at == len(want)


def test_checksums_equal_hashlib(spark, binaries):
    got = {r.source_path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in splits.checksums(spark, str(binaries), 2000, 500).collect()}
    assert got == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in binaries.iterdir()}


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("archives"), random.Random(3)
    inner = folder / "inner"
    members = {f"d/{i}.bin": r.randbytes(r.randrange(20_000)) if i % 2 else b"ab\n" * r.randrange(40_000) for i in range(12)} | {"empty": b"", "größe.txt": "Größe".encode()}
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("d/", "")
        for k, (name, data) in enumerate(members.items()):
            z.writestr(name, data, zipfile.ZIP_STORED if k % 3 == 0 else zipfile.ZIP_DEFLATED)
        z.comment = b"a comment of the archive"
    with zipfile.ZipFile(folder / "outer.zip", "w") as z:
        z.writestr("in.zip", inner.read_bytes(), zipfile.ZIP_DEFLATED)
    inner.rename(folder / "inner.zip")
    return folder, members


def contents(chunks):
    out = {}
    for r in chunks.orderBy("source_path", "offset").collect():
        name = r.source_path.rsplit("!", 1)[1]
        assert r.offset == len(out.get(name, b""))
        out[name] = out.get(name, b"") + bytes(r.bytes)
    return out


def test_members_equal_the_standard_library(spark, archive):
    folder, want = archive
    chunks = zips.kept_chunks(splits.byte_chunks(spark, str(folder / "inner.zip"), 3000, 1000))
    found = zips.members(chunks)
    with zipfile.ZipFile(folder / "inner.zip") as z:
        assert {(r.member, r.method, r.crc, r.packed, r.length, r.start) for r in found.collect()} == {(i.filename, i.compress_type, i.CRC, i.compress_size, i.file_size, i.header_offset) for i in z.infolist()}
    assert contents(zips.member_chunks(chunks, found, 700)) == {n: d for n, d in want.items() if d}


def test_a_path_that_only_spark_reads_and_an_archive_within(spark, archive):
    folder, want = archive
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.zips.link./in", f"file://{folder}")
    chunks = zips.kept_chunks(splits.byte_chunks(spark, "viewfs://zips/in/outer.zip", 4096))
    inside = zips.kept_chunks(zips.member_chunks(chunks, zips.members(chunks), 5000))
    assert inside.count() > 5
    got = zips.member_chunks(inside, zips.members(inside))
    assert contents(got) == {n: d for n, d in want.items() if d}
    # a member is a task's work, several members are several tasks'
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = zips._dealt(inside, zips.members(inside), *zips._KEYS).select("member", F.spark_partition_id().alias("p")).distinct().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in parts}) > 1 and len(parts) == len({r.member for r in parts})


def broken(archive, tmp_path, change):
    data = bytearray((archive[0] / "inner.zip").read_bytes())
    change(data)
    (tmp_path / "x.zip").write_bytes(bytes(data))
    return str(tmp_path / "x.zip")


@pytest.mark.parametrize("change, told", [(lambda d: d.__setitem__(slice(200, 210), b"0123456789"), "CRC|Error"), (lambda d: d.__delitem__(slice(-80, None)), "no ZIP archive"), (lambda d: d.__setitem__(slice(0, 4), b"XXXX"), "no member")])
def test_broken_archives_raise(spark, archive, tmp_path, change, told):
    chunks = zips.kept_chunks(splits.byte_chunks(spark, broken(archive, tmp_path, change)))
    with pytest.raises(Exception, match=told):
        zips.member_chunks(chunks, zips.members(chunks)).collect()


def test_rows_of_csv_members(spark, tmp_path):
    text = 'a,b\r\n"1\n2",x\r"q""",é\n\nlast,'
    with zipfile.ZipFile(tmp_path / "r.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n in ("one.csv", "two.csv"):
            z.writestr(n, "﻿" + text)
    chunks = zips.kept_chunks(splits.byte_chunks(spark, str(tmp_path / "r.zip")))
    for most in (3, 1 << 20):
        rows = zips.member_rows(chunks, zips.members(chunks), most).orderBy("member", "source_row_number").collect()
        assert [(r.source_row_number, r.fields) for r in rows if r.member == "one.csv"] == [(1, ["a", "b"]), (2, ["1\n2", "x"]), (3, ['q"', "é"]), (4, []), (5, ["last", ""])]
        assert len(rows) == 10


def test_tables_can_be_dropped_once_results_are_read(spark, monkeypatch):
    from pathlib import Path

    from quillon.sources import shared

    monkeypatch.setattr(shared, "_made", [])  # tables of other tests stay
    table = shared.written(spark.range(5), "five")
    path = Path(shared._made[0].removeprefix("file://"))
    assert table.count() == 5 and path.exists()
    assert shared.drop_written(spark) == 1 and not path.exists() and shared.drop_written(spark) == 0

"""Zip archives and folders as data sources: what is read, what is written, and what stays when a write fails."""

import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringEndsWith

from fieldloom.sources import containers


class Counting(containers.PushingZipReader):
    """Counts the bytes that are read."""

    read_bytes = 0

    def open(self, path):
        raw, reader = super().open(path), self

        class File:
            closed = False

            def read(self, n=-1):
                data = raw.read(n if n is not None and n >= 0 else None)
                reader.read_bytes += len(data)
                return data

            def __getattr__(self, name):
                return getattr(raw, name)

            def __enter__(self):
                return self

            def __exit__(self, *a):
                raw.close()

        return File()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("zips"), random.Random(1)
    for k in range(3):
        with zipfile.ZipFile(path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for n in range(40):
                z.writestr(f"m{n}.json", f"[{k}, {n}]")
            z.writestr("large.bin", rng.randbytes(3_000_000))
            z.writestr("empty.txt", b"")
            z.writestr("dir/", b"")
    return path


def rows_of(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_only_wanted_bytes_are_read(folder):
    reader = Counting({"path": str(folder)})
    assert [type(f) for f in reader.pushFilters([EqualTo(("name",), "m7.json"), IsNotNull(("name",)), EqualTo(("size",), 6)])] == [IsNotNull, EqualTo]
    rows = rows_of(reader)
    assert sorted(r["content"] for r in rows) == [b"[0, 7]", b"[1, 7]", b"[2, 7]"]
    assert reader.read_bytes < 60_000  # of 9 MB: directories, headers and three members
    both = Counting({"path": str(folder), "pattern": r"^m1"})
    assert list(both.pushFilters([In(("name",), ("m1.json", "m12.json", "m2.json")), StringEndsWith(("name",), "2.json")])) == []
    assert {r["name"] for r in rows_of(both)} == {"m12.json"}


def test_ranges_hold_each_member_once(folder):
    whole = sorted((r["archive"], r["name"]) for r in rows_of(containers.ZipReader({"path": str(folder)})))
    assert len(whole) == 3 * 42
    small = containers.ZipReader({"path": str(folder), "taskbytes": "1000", "chunkbytes": "100000"})
    assert len(small.partitions()) > 9000
    small = containers.ZipReader({"path": str(folder / "1.zip"), "taskbytes": "100000", "chunkbytes": "100000"})
    rows = rows_of(small)
    assert len({(r["archive"], r["name"]) for r in rows}) == 42 and len(rows) == 41 + 30
    large = b"".join(r["content"] for r in sorted((r for r in rows if r["name"] == "large.bin"), key=lambda r: r["part"]))
    assert large == zipfile.ZipFile(folder / "1.zip").read("large.bin")
    assert [r["content"] for r in rows if r["name"] == "empty.txt"] == [b""]


def test_small_archives_share_a_task(tmp_path):
    """A task for each archive, and a batch for each member, were what reading many of them took longest for."""
    for k in range(700):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("a.json", str(k))
            z.writestr("b.json", "x" * k)
    reader = containers.ZipReader({"path": str(tmp_path)})
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(parts) == 2 and len(batches) == 3
    assert sorted(int(r["content"]) for r in rows if r["name"] == "a.json") == list(range(700)) and sum(len(r["content"]) for r in rows if r["name"] == "b.json") == 700 * 699 // 2


def test_checksums_are_combined_by_maps_made_once():
    rng = random.Random(5)
    containers._zero_bytes.cache_clear()
    for _ in range(200):
        a, b = rng.randbytes(rng.randint(0, 900)), rng.randbytes(rng.randint(0, 900))
        assert containers.combined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert containers._zero_bytes.cache_info().misses <= 13  # a bit, and up to 512 bytes


def test_reading_by_spark(spark, folder):
    members = containers.zip_members(spark, str(folder))
    assert members.where("name = 'm3.json'").count() == 3
    assert containers.zip_members(spark, str(folder), content="false").where("name = 'large.bin' AND content IS NULL AND size = 3000000").count() == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = containers.zip_members(spark, str(folder)).where(F.col("name").isin("m3.json", "m4.json") & (F.col("size") > 0))
        assert sorted(bytes(r.content) for r in found.collect()) == [f"[{k}, {n}]".encode() for k in range(3) for n in (3, 4)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="nothing-here"):
        containers.zip_members(spark, str(folder / "nothing-here")).count()


def test_checksums_combine():
    rng = random.Random(2)
    for _ in range(60):
        a, b = rng.randbytes(rng.choice([0, 1, 7, 100, 5000])), rng.randbytes(rng.choice([0, 1, 8, 333, 70000]))
        assert containers.combined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
        assert zlib.decompress(containers.deflated(a) + containers.deflated(b) + containers.LAST_BLOCK, -15) == a + b


def test_archives_out_of_pieces(spark, tmp_path):
    """Entries in order, each the string of its pieces, from many tasks; thousands of pieces; empty and stored entries."""
    rng = random.Random(3)
    wanted, rows = {}, []
    for file in ("a.zip", "b.zip", "é.zip"):
        for rank, name in enumerate(("first", "z/second", "third é", "fourth")):
            parts = [rng.choice([b"", b"x" * rng.randint(0, 50), rng.randbytes(rng.randint(0, 2000))]) for _ in range(5000 if (file, rank) == ("b.zip", 1) else rng.randint(1, 30))]
            wanted[file, name] = b"".join(parts)
            rows += [(file, rank, name, 10 * p, d, rank == 0) for p, d in enumerate(parts)]
    rng.shuffle(rows)
    pieces = spark.createDataFrame(rows, "file string, rank int, name string, pos int, content binary, stored boolean").repartition(6)
    containers.write_archives(pieces, str(tmp_path / "out"))
    for file in ("a.zip", "b.zip", "é.zip"):
        z = zipfile.ZipFile(tmp_path / "out" / file)
        assert z.testzip() is None and z.namelist() == ["first", "z/second", "third é", "fourth"]
        assert all(z.read(n) == wanted[file, n] for n in z.namelist())
        assert [i.compress_type == zipfile.ZIP_STORED for i in z.infolist()] == [True, False, False, False]
    back = containers.zip_members(spark, str(tmp_path / "out"), members="fourth").collect()
    assert sorted(bytes(r.content) for r in back) == sorted(wanted[f, "fourth"] for f in ("a.zip", "b.zip", "é.zip"))


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.createDataFrame([("f1", 1, "b"), ("f1", 0, "a"), ("f2", 0, "c")], "file string, pos int, content string")
    containers.write_folder(rows, path, manifest={"format": "x"})
    before = {p.name: p.read_bytes() for p in (tmp_path / "state").iterdir()}
    assert before["f1"] == b"ab" and set(before) == {"f1", "f2", "manifest.json"}
    with pytest.raises(Exception, match="already"):
        containers.write_folder(rows, path)
    broken = rows.withColumn("content", F.when(F.col("file") == "f2", F.raise_error(F.lit("broken off"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken off"):
        containers.write_folder(broken, path, "overwrite", {"format": "y"})
    unsafe = rows.withColumn("file", F.concat(F.lit("../"), "file"))
    with pytest.raises(Exception, match="unsafe"):
        containers.write_folder(unsafe, path, "overwrite")
    assert {p.name: p.read_bytes() for p in (tmp_path / "state").iterdir()} == before
    assert [p.name for p in tmp_path.iterdir()] == ["state"]
    containers.write_folder(rows.where("file = 'f2'"), path, "overwrite")
    assert {p.name: p.read_bytes() for p in (tmp_path / "state").iterdir()} == {"f2": b"c"}

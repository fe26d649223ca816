"""Zip archives and folders of files as data sources of Spark: a reader that reads what is asked for, and writers that commit.

Reading (format "zip_members"): a row for each file in each zip under the path. A task gets a range of an archive's bytes, or
several small archives. It reads the directory at the archive's end, and of the members that start in its range those that are wanted: by the options
`members` (names between bars) and `pattern`, or by filters on name that Spark pushes down (where
spark.sql.python.filterPushdown.enabled is set; a reader of one's own then takes the option pushFilters). Only their bytes are read, a chunk at a time; a long member comes as
several rows.

Writing (formats "zip_archives" and "file_folder"): rows are pieces of members, so no task needs a whole one. write_archives()
deflates the pieces where they are; deflated pieces can be strung together, and their checksums combined, without the
text. Then each archive is one stream of finished pieces. Everything is written into a folder of its own beside the
target and renamed when all tasks have ended, so a write that is broken off leaves what was there.

Files are opened by pyarrow, so paths are local or of a store that it knows.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..operators.staging import kept

#: Bytes of an archive in a task, and of content in a row, at most.
TASK_BYTES, CHUNK_BYTES = 64 << 20, 16 << 20
#: What opening an archive counts as, in bytes of a task; rows of a batch, at most.
OPEN_BYTES, BATCH_ROWS = 128 << 10, 1000
MEMBER = pa.schema([("archive", pa.string()), ("name", pa.string()), ("part", pa.int32()), ("size", pa.int64()), ("content", pa.binary())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"^\w[\w+.-]*:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class ZipRanges(InputPartition):
    """What a task reads: a range of a large archive, or many small archives."""

    ranges: list[tuple[str, int, int]]

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(None)
        self.ranges = ranges


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.names: set[str] | None = set(options["members"].split("|")) if options.get("members") else None
        self.tests: list[tuple[str, str]] = []

    def wanted(self, name: str) -> bool:
        if self.names is not None and name not in self.names or self.options.get("pattern") and not re.search(self.options["pattern"], name):
            return False
        return all({"StringStartsWith": name.startswith, "StringEndsWith": name.endswith, "StringContains": name.__contains__}[kind](value) for kind, value in self.tests)

    def archives(self) -> list[fs.FileInfo]:
        system, path = opened(self.options["path"])
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        return sorted((f for f in ([info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

    def partitions(self) -> list[ZipRanges]:
        """Ranges of all archives, by their lengths alone: no archive is opened here. Small archives share a task."""
        task = int(self.options.get("taskbytes") or TASK_BYTES)
        out, filled = [], task
        for f in self.archives():
            if f.size > task:
                out += [ZipRanges([(f.path, at, at + task)]) for at in range(0, f.size, task)]
                filled = task
                continue
            filled += f.size + OPEN_BYTES
            if filled > task:
                out.append(ZipRanges([]))
                filled = f.size + OPEN_BYTES
            out[-1].ranges.append((f.path, 0, f.size + 1))
        return out

    def open(self, path: str):
        return opened(self.options["path"])[0].open_input_file(path)

    def read(self, partition: ZipRanges) -> Iterator[pa.RecordBatch]:
        """Rows in batches of BATCH_ROWS and of the bytes of a chunk, or of a row and one chunk more."""
        chunk = int(self.options.get("chunkbytes") or CHUNK_BYTES)
        rows, held = [], 0
        for archive, start, stop in partition.ranges:
            for row in self.members(archive, start, stop, chunk):
                rows.append(row)
                held += len(row[4] or b"")
                if len(rows) >= BATCH_ROWS or held >= chunk:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def members(self, archive: str, start: int, stop: int, chunk: int) -> Iterator[tuple]:
        """The rows of the members that start from start on and before stop."""
        with self.open(archive) as raw, zipfile.ZipFile(raw) as z:
            for info in z.infolist():
                if info.is_dir() or not start <= info.header_offset < stop or not self.wanted(info.filename):
                    continue
                if self.options.get("content") == "false":
                    yield archive, info.filename, 0, info.file_size, None
                    continue
                with z.open(info) as member:
                    part, data = 0, member.read(chunk)
                    while data or not part:
                        yield archive, info.filename, part, info.file_size, data
                        part, data = part + 1, member.read(chunk)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), MEMBER)], schema=MEMBER)


class PushingZipReader(ZipReader):
    """The reader where Spark pushes filters down; it refuses a reader that takes filters where it doesn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on the name, which no content is needed for; all others stay Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("name",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif isinstance(f, (StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f


class ZipMembers(DataSource):
    """spark.read.format("zip_members").option("members", "a.json|b.json").load(path): archive, name, part, size and content."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, part int, size long, content binary"

    def reader(self, schema) -> ZipReader:
        return (PushingZipReader if self.options.get("pushfilters") == "true" else ZipReader)(dict(self.options))


# ---- writing


def _times(matrix: Sequence[int], vector: int) -> int:
    """A linear map over bits, applied to a vector of 32."""
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@lru_cache(maxsize=64)
def _zero_bytes(power: int) -> tuple[int, ...]:
    """What 2^power zero bytes do to a checksum; 2^-3 is a bit."""
    if power == -3:
        return (0xEDB88320, *(1 << k for k in range(31)))  # a zero bit through the reflected polynomial
    half = _zero_bytes(power - 1)
    return tuple(_times(half, row) for row in half)


def combined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two strings together, from theirs and the second's length: the first one's goes through as many zero bytes,
    a linear map over bits whose squarings, worked out once, double the bytes."""
    power = 0
    while first and length >> power:
        if length >> power & 1:
            first = _times(_zero_bytes(power), first)
        power += 1
    return first ^ second


#: The end of a string of deflated pieces: an empty last block.
LAST_BLOCK = b"\x03\x00"


def deflated(data: bytes) -> bytes:
    """A piece of a deflated stream that ends at a whole byte and isn't the last."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush(zlib.Z_FULL_FLUSH) if data else b""


def _entry(name: str, stored: bool, crc: int, packed: int, size: int, offset: int | None) -> bytes:
    """A local header, or with an offset a directory entry; sizes that need it go to a 64-bit extra field."""
    encoded, long = name.encode(), max(packed, size, offset or 0) >= 0xFFFFFFFF
    values = [size, packed] + ([offset] if offset is not None else [])
    extra = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if long else b""
    short = [0xFFFFFFFF if long else v for v in (packed, size)]
    common = struct.pack("<HHHHHIIIHH", 45 if long else 20, 0x800, 0 if stored else 8, 0, 0x21, crc, *short, len(encoded), len(extra))
    if offset is None:
        return b"PK\x03\x04" + common + encoded + extra
    return b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0xFFFFFFFF if long else offset) + encoded + extra


class ZipStream:
    """An archive written front to back: entries whose sums are known, then their pieces, then the directory."""

    def __init__(self, out):
        self.out, self.at, self.directory, self.count = out, 0, [], 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str, stored: bool, crc: int, packed: int, size: int) -> None:
        self.directory.append(_entry(name, stored, crc, packed, size, self.at))
        self.put(_entry(name, stored, crc, packed, size, None))

    def close(self) -> None:
        start = self.at
        for entry in self.directory:
            self.put(entry)
        length, count = self.at - start, len(self.directory)
        if count >= 0xFFFF or start + length >= 0xFFFFFFFF:
            end = self.at
            self.put(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start))
            self.put(b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1))
        self.put(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(length, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (name, size, sha256) of each file."""

    files: list[tuple[str, int, str]]


class _Hashed:
    """An output that knows its length and SHA-256."""

    def __init__(self, out):
        self.out, self.size, self.sha = out, 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha.update(data)

    def close(self) -> None:
        self.out.close()


class FolderWriter(DataSourceArrowWriter):
    """Files into a draft folder; the whole is moved to its place by commit()."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.path = options["path"].rstrip("/")
        parent, _, own = self.path.rpartition("/")
        self.draft = f"{parent}/.{own}.{uuid.uuid4().hex}"
        self.system, self.attempt = None, ""

    def target(self, name: str) -> tuple[_Hashed, str]:
        """A new file in the draft; each attempt of a task writes files of its own, of which commit() takes those told of."""
        if name in ("", ".", "..") or "/" in name or "\\" in name:
            raise ValueError(f"unsafe file name: {name!r}")
        if self.system is None:
            self.system, draft = opened(self.draft)
            self.attempt = f"{draft}/{uuid.uuid4().hex}"
            self.system.create_dir(self.attempt, recursive=True)
        return _Hashed(self.system.open_output_stream(f"{self.attempt}/{name}")), f"{self.attempt}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (file, content), the pieces of a file one after the other."""
        files, name, out, place = [], None, None, ""
        for batch in iterator:
            for own, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                if own != name:
                    if out is not None:
                        files.append(self.ended(out, place))
                    name = own
                    out, place = self.target(own)
                out.write(data or b"")
        if out is not None:
            files.append(self.ended(out, place))
        return Written(files)

    @staticmethod
    def ended(out: _Hashed, place: str) -> tuple[str, int, str]:
        out.close()
        return place, out.size, out.sha.hexdigest()

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [place.rpartition("/")[2] for place, _, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a file's pieces were in several tasks")
        system, draft = opened(self.draft)
        _, final = opened(self.path)
        system.create_dir(f"{draft}/whole", recursive=True)
        for place, _, _ in files:
            system.move(place, f"{draft}/whole/{place.rpartition('/')[2]}")
        if head := self.options.get("manifest"):
            listed = [{"name": n, "size": size, "sha256": sha, "kind": "json"} for n, (_, size, sha) in sorted(zip(names, files))]
            with system.open_output_stream(f"{draft}/whole/manifest.json") as out:
                out.write(json.dumps(json.loads(head) | {"members": listed}, ensure_ascii=False, indent=2).encode())
        there = system.get_file_info(final).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"there is something at {self.path} already")
        if there:
            system.move(final, f"{draft}/former")
        system.move(f"{draft}/whole", final)
        system.delete_dir(draft)

    def abort(self, messages: list[Written | None]) -> None:
        system, draft = opened(self.draft)
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_dir(draft)


class ZipWriter(FolderWriter):
    """Rows of finished pieces (file, name, stored, crc, packed, size, content) in the order of each archive's entries."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, now, entry, stream, out, place = [], None, None, None, None, ""

        def end() -> None:
            if entry is not None and not entry[1]:
                stream.put(LAST_BLOCK)

        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("file", "name", "stored", "crc", "packed", "size", "content")]
            for own, name, stored, crc, packed, size, data in zip(*columns):
                if own != now or (name, stored) != entry:
                    if stream is not None:
                        end()
                    if own != now:
                        if stream is not None:
                            stream.close()
                            files.append((place, out.size, out.sha.hexdigest()))
                        out, place = self.target(own)
                        stream, now = ZipStream(out), own
                    entry = (name, stored)
                    stream.begin(name, stored, crc, packed, size)
                stream.put(data or b"")
        if stream is not None:
            end()
            stream.close()
            files.append((place, out.size, out.sha.hexdigest()))
        return Written(files)


class FileFolder(DataSource):
    """df.write.format("file_folder"): rows (file, content) as files of a folder that appears as a whole."""

    @classmethod
    def name(cls) -> str:
        return "file_folder"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), overwrite)


class ZipArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (ZipMembers, FileFolder, ZipArchives):
        spark.dataSource.register(source)


PACKED = "file string, rank long, name string, pos long, stored boolean, crc long, raw long, content binary"


def packed_pieces(pieces: DataFrame) -> DataFrame:
    """pieces (file, rank, name, pos, content as text or bytes, stored) deflated one by one where they are, with their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                data = [x or b"" for x in some.column(5).to_pylist()]
                out = [x if stored else deflated(x) for x, stored in zip(data, some.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array(out, pa.binary())], names=["file", "rank", "name", "pos", "stored", "crc", "raw", "content"])

    return pieces.select("file", F.col("rank").cast("long").alias("rank"), "name", F.col("pos").cast("long").alias("pos"), F.col("stored").cast("boolean").alias("stored"), F.col("content").cast("binary").alias("content")).mapInArrow(run, PACKED)


def _whole_crc(sums: Column) -> Column:
    """The checksum of an entry from (pos, crc, raw) of its pieces, a few numbers for each."""

    @F.udf("long")
    def whole(rows):
        crc = 0
        for r in sorted(rows):
            crc = combined_crc(crc, r[1], r[2])
        return crc

    return whole(sums)


def write_archives(pieces: DataFrame, path: str, mode: str = "error") -> None:
    """Zip archives in a folder at path, from rows (file, rank, name, pos, content, stored): entries in the order of rank and name,
    each of its pieces in the order of pos; stored entries aren't deflated. mode: "error" or "overwrite", for the folder.

    Pieces are deflated in parallel, wherever they are, and written down once; an archive is then one stream of them, a piece
    at a time. Of an entry with very many pieces the checksums of ranges are combined first."""
    spark = pieces.sparkSession
    register(spark)
    packed = kept(packed_pieces(pieces), "zip-pieces")
    entry = ["file", "rank", "name"]
    part = packed.groupBy(*entry, F.floor(F.col("pos") / 4096).alias("range"))
    sums = part.agg(F.collect_list(F.struct("pos", "crc", "raw")).alias("s"), F.sum("raw").alias("raw"), F.sum(F.octet_length("content")).alias("held"), F.first("stored").alias("stored"))
    ranges = sums.select(*entry, "range", _whole_crc(F.col("s")).alias("crc"), "raw", "held", "stored")
    whole = ranges.groupBy(*entry).agg(F.collect_list(F.struct("range", "crc", "raw")).alias("s"), F.sum("raw").alias("size"), F.sum("held").alias("held"), F.first("stored").alias("_stored"))
    whole = whole.select(*entry, _whole_crc(F.col("s")).alias("_crc"), "size", (F.col("held") + F.when(F.col("_stored"), 0).otherwise(len(LAST_BLOCK))).alias("packed"))
    rows = packed.drop("crc", "raw").join(whole, entry).withColumnRenamed("_crc", "crc")
    # by number: so many tasks write, however small the archives are
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "rank", "name", "pos")
    ordered.select("file", "name", "stored", "crc", "packed", "size", "content").write.format("zip_archives").mode("overwrite" if mode == "overwrite" else "append").save(path)


def write_folder(pieces: DataFrame, path: str, mode: str = "error", manifest: dict | None = None) -> None:
    """Files in a folder at path, from rows (file, pos, content), pieces in the order of pos; with a manifest's head also
    manifest.json, which lists them with sizes and SHA-256. A file is one stream; the folder appears as a whole."""
    register(pieces.sparkSession)
    ordered = pieces.select("file", "pos", F.col("content").cast("binary").alias("content")).repartition("file").sortWithinPartitions("file", "pos").select("file", "content")
    writer = ordered.write.format("file_folder").mode("overwrite" if mode == "overwrite" else "append")
    (writer.option("manifest", json.dumps(manifest, ensure_ascii=False)) if manifest is not None else writer).save(path)


def zip_members(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The members of the archives at path: archive, name, part, size, content. Options: members, pattern, content ("false": the
    directories alone), taskBytes, chunkBytes."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("zip_members").option("pushFilters", pushed)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)

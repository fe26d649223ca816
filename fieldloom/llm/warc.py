"""WARC archives of web captures, and the merge of their capture indexes.

Pages become WARC records: a response with its payload, or a revisit that refers to the response with the same payload.
A record is a gzip member of its own, so an index entry's offset is a place to read from. Archives are read back as
streams. Each archive gives a run of captures, sorted by URL key and timestamp; splitters cut all runs into the same key
ranges, and in each range a loser tree merges what the runs have there, so the ranges one after the other are the
globally ordered capture histories.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, pieces, small_batches, shuffle_width, small_side, stage

#: Payloads below this many bytes are always stored as they are.
REVISIT_FROM = 1000
#: An archive ends after so many compressed bytes or records; a longer record has one to itself.
ARCHIVE_BYTES, RECORDS_PER_ARCHIVE = 16 << 20, 20_000
#: Captures in a key range, roughly; one task merges a range.
RANGE_ROWS = 100_000
#: Captures that are looked at for each splitter of key ranges, and in all at least; it only sets how even the ranges are.
SPLITTER_SAMPLE, LEAST_SAMPLE = 20, 20_000
#: Bytes that are compressed, unpacked or hashed at once.
CHUNK = 1 << 18
#: Bytes of a record in one gzip member at most. A member's last byte, the highest of its length, is then 0.
MEMBER_BYTES = (1 << 24) - 1
EPOCH = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def url_key(url: str | None) -> str:
    """The URL's sort key: host parts reversed, then path and query in lower case, without scheme, 'www', port 80/443 or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


class LoserTree:
    """Merges sorted sequences: inner nodes hold the losers of the matches below them, so the next item costs one path of matches."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:  # still building: wait here for the opponent
                self.losers[node] = i
                return
            if self._before(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while (head := self.heads[i := self.losers[0]]) is not None:
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def record_table(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, digest, size, kind and refers_to for each page: which pages are responses and which revisits.

    Of equal payloads of at least revisit_from bytes the largest page_id is the response. Groups are made from digests and
    ids alone, and digests meet ids only; payloads are joined with the revisits by page, so a hot payload is no key."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    place = F.xxhash64("url").alias("at")
    large = stage(rows.where(F.col("size") >= revisit_from).select("page_id", place, "digest"), "payload-digests")
    groups = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1").select("digest", "refers_to")
    revisits = large.join(stage(groups, "payload-groups").hint("merge"), "digest").where("refers_to IS NOT NULL AND NOT page_id <=> refers_to")
    revisits = stage(revisits.select(F.col("page_id").alias("_id"), "at", F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (place == F.col("at")) & (F.col("digest") == F.col("_digest"))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return rows.join(small_side(revisits), same, "left").select("page_id", "url", "html", "digest", "size", kind.alias("kind"), "refers_to")


def _uri(url: Column) -> Column:
    """A URL that fits in a header line: white space and controls are percent-encoded."""
    safe = F.coalesce(url, F.lit(""))
    for c in (" ", "\t", "\r", "\n"):
        safe = F.replace(safe, F.lit(c), F.lit(quote(c)))
    return safe


def gzip_members(record: bytes) -> bytes:
    """A record as gzip members: one, or several of MEMBER_BYTES if it is longer."""
    out, view = [], memoryview(record)
    for at in range(0, max(1, len(view)), MEMBER_BYTES):
        pack = zlib.compressobj(5, zlib.DEFLATED, 31)
        part = view[at : at + MEMBER_BYTES]
        out += [pack.compress(part[i : i + CHUNK]) for i in range(0, len(part), CHUNK)]
        out.append(pack.flush())
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a WARC/1.1 record per page into gzip archives under path. The capture time is EPOCH plus page_id seconds.

    An archive is a row, and a row a file, of Spark's text writer, which takes any bytes and only must end a row with
    something: that is the 0 in which each member ends."""
    rows = record_table(pages)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    date = F.date_format(F.timestamp_seconds(F.lit(int(datetime.datetime.fromisoformat(EPOCH).timestamp())) + F.coalesce(F.col("page_id"), F.lit(0)) % (1 << 31)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("kind") == "revisit"
    block = F.when(revisit, "").otherwise(F.col("html"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "kind"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), number("refers_to"), F.lit(">"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block, F.lit(CRLF * 2)).cast("binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["archive"])
        for batch in pieces(batches):
            for one in batch.column(0):
                held.append(gzip_members(one.as_py()))
                size += len(held[-1])
                if size >= archive_bytes or len(held) >= RECORDS_PER_ARCHIVE:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    archives = small_batches(rows).select(record.alias("record")).mapInArrow(pack, "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def members(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """The bytes of gzip members from a place on, in chunks, each with the place where its member starts."""
    view = memoryview(data)
    while at < len(view):
        unpack, start, part = zlib.decompressobj(31), at, b""
        while not unpack.eof:
            if not part:
                part = view[at : at + CHUNK]
                at += len(part)
            ended = not part
            chunk = unpack.decompress(part, CHUNK)
            part = unpack.unconsumed_tail
            if chunk:
                yield start, chunk
            elif ended and not unpack.eof:
                raise ValueError(f"the member at byte {start} is cut off")
        at -= len(unpack.unused_data)


def records(chunks: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, dict[str, str], Iterator[bytes]]]:
    """(offset, headers, block in chunks) of each record in a stream of members; a block must be read before the next record."""
    chunks, held, offset = iter(chunks), b"", 0

    def more() -> bool:
        nonlocal held, offset
        found = next(chunks, None)
        if found is not None:
            offset = offset if held else found[0]
            held += found[1]
        return found is not None

    def block(size: int) -> Iterator[bytes]:
        nonlocal held
        while size:
            if not held and not more():
                raise ValueError("a block is cut off")
            part, held = held[:size], held[size:]
            size -= len(part)
            yield part

    while held or more():
        if not held:
            continue
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError(f"no end of the headers of the record at byte {offset}")
        start, head, held = offset, held[:end], held[end + 4 :]
        version, *lines = head.decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {start}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        yield start, headers, block(int(headers["Content-Length"]))
        if b"".join(block(4)) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {start} doesn't end where it says")


def payload_at(archive: bytes, offset: int) -> bytes:
    """The payload of the record to which an index entry's offset points; nothing before it is read."""
    return b"".join(next(records(members(archive, offset)))[2])


CAPTURE = "url_key string, timestamp string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long"
CAPTURE_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Reads the archives under path; of each a run of captures, sorted by URL key, timestamp and page, with nth, the place in it.

    A response's digest and length are of the payload that was read; a digest that differs from the header is an error."""
    number = lambda text: None if (found := text.rpartition(":")[2].rstrip(">")) == "none" else int(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for name, content in zip(batch.column(0), batch.column(1)):
                archive, found = name.as_py().rpartition("/")[2], []
                for offset, h, block in records(members(content.as_py())):
                    seen, length = hashlib.sha1(), 0
                    for part in block:
                        seen.update(part)
                        length += len(part)
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (seen.hexdigest() != digest or length != size):
                        raise ValueError(f"damaged record at byte {offset} of {archive}")
                    refers = number(h["WARC-Refers-To"]) if h["WARC-Type"] == "revisit" else None
                    found.append((url_key(h["WARC-Target-URI"]), re.sub(r"\D", "", h["WARC-Date"]), number(h["WARC-Record-ID"]), h["WARC-Type"], digest, size, refers, archive, offset))
                found.sort(key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[8]))
                columns = [pa.array([r[i] for r in found], f.type) for i, f in enumerate(ARROW_CAPTURE)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(found)), pa.int64())], names=[*CAPTURE_NAMES, "nth"])

    # a partition of files has some maxPartitionBytes, and so has a batch; archives are unpacked one at a time, as streams
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"{CAPTURE}, nth long")


ARROW_CAPTURE = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[f.split()[1]]) for n, f in zip(CAPTURE_NAMES, CAPTURE.split(", "))])


def merge_captures(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures with range, place and position: by position they are in order of URL key, timestamp and page.

    captures is a table of sorted runs, named by archive, as from read_captures(). Splitters are whole keys with timestamp
    and page, so the captures of one URL may be spread over many ranges. What the runs have in a range meets in one task
    and is merged by a loser tree. Equal captures keep one order, by archive and offset."""
    spark = captures.sparkSession
    count = captures.count()
    ranges = ranges or max(shuffle_width(spark), -(-count // RANGE_ROWS))
    order = ["url_key", "timestamp", "page_id", "archive", "offset"]
    sample = captures.select(*order).sample(min(1.0, max(LEAST_SAMPLE, SPLITTER_SAMPLE * ranges) / max(1, count)), seed=7).collect() if count else []
    keys = sorted((r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id, r.archive, r.offset) for r in sample)
    splitters = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    def keys_of(table: pa.Table | pa.RecordBatch) -> list[tuple]:
        a, b, c, d, e = (table.column(n).to_pylist() for n in order)
        return list(zip(a, b, [-1 if x is None else x for x in c], d, e))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.append_column("range", pa.array([bisect_right(splitters, k) for k in keys_of(batch)], pa.int32()))

    def merge(group: pa.Table) -> pa.Table:
        number = group.column("range")[0].as_py()
        group = group.sort_by([("archive", "ascending"), ("nth", "ascending")]).combine_chunks()
        found, archive = keys_of(group), group.column("archive").to_numpy()
        starts = [0, *(np.flatnonzero(archive[1:] != archive[:-1]) + 1).tolist(), len(archive)]
        merged = [i for _, i in LoserTree([zip(found[a:b], range(a, b)) for a, b in zip(starts, starts[1:])])]
        out = group.take(pa.array(merged, pa.int64())).select(CAPTURE_NAMES)
        return out.append_column("range", pa.array([number] * len(merged), pa.int32())).append_column("place", pa.array(range(len(merged)), pa.int64()))

    dealt = captures.mapInArrow(cut, f"{CAPTURE}, nth long, range int")
    merged = stage(dealt.repartitionById(ranges, "range").groupBy("range").applyInArrow(merge, f"{CAPTURE}, range int, place long"), "merged")
    counts = merged.groupBy("range").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("range", (F.sum("_n").over(Window.orderBy("range")) - F.col("_n")).alias("_before"))
    return merged.join(small_side(stage(before, "ranges")), "range").withColumn("position", F.col("_before") + F.col("place")).drop("_before")


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes an archive of the pages, reads it back and returns the merged index, a row per page.

    pages has page_id, url and html; other columns are ignored. A null html is an empty payload; a null url has the
    empty key; rows that repeat a page_id get a record each (of equal payloads those with the largest id stay
    responses); pages without an id are never referred to. Payloads of any length are compressed, unpacked and hashed
    in chunks. No pages give no rows."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return merge_captures(stage(read_captures(pages.sparkSession, path), "captures"))


WARC_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_replace(url, '#.*$', '')) AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, regexp_extract(url, '^[a-z]+://(?:www\d*\.)?([^/:?]+)', 1) AS host,
             regexp_extract(url, '^[a-z]+://[^/?]+(.*)$', 1) AS rest, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM p),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS url_key,
             CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, url_key, timestamp, row_number() OVER (ORDER BY url_key, timestamp, page_id) - 1 AS position FROM k
"""

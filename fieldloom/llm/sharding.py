"""Sharding by histogram sort.

Rows are ordered by a key: a hash of the text, then one of the id, then one of the row's number in a written table. So equal
texts stand together, and a group too large for one shard can still be cut, even where rows repeat an id too. Bytes below candidate boundaries are counted over all partitions; where no
boundary is near enough to a wanted quantile, the cell that holds the quantile is divided further and counted again.
When all splitters meet the tolerance, rows are exchanged once.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: A key has two halves of HALF bits. The first round of counting looks at FIRST bits, each later one at MORE bits of the
#: cells in which quantiles are still open: 2**MORE sums for each reach the driver.
HALF, FIRST, MORE = 60, 12, 4
#: Bits of the second half that the row's number decides; the ones before them are the id's.
ROW_BITS = 24
#: Rows in a range, roughly: a shard is made of ranges, so that no task numbers a whole shard. At least LEAST_RANGES to a shard.
ROWS_PER_RANGE, LEAST_RANGES = 500_000, 8

Key = tuple[int, int]


def _prefix(bits: int) -> list[Column]:
    """The key's leading bits, as two columns."""
    if bits <= HALF:
        return [F.shiftright("hi", HALF - bits).alias("a"), F.lit(0).cast("long").alias("b")]
    return [F.col("hi").alias("a"), F.shiftright("lo", 2 * HALF - bits).alias("b")]


def _number(a: int, b: int, bits: int) -> int:
    return a if bits <= HALF else (a << (bits - HALF)) | b


def _parts(number: int, bits: int) -> tuple[int, int]:
    return (number, 0) if bits <= HALF else (number >> (bits - HALF), number & ((1 << (bits - HALF)) - 1))


def find_splitters(rows: DataFrame, measure: str, wanted: list[float], tolerance: list[float], counted: list[int] | None = None) -> list[Key]:
    """For each wanted sum of the measure, ascending, a key below which the rows have that much, within its tolerance or as
    near as whole rows allow.

    rows has hi and lo. Only the sums of cells reach the driver: 2**FIRST at first, then 2**MORE for each open quantile;
    counted, if given, gets their number in each round."""
    found: dict[int, Key] = {}
    open_cells: dict[int, tuple[float, list[int]]] = {0: (0.0, list(range(len(wanted))))}
    bits = 0
    while open_cells:
        here, before, bits = rows, bits, bits + (MORE if bits else FIRST)
        if before:
            cells = rows.sparkSession.createDataFrame([_parts(c, before) for c in open_cells], "a long, b long")
            a, b = _prefix(before)
            here = rows.withColumns({"a": a, "b": b}).join(F.broadcast(cells), ["a", "b"], "left_semi").select("hi", "lo", measure)  # a row for each open quantile at most
        sums: dict[int, list[tuple[int, int]]] = {}
        collected = here.groupBy(*_prefix(bits)).agg(F.sum(measure).alias("m")).collect()
        if counted is not None:
            counted.append(len(collected))
        for r in collected:
            number = _number(r.a, r.b, bits)
            sums.setdefault(number >> (bits - before), []).append((number, r.m))
        following: dict[int, tuple[float, list[int]]] = {}
        for cell, (below, quantiles) in open_cells.items():
            own = sorted(sums.get(cell, []))
            edges = [below]
            for _, m in own:
                edges.append(edges[-1] + m)
            for q in quantiles:
                i = min(max(bisect.bisect_right(edges, wanted[q]) - 1, 0), len(edges) - 1)
                near = min((k for k in (i, i + 1) if k < len(edges)), key=lambda k: abs(edges[k] - wanted[q]))
                if abs(edges[near] - wanted[q]) <= tolerance[q] or bits == 2 * HALF or i >= len(own):
                    start = own[near][0] if near < len(own) else own[-1][0] + 1 if own else cell << (bits - before)
                    start <<= 2 * HALF - bits
                    found[q] = start >> HALF, start & ((1 << HALF) - 1)
                else:
                    following.setdefault(own[i][0], (edges[i], []))[1].append(q)
        open_cells = following
    return [found[q] for q in range(len(wanted))]


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null under this law).

    size is the text's UTF-8 bytes plus 8 (null text: 8). Shards have near equal sums of sizes: off by `tolerance` of a
    shard or by one row at each end. Slots count from 0 in each shard without gaps. Equal texts are neighbours: their
    group is cut only where it reaches over the place of a wanted boundary by more than the tolerance on both sides, so a
    group of less than twice the tolerance is never cut. Rows that repeat an id and a text are cut apart like others, by their
    numbers; null ids are ordered like an id; no rows give no rows. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    hashed = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - HALF)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the numbers are those of one write: what is read back has them for good
    of_row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)
    lo = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - HALF + ROW_BITS), ROW_BITS) + of_row
    rows = stage(docs.select(F.col(id_col).alias("_id"), hashed(text).alias("hi"), lo.alias("lo"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("one")), "shard-keys")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    # shards by bytes; then, so that many small rows make no large task, ranges within them by rows
    step = (total or 0) / shards
    borders = sorted(find_splitters(rows, "size", [step * i for i in range(1, shards)], [tolerance * step] * (shards - 1))) if total else []
    ranges = max(LEAST_RANGES * shards, -(-count // ROWS_PER_RANGE))
    step = count / ranges
    splitters = sorted({*borders, *(find_splitters(rows, "one", [step * i for i in range(1, ranges)], [step / 4] * (ranges - 1)) if total else [])})
    shard_of = [bisect.bisect_right(borders, s) for s in [(-1, -1), *splitters]]

    # the range of a row: ranges that start before its first cell, and splitters within the cell; a row for each cell
    firsts = [s[0] >> (HALF - FIRST) for s in splitters]
    cells = [(c, bisect.bisect_left(firsts, c), splitters[bisect.bisect_left(firsts, c) : bisect.bisect_right(firsts, c)]) for c in range(1 << FIRST)]
    cells = spark.createDataFrame(cells, "cell long, base int, inner array<struct<hi: long, lo: long>>")
    below = F.size(F.filter("inner", lambda s: s <= F.struct("hi", "lo")))
    dealt = rows.withColumn("cell", F.shiftright("hi", HALF - FIRST)).join(F.broadcast(cells), "cell").withColumn("range", F.col("base") + below).drop("cell", "base", "inner")
    counts = {r.range: r.n for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row for each range
    filled, offsets = [0] * shards, []
    for r, own in enumerate(shard_of):
        offsets.append((r, own, filled[own]))
        filled[own] += counts.get(r, 0)
    offsets = spark.createDataFrame(offsets, "range int, shard int, before long")
    slot = F.row_number().over(Window.partitionBy("range").orderBy("hi", "lo", "_id")) - 1 + F.col("before")
    return dealt.join(F.broadcast(offsets), "range").select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

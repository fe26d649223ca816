"""Mixing sources to target weights by systematic sampling.

Targets are a water level: each source's share of the wanted words by weight, stopped at a multiple of its size, with
the excess shared again among the rest. Within a source the documents stand in one order, stratified by size; each has
the same expected number of copies, target / size of the source. The prefix sum of those expectations plus one random
offset runs along the order, and a document is emitted once for each integer that its step crosses.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, drop_staged, identified, lookup_side, shuffle_width, stage, staging

#: Rows that one stratum of a source holds at most, roughly: more hash digits make more strata.
ROWS_PER_STRATUM = 1 << 20


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `number`: its rows' places by key, nulls last, from 0; no task holds more than a range of the rows."""
    order = F.col(key).asc_nulls_last()
    ranged = stage(df.repartitionByRange(shuffle_width(df.sparkSession), order).withColumn("_part", F.spark_partition_id()), name)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + place - 1).drop("_part", "_before")


def water_level(sources: DataFrame, wanted: float, cap: float) -> float:
    """The level at which sum(least(cap * source_size, level * weight)) is `wanted`; two sums a round come to the driver."""
    level = 0.0
    full = F.col("source_size") * F.lit(cap) < F.lit(0.0)
    while True:
        stopped, weight = sources.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not weight:
            return math.inf if stopped is not None else 0.0
        found = (wanted - cap * stopped) / weight
        if found == level:
            return level
        level = found
        full = F.col("source_size") * F.lit(cap) < F.lit(level) * F.col("weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id_col, source_col, size, source_size, target, copies, taken (copies * size) and the columns of carry.

    Sizes are words (null text: 0). Sources in code-point order, null last and a source of its own, get the weights in
    turn; together they are to yield share * all words; a target stops at cap * the source's size. copies is between
    0 and ceil(cap). The same rows give the same result, however they are partitioned; the seed gives each source its
    offset. Repeated rows and ids are rows of their own; a null id is an id like any other; a source without words has
    target 0; no rows give no rows. Rows of one size and id stand in the order of carry. Other columns are neither read
    nor returned.
    """
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("v"), source_col))
    # of id and text, so that neither a repeated id nor a repeated text is one stratum
    digest = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit(""))).cast("binary")), 1, 8)
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), key.alias("_key"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("_digest"), *carry)
    sized = stage(sized, "mix-sizes")
    totals = sized.agg(F.sum("size"), F.count("*")).first()
    digits = max(2, math.ceil(math.log(max(1, totals[1] / ROWS_PER_STRATUM), 16)))

    sources = numbered(sized.groupBy("_source", "_key").agg(F.sum("size").alias("source_size")), "_source", "mix-sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = stage(sources.select("_key", "source_size", turn.alias("weight")), "mix-weights")
    level = water_level(sources, share * (totals[0] or 0), cap)
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(level))
    # the offset: 20 bits, so that adding it to a place is exact
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "_key")), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    sources = sources.select("_key", "source_size", target.alias("target"), offset.alias("_offset"))

    # strata: the size's leading bits, then hash digits; a source is never in one task
    length = F.length(F.bin("size"))
    sized = sized.withColumns({"_class": length * 8 + F.expr("shiftright(size * 8, length(bin(size)) - 1) & 7"), "_hash": F.substring("_digest", 1, digits)})
    stratum = ["_key", "_class", "_hash"]
    counts = sized.groupBy(stratum).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_class", "_hash")) - F.col("_n"))
    before = before.join(sources, "_key").drop("_n")
    placed = sized.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy("size", "_id", *carry))).join(before, stratum)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda place: F.floor(F.col("_offset") + place * rate)
    place = F.col("_before") + F.col("_place")
    copies = (upto(place) - upto(place - 1)).cast("long")
    return placed.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", at_rest: bool = False, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes it, also where ids repeat or are null. at_rest: docs is read
    from Parquet files as they are (see identified())."""
    spark = docs.sparkSession
    rows = identified(docs, "mix", at_rest)
    with staging() as own:
        taken = mix(rows.withColumn("_text", F.xxhash64(text_col)), id_col=id_col, text_col=text_col, source_col=source_col, carry=("_text", "_row"), **options)
        taken = stage(taken.where("copies > 0").select("_row", F.col("copies").alias("_copies")), "mix-copies")
        drop_staged(spark, set(own) - {taken.staged_at})
    rows = rows.join(lookup_side(taken), "_row")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT a.source_size * 2.0::DOUBLE / a.weight AS ratio,
             (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM w) - 2.0::DOUBLE * coalesce(sum(b.source_size) FILTER (b.source_size * 2.0::DOUBLE / b.weight < a.source_size * 2.0::DOUBLE / a.weight), 0)::BIGINT)
             / sum(b.weight) FILTER (b.source_size * 2.0::DOUBLE / b.weight >= a.source_size * 2.0::DOUBLE / a.weight) AS level
      FROM w a, w b GROUP BY a.source, a.source_size, a.weight),
t AS (SELECT w.*, least(source_size * 2.0::DOUBLE, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1)) AS target,
             ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM w),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.u,
             row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * 8 + (((d.size * 8) >> (length(bin(d.size)) - 1)) & 7), substr(d.digest, 1, 2), d.size, d.doc_id) AS i
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (floor(u + i * (target / source_size)) - floor(u + (i - 1) * (target / source_size)))::BIGINT AS copies, copies * size AS taken FROM p
"""

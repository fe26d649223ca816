"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of fixed size. The distinct blocks are sorted and named by integers; then pairs of
adjacent names are sorted and named, again and again, until each document is one name. Equal names at one level mean
equal content, so documents are equal exactly if they end with the same name at the same level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, drop_staged, stage, staging

BLOCK_BYTES = 4096


def _named(keys: DataFrame, by: list[str], keep: list[str], name: str) -> DataFrame:
    """Distinct keys, sorted, with an integer name each: the partition's number in the high bits, the rank in it below.

    The distinct rows are dealt by their keys, so a key is in one partition and gets one name."""
    distinct = keys.groupBy(by).agg(F.count("*").alias("_copies")).sortWithinPartitions(by)
    return stage(distinct.select(*keep, F.monotonically_increasing_id().alias("name")), name)


def document_names(docs: DataFrame, text: Column, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64) -> DataFrame:
    """Per row: row_id, id_col, text_sha256, and (level, name), equal for equal normalised texts only; staged.

    Rows carry hashes of their blocks in place of the blocks when names are given back. A hash that two different
    blocks share shows in the table of names; then the blocks themselves are joined.
    """
    cut = docs.select(F.col(id_col).alias("_id"), F.coalesce(text, F.lit("")).cast("binary").alias("_text"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / block_bytes).cast("int"))
    cut = cut.withColumns({"n": count, "_row": F.monotonically_increasing_id()})
    block = F.substring(F.col("_text"), F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    cut = cut.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    blocks = cut.select("_row", "_id", "n", "pos", block.alias("block"), F.when(F.col("pos") == 0, F.sha2("_text", 256)).alias("sha"))
    blocks = blocks.withColumn("hash", hash_of(F.col("block")))

    names = _named(blocks.select("hash", "block"), ["hash", "block"], ["hash"], "block-names")
    on = ["hash"]
    if names.groupBy("hash").count().where("count > 1").limit(1).count():  # different blocks share a hash: join by content
        on = ["hash", "block"]
        names = _named(blocks.select("hash", "block"), on, on, "block-names-exact")
    placed = stage(blocks.select("_row", "_id", "n", "pos", "sha", *on), "block-places")
    now = placed.join(names, on).select("_row", "_id", "n", "pos", "sha", "name")
    level, done = 0, None
    while True:
        now = stage(now, "names")
        ended = now.where("n = 1").select("_row", "_id", "sha", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        rest = now.where("n > 1")
        if not rest.limit(1).count():
            break
        half = lambda side, col: F.max(F.when(F.col("pos") % 2 == side, F.col(col)))
        pairs = rest.groupBy("_row", (F.floor(F.col("pos") / 2)).cast("int").alias("pos")).agg(
            F.first("_id").alias("_id"), F.first("n").alias("n"), half(0, "sha").alias("sha"), half(0, "name").alias("left"), F.coalesce(half(1, "name"), F.lit(-1)).alias("right")
        )
        pairs = stage(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), "pairs")
        names = _named(pairs.select("left", "right"), ["left", "right"], ["left", "right"], "pair-names")
        now = pairs.join(names, ["left", "right"]).select("_row", "_id", "n", "pos", "sha", "name")
        level += 1
    return done.select(F.col("_row").alias("row_id"), F.col("_id").alias(id_col), F.col("sha").alias("text_sha256"), "level", "name")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id_col, keep_id (the largest id among the rows of equal texts), group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Rows that repeat an id count each,
    and one of them is kept. A null id is smaller than any other; a group of null ids only keeps one of its rows, with
    a null keep_id. No rows give no rows; other columns are neither read nor returned.
    """
    named = document_names(docs, ascii_lower(F.col(text_col)), id_col, block_bytes)
    row = F.struct(F.col(id_col), F.col("row_id"))
    groups = stage(named.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(row).alias("keep")), "groups")
    joined = named.join(groups, ["level", "name"])
    return joined.select(id_col, F.col(f"keep.{id_col}").alias("keep_id"), "group_size", (F.col("keep.row_id") == F.col("row_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that deduplicate() keeps.

    Where ids are unique, rows are dropped by id alone. Otherwise id and normalised text decide, and of rows that
    repeat both one stays."""
    with staging() as own:
        found = stage(deduplicate(docs, id_col, text_col), "dedup")
        drop_staged(docs.sparkSession, set(own) - {found.staged_at})
    same_id = lambda a, b: a[id_col].eqNullSafe(b[id_col])
    if not found.groupBy(id_col).count().where("count > 1").limit(1).count():
        gone = found.where("NOT kept").select(id_col)
        return docs.join(gone, same_id(docs, gone), "left_anti")
    gone = found.groupBy(id_col, "text_sha256").agg(F.max("kept").alias("kept")).where("NOT kept").select(id_col, F.col("text_sha256").alias("_sha"))
    rows = docs.withColumn("_sha", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    rows = rows.join(gone, same_id(rows, gone) & (rows["_sha"] == gone["_sha"]), "left_anti")
    return rows.dropDuplicates([id_col, "_sha"]).drop("_sha")


EXACT_DEDUP_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t
"""

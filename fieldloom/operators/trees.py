"""Trees as tables, and lists of nodes as relations over them.

A tree table has a row for each node: doc_id, node_id in document order (0 is the root), last_id (the last node below it),
parent_id and depth. What is below a node is the range node_id + 1 .. last_id. There are two ways to join by such ranges,
both without a range condition:

* Where only sets matter, one window does. Going through a document's nodes in order, the largest last_id of the contexts
  passed so far says whether a node lies below one of them; contexts within contexts add nothing. Backwards, the nearest
  node found so far says whether there is one below.
* Where each context has a list of its own, ranges are cut into dyadic blocks: level k has blocks of 2^k numbers, a range is
  O(log n) of them, none within another, and a number is in one block of each level. So a containment is one equality of
  (doc_id, level, block), which also spreads a large document over tasks.

A list relation has doc_id, place (0, 1, ... in each document) and node_id. A step replaces each node by a list of its own
and strings these together in the order of the places, so a node may be there several times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indexes import Indexes, Span


def _bits(count: Column) -> Column:
    """The largest k with 2^k <= count; 0 for less than 1."""
    return F.length(F.bin(F.greatest(count.cast("long"), F.lit(1)))) - 1


def _block_range(level: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """The first and last block of a level that lie wholly between two numbers (the first is larger if there is none)."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    return F.ceil(first.cast("double") / width).cast("long"), F.floor((last + 1).cast("double") / width).cast("long") - 1


def covering_blocks(first: Column, last: Column) -> Column:
    """array<struct<level, block>>: the dyadic blocks that make up first .. last, largest possible; empty if last < first."""

    def of_level(level: Column) -> Column:
        lo, hi = _block_range(level, first, last)
        up_lo, up_hi = _block_range(level + 1, first, last)
        alone = lambda block: (F.shiftright(block, 1) < up_lo) | (F.shiftright(block, 1) > up_hi)
        block = lambda at: F.struct(level.cast("int").alias("level"), at.alias("block"))
        left, right = F.when((lo <= hi) & alone(lo), block(lo)), F.when((lo < hi) & alone(hi), block(hi))
        return F.filter(F.array(left, right), lambda b: b.isNotNull())

    # no block is wider than the range, so its length bounds the levels
    levels = F.sequence(F.lit(0), _bits(last - first + 1))
    return F.when(last < first, F.array().cast("array<struct<level:int,block:bigint>>")).otherwise(F.flatten(F.transform(levels, of_level)))


def blocks_of(number: Column, last: Column) -> Column:
    """array<struct<level, block>>: the block of each level that a number is in, up to a document's last number."""
    levels = F.sequence(F.lit(0), _bits(last + 1))
    return F.transform(levels, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", number.cast("long"), k).alias("block")))


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a tree for a join that deals both sides by key. By the size of its files, a few MB in packed columns, Spark takes
    a written tree for something to broadcast, and what is exploded from it too; as rows it is many times that, and each
    such join would put it together in the driver."""
    return rows.hint("merge")


def pairs_below(contexts: DataFrame, nodes: DataFrame, keep: Sequence[str], own: bool = False) -> DataFrame:
    """A row for each context and each of `nodes` below it (own: or the context itself): the contexts' columns `keep`, and
    doc_id and node_id of the node. Contexts have node_id and last_id; nodes have node_id and doc_last, their document's last
    number."""
    first = F.col("node_id").cast("long") + (0 if own else 1)
    left = contexts.select("doc_id", *keep, F.inline(covering_blocks(first, F.col("last_id").cast("long"))).alias("level", "block"))
    right = nodes.select("doc_id", "node_id", F.inline(blocks_of(F.col("node_id"), F.col("doc_last"))).alias("level", "block"))
    left = left.select(F.col("doc_id").alias("_d"), F.col("level").alias("_l"), F.col("block").alias("_b"), *keep)
    return left.join(dealt(right), (F.col("_d") == F.col("doc_id")) & (F.col("_l") == F.col("level")) & (F.col("_b") == F.col("block"))).select("doc_id", *keep, "node_id")


def _marked(nodes: DataFrame, others: DataFrame, columns: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """nodes with others among them as rows of their own, told apart by _is (0: a node, 1: another)."""
    names = [c for c in nodes.columns]
    both = nodes.withColumn("_is", F.lit(0)).unionByName(others.select("doc_id", "node_id", *by, *columns).withColumn("_is", F.lit(1)), allowMissingColumns=True)
    return both.select(*names, *[c for c in both.columns if c not in names and c != "_is"], "_is")


def below_any(nodes: DataFrame, contexts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of nodes that lie below at least one context of their document, and of their group if `by` names columns, each
    as often as in nodes."""
    both = _marked(nodes, contexts, [F.col("last_id").alias("_reach")], by)
    # at one number contexts come last: a node isn't below itself
    reach = F.max("_reach").over(Window.partitionBy("doc_id", *by).orderBy("node_id", "_is").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("_far", reach).where((F.col("_is") == 0) & (F.col("_far") >= F.col("node_id"))).select(*nodes.columns)


def has_below(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """The rows of nodes that have at least one of inner below them."""
    both = _marked(nodes, inner, [F.col("node_id").alias("_at")])
    # backwards, so that the nearest later one is the last that was passed; a node's own number comes after it
    nearest = F.min("_at").over(Window.partitionBy("doc_id").orderBy(F.desc("node_id"), "_is").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("_near", nearest).where((F.col("_is") == 0) & (F.col("_near") <= F.col("last_id"))).select(*nodes.columns)


def outermost(contexts: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Contexts without those that lie below another one of the same group; what is below the rest is below once."""
    reach = F.max("last_id").over(Window.partitionBy(*by).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    return contexts.withColumn("_far", reach).where(F.col("_far").isNull() | (F.col("_far") < F.col("node_id"))).drop("_far")


def span_order(span: Span, k: Column, n: Column) -> Column:
    """For place k of a list of n: where the span's walk meets it (ascending), or null if it doesn't. As Span.places()."""
    at = lambda x, otherwise: otherwise if x is None else F.lit(x) if x >= 0 else F.when(n >= -x, n + x).otherwise(F.lit(x))
    first, last = at(span.first, F.lit(0)), at(span.last, n - 1)
    inside = lambda x: F.least(F.greatest(x, F.lit(0)), n - 1)
    start, stop = inside(first), inside(last)
    stride = F.lit(span.step) if span.step > 0 else F.greatest(F.lit(1), n + span.step)
    beyond = (F.greatest(first, last) < 0) | (F.least(first, last) >= n)
    met = (n > 0) & ~beyond & (k >= F.least(start, stop)) & (k <= F.greatest(start, stop)) & (F.pmod(k - start, stride) == 0)
    return F.when(met, F.when(start <= stop, k).otherwise(-k))


def pick_order(indexes: Indexes, k: Column, n: Column) -> Column:
    """For place k of a list of n: struct(span, order in it) by which the picked places are sorted, null for the others."""
    orders = [span_order(s, k, n) for s in indexes.spans]
    if indexes.exclude:
        return F.when(F.coalesce(*orders).isNull(), F.struct(F.lit(0).alias("span"), k.cast("long").alias("at")))
    return F.coalesce(*[F.when(o.isNotNull(), F.struct(F.lit(i).alias("span"), o.cast("long").alias("at"))) for i, o in enumerate(orders)])


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """A list relation of rows with doc_id and node_id: places by the given order."""
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).alias("place"), "node_id")


def picked(found: DataFrame, indexes: Indexes | None) -> DataFrame:
    """found (doc_id, place of the context, node_id) as a list relation: each context's nodes in document order, or those that
    the indexes name, in theirs."""
    if indexes is None:
        return numbered(found, "place", "node_id")
    own = Window.partitionBy("doc_id", "place")
    ranked = found.withColumn("_k", F.row_number().over(own.orderBy("node_id")) - 1).withColumn("_n", F.count("*").over(own))
    chosen = ranked.withColumn("_o", pick_order(indexes, F.col("_k"), F.col("_n"))).where(F.col("_o").isNotNull())
    return numbered(chosen, "place", "_o")


def values_in_order(rows: DataFrame, value: Column, by: str = "place") -> DataFrame:
    """doc_id and values (array<string>), from a row for each value, without empty ones."""
    kept = rows.select("doc_id", F.struct(F.col(by).alias("at"), value.alias("value")).alias("_v")).where("_v.value <> ''")
    return kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("_v")), lambda v: v["value"]).alias("values"))

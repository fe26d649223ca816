"""JSON as a table of nodes, made in the JVM, and JSON paths as joins and windows over it.

parse_json makes a variant of each document, and variant_explode takes it apart level by level, each level a written table:
as many jobs as documents are deep. Nodes are then numbered in document order, members of objects by key, and know the last
node below them, as in trees.py. A path is a list relation that each step replaces: names and indexes are joins with the
children, slices are tests of place and size, recursion a join by dyadic blocks, filters joins with the values of
their operands.

Columns: doc_id, node_id (0 is the document), last_id, doc_last, parent_id (-1 above the document), depth, key (in an
object), pos (in an array or object) and of (how many are there), kind (object, array, string, number, boolean or null),
value (as text: containers as compact JSON with sorted keys, null as nothing).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import RuleError
from ..plans.lexer import split_plain
from .jsonpath import Step, _unquote, parse, text_of
from .staging import kept
from .trees import dealt, pairs_below, values_in_order


def _kind(v: Column) -> Column:
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def _text(v: Column) -> Column:
    """A variant as text. A whole number that was written with a point keeps one: it is a decimal without places, while whole
    numbers as such are integers up to 18 digits."""
    name = F.schema_of_variant(v)
    pointed = name.rlike(r"^DECIMAL\((1[0-8]|[1-9]),0\)$")
    plain = v.cast("string")
    return F.when(name == "VOID", "").when(pointed, F.concat(plain, F.lit(".0"))).otherwise(plain)


def _level(rows: DataFrame) -> DataFrame:
    """What is kept of a level's nodes; containers keep their variant for the next."""
    kind = _kind(F.col("v"))
    return rows.select("doc_id", "path", "key", kind.alias("kind"), _text(F.col("v")).alias("value"), F.when(kind.isin("object", "array"), F.col("v")).alias("v"))


def shred_json(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """A row for each value of each document, under doc_id; null documents and those that aren't JSON have none (nor has one with
    a key twice in an object). Ids must be distinct. The table is a written one."""
    spark = df.sparkSession
    root = df.select(F.col(id_col).alias("doc_id"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(F.col(col)).alias("v")).where("v IS NOT NULL")
    levels = [kept(_level(root), "json-level")]
    while True:
        inner = levels[-1].where("v IS NOT NULL").select("doc_id", "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = kept(_level(inner.select("doc_id", F.concat("path", F.array("pos")).alias("path"), "key", F.col("value").alias("v"))), "json-level")
        if level.isEmpty():
            break
        levels.append(level)
    every = levels[0].drop("v")
    for level in levels[1:]:
        every = every.unionByName(level.drop("v"))
    own = Window.partitionBy("doc_id")
    ordered = every.withColumn("node_id", F.row_number().over(own.orderBy("path")) - 1)
    # each node reports to all above it and to itself: the least of the numbers that a path gets is its own, the largest its last
    above = ordered.withColumn("_v", F.struct("key", "kind", "value")).select("doc_id", "node_id", "path", "_v", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("prefix"))
    merged = above.groupBy("doc_id", F.col("prefix").alias("path")).agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("last_id"), F.max(F.when(F.col("path") == F.col("prefix"), F.col("_v"))).alias("_v"))
    numbers = kept(merged.select("doc_id", "path", "node_id", "last_id", "_v.*"), "json-numbers")
    parent = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
    up = numbers.select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"), F.col("node_id").alias("_n"))
    joined = numbers.join(dealt(up), (F.col("doc_id") == F.col("_d")) & (parent == F.col("_p")), "left").withColumn("parent_id", F.coalesce("_n", F.lit(-1)))
    return kept(
        joined.select(
            "doc_id", "node_id", "last_id", F.max("last_id").over(own).alias("doc_last"), "parent_id", F.size("path").alias("depth"), "key", F.when(F.size("path") > 0, F.element_at("path", -1)).alias("pos"),
            F.count("*").over(Window.partitionBy("doc_id", "parent_id")).cast("int").alias("of"), "kind", "value",
        ),
        "json-nodes",
    )


#: A list relation here also says whose list it is: ctx is 0 for the document's, or the number of a filter's candidate.
KEY = ["doc_id", "ctx", "place", "node_id"]


class Operand:
    """A filter's operand as columns: whether it is there, its kind and its text; node: its number, if it comes from a path."""

    def __init__(self, kind: Column, text: Column, node: Column | None = None):
        self.there, self.kind, self.text, self.node = kind.isNotNull(), F.coalesce(kind, F.lit("null")), F.coalesce(text, F.lit("")), node

    @property
    def number(self) -> Column:
        """As a number, where it is one, or a truth value."""
        return F.when(self.kind == "number", self.text.try_cast("double")).when(self.kind == "boolean", (self.text == "true").cast("double"))

    @property
    def read(self) -> Column:
        """As a number, also where it is a text that says one."""
        return F.coalesce(self.number, F.when(self.kind == "string", F.trim(self.text).try_cast("double")))


def _sliced(k: Column, n: Column, first: int | None, last: int | None, step: int) -> Column:
    """For place k of n: the order in which a slice takes it, or null. Both ends belong to it; ends beyond the list move to its
    ends, open ones are where a walk by step starts and stops. A step of 0 takes nothing."""
    if not step:
        return F.lit(None).cast("long")
    inside = lambda x: F.greatest(F.least(n + x if x < 0 else F.lit(x), n - 1), F.lit(0))
    start = inside(first) if first is not None else F.lit(0) if step > 0 else n - 1
    stop = inside(last) if last is not None else n - 1 if step > 0 else F.lit(0)
    if step > 0:
        return F.when((k >= start) & (k <= stop) & ((k - start) % step == 0), k.cast("long"))
    return F.when((k <= start) & (k >= stop) & ((start - k) % -step == 0), -k.cast("long"))


class Planner:
    """JSON paths over one node table."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    # ---- filters

    def _operand(self, frame: DataFrame, text: str) -> tuple[DataFrame, Operand]:
        text = text.strip()
        if text == "@":
            return frame, Operand(F.col("kind"), F.col("value"), F.col("node_id"))
        if text.startswith("@"):
            own = frame.select("doc_id", F.col("node_id").alias("ctx"), F.lit(0).alias("place"), "node_id").distinct()
            found = self.follow(own, parse("$" + text[1:]))
            values = found.join(dealt(self.nodes.select("doc_id", "node_id", "kind", "value")), ["doc_id", "node_id"])
            name = f"_f{len(frame.columns)}"
            first = values.groupBy("doc_id", "ctx").agg(F.min_by(F.struct("kind", "value", "node_id"), "place").alias(name))
            first = first.select(F.col("doc_id").alias("_d"), F.col("ctx").alias("_n"), name)
            joined = frame.join(dealt(first), (F.col("doc_id") == F.col("_d")) & (F.col("node_id") == F.col("_n")), "left").drop("_d", "_n")
            return joined, Operand(F.col(f"{name}.kind"), F.col(f"{name}.value"), F.col(f"{name}.node_id"))
        value = _unquote(text)
        if text[:1] not in ("'", '"'):
            try:
                value = json.loads(text)
            except ValueError:
                value = text
        kind = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", list: "array", dict: "object"}[type(value)]
        return frame, Operand(F.lit(kind), F.lit(text_of(value)))

    def _holds(self, frame: DataFrame, condition: str) -> tuple[DataFrame, Column]:
        """frame with the columns that a condition takes, and the condition, which is never null."""
        for word in ("||", "&&"):
            parts = split_plain(condition, word)
            if len(parts) > 1:
                out = None
                for part in parts:
                    frame, holds = self._holds(frame, part)
                    out = holds if out is None else (out | holds) if word == "||" else (out & holds)
                return frame, out
        condition = condition.strip()
        if condition.startswith("!") and not condition.startswith("!="):
            frame, holds = self._holds(frame, condition[1:])
            return frame, ~holds
        if condition.startswith("(") and condition.endswith(")"):
            return self._holds(frame, condition[1:-1])
        if m := re.fullmatch(r"contains\s*\(\s*(.+?)\s*,\s*(.+?)\s*\)", condition):
            frame, a = self._operand(frame, m[1])
            frame, b = self._operand(frame, m[2])
            name = f"_m{len(frame.columns)}"
            if a.node is None:
                return frame, a.there & a.text.contains(b.text)
            members = self.nodes.where("key IS NULL AND parent_id >= 0").select(F.col("doc_id").alias("_d"), F.col("parent_id").alias("_n"), F.col("value").alias("_v")).distinct().withColumn(name, F.lit(True))
            frame = frame.join(dealt(members), (F.col("doc_id") == F.col("_d")) & (a.node == F.col("_n")) & (b.text == F.col("_v")), "left").drop("_d", "_n", "_v")
            return frame, a.there & F.when(a.kind == "array", F.col(name).isNotNull()).otherwise(a.text.contains(b.text))
        m = re.fullmatch(r"(.+?)\s*(==|!=|<=|>=|<|>)\s*(.+)", condition, re.DOTALL)
        if not m:
            frame, a = self._operand(frame, condition)
            return frame, a.there
        frame, a = self._operand(frame, m[1])
        frame, b = self._operand(frame, m[3])
        if m[2] in ("==", "!="):
            same = a.there & (F.coalesce(a.number == b.number, F.lit(False)) | (a.text == b.text))
            return frame, same if m[2] == "==" else ~same
        compare = lambda x, y: {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[m[2]]
        texts = (a.kind == "string") & (b.kind == "string") & a.there & b.there
        return frame, F.coalesce(F.when(a.read.isNotNull() & b.read.isNotNull(), compare(a.read, b.read)).otherwise(texts & compare(a.text, b.text)), F.lit(False))

    # ---- steps

    def _found(self, now: DataFrame, step: Step) -> DataFrame:
        """doc_id, ctx, place (of the node whose list it is), _o (the order in that list) and node_id."""
        kind, arg = step
        columns = ["doc_id", "ctx", "place", "_o", "node_id"]
        if kind == "union":
            out = None
            for i, part in enumerate(arg):
                found = self._found(now, part).withColumn("_o", F.concat(F.array(F.lit(i).cast("long")), "_o"))
                out = found if out is None else out.unionByName(found)
            return out
        if kind == "deep":
            ranged = now.join(dealt(self.nodes.select("doc_id", "node_id", "last_id")), ["doc_id", "node_id"])
            return pairs_below(ranged, self.nodes, ["ctx", "place"], own=True).withColumn("_o", F.array(F.col("node_id").cast("long"))).select(*columns)
        members = self.nodes
        if kind == "name":
            members = members.where(F.col("key") == arg)
        elif kind in ("index", "slice"):
            members = members.where(F.col("key").isNull())
        if kind == "index":
            members = members.where(F.col("pos") == (F.lit(arg) if arg >= 0 else F.col("of") + arg))
        if kind == "slice":
            members = members.withColumn("_s", _sliced(F.col("pos"), F.col("of"), *arg)).where("_s IS NOT NULL")
        order = F.col("_s") if kind == "slice" else F.col("pos").cast("long")
        up = now.select(F.col("doc_id").alias("_d"), "ctx", "place", F.col("node_id").alias("_n"))
        found = members.join(dealt(up), (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_n"))).withColumn("_o", F.array(order))
        if kind == "filter":
            found, holds = self._holds(found.select(*columns, "kind", "value"), arg)
            found = found.where(holds)
        return found.select(*columns)

    def follow(self, now: DataFrame, steps: tuple[Step, ...]) -> DataFrame:
        """A list relation after some steps."""
        for step in steps:
            found = self._found(now, step)
            if step[0] in ("name", "index"):  # one for each place at most: places stay in order, with gaps
                now = found.select(*KEY)
            else:
                place = F.row_number().over(Window.partitionBy("doc_id", "ctx").orderBy("place", "_o")) - 1
                now = found.select("doc_id", "ctx", place.alias("place"), "node_id")
        return now

    def find(self, path: str) -> DataFrame:
        """doc_id, place (sorts them) and the node columns of what a path finds."""
        root = self.nodes.where("node_id = 0").select("doc_id", F.lit(0).alias("ctx"), F.lit(0).alias("place"), "node_id")
        found = self.follow(root, parse(path)).select("doc_id", "place", "node_id")
        return found.join(dealt(self.nodes), ["doc_id", "node_id"])


def json_rows(nodes: DataFrame, path: str) -> DataFrame:
    """A row for each value that a path finds: doc_id, place, and the node's columns. As a list rule has it, an only value that is
    an array stands for its members."""
    found = Planner(nodes).find(path)
    marked = found.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id")))
    alone = (F.col("_n") == 1) & (F.col("kind") == "array")
    whole = marked.where(alone).select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_p"))
    members = nodes.join(dealt(whole), (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("_p"))).drop("_d", "_p").withColumn("place", F.col("pos"))
    return marked.where(~alone).drop("_n").unionByName(members)


def json_values(nodes: DataFrame, paths: dict[str, str]) -> DataFrame:
    """doc_id and, for each path, an array of the values that it finds, as text and without empty ones; documents in which none
    finds any have no row."""
    if not paths:
        raise RuleError("no paths")
    planner, out = Planner(nodes), None
    for name, path in paths.items():
        tall = values_in_order(planner.find(path), F.col("value")).select("doc_id", F.lit(name).alias("_rule"), "values")
        out = tall if out is None else out.unionByName(tall)
    own = lambda name: F.first(F.when(F.col("_rule") == name, F.col("values")), ignorenulls=True).alias(name)
    return out.groupBy("doc_id").agg(*map(own, paths))

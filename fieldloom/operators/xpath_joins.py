"""XPath as joins and windows over a node table.

A path is evaluated for contexts, a table of doc_id, ctx and node_id: ctx says whose list a node belongs to. At first a
document has one context, its root; within a predicate each candidate node is a context of its own. A step is a join: child
and parent by number, descendant by one window where each document has one context, and by dyadic blocks otherwise, from
contexts without those that another one covers, so that nothing is found twice. position() and last() are windows over a
context's list. A path as an operand is evaluated for all candidates at once, and its first value and its count come back as
columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import RuleError
from ..plans.lexer import open_places, split_plain
from .trees import below_any, outermost, pairs_below
from .xpath import Step, _split_word, parse

KEY = ["doc_id", "ctx", "node_id"]
#: Predicates that may look at a node's place: position(), last(), or a number that stands alone.
_PLACES = re.compile(r"position\(\)|last\(\)|count\(|string-length\(|(^|\bor\b|\band\b|\()\s*-?\d+(\.\d+)?\s*($|\bor\b|\band\b|\))")


@dataclass(frozen=True)
class Operand:
    """A column, whether it is a number (else text), and whether it is an attribute as such."""

    column: Column
    number: bool


def _contexts(nodes: DataFrame) -> DataFrame:
    """Each document's root as its only context."""
    return nodes.where("node_id = 1").select("doc_id", F.lit(0).alias("ctx"), F.lit(0).alias("node_id"))


def _named(nodes: DataFrame, name: str) -> DataFrame:
    if name in ("*", "node()"):
        return nodes
    return nodes.where((F.col("tag") == name) | F.col("tag").endswith(":" + name))


def _axis(nodes: DataFrame, now: DataFrame | None, step: Step, single: bool) -> DataFrame:
    """now's nodes replaced by those that the axis leads to, each once in a context; now None: the documents' roots."""
    wanted = _named(nodes, step.name) if step.axis in ("child", "deep") else nodes
    if now is None:
        if step.axis in ("self", "parent"):
            return _contexts(nodes).where(F.lit(step.axis == "self"))
        reached = wanted.where("parent_id = 0") if step.axis == "child" else wanted
        return reached.select("doc_id", F.lit(0).alias("ctx"), "node_id")
    if step.axis == "self":
        return now
    if step.axis == "parent":
        up = now.join(nodes.select("doc_id", "node_id", "parent_id"), ["doc_id", "node_id"]).where("parent_id > 0")
        return up.select("doc_id", "ctx", F.col("parent_id").alias("node_id")).distinct()
    if step.axis == "child":
        up = now.select(F.col("doc_id").alias("_d"), "ctx", F.col("node_id").alias("_n"))
        return wanted.join(up, (wanted["doc_id"] == up["_d"]) & (wanted["parent_id"] == up["_n"])).select(*KEY)
    ranged = now.join(nodes.select("doc_id", "node_id", "last_id"), ["doc_id", "node_id"])
    if single:
        return below_any(wanted, ranged).select("doc_id", F.lit(0).alias("ctx"), "node_id")
    return pairs_below(outermost(ranged, ["doc_id", "ctx"]).where("last_id > node_id"), wanted, ["ctx"])


class Planner:
    """Paths over one node table."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    # ---- predicates

    def _path_operand(self, frame: DataFrame, path: str, count: bool) -> tuple[DataFrame, Operand]:
        """The first value of a path (or how many it finds) from each candidate, as a column."""
        own = frame.select("doc_id", F.col("node_id").alias("ctx"), "node_id").distinct()
        rows, is_values = self.evaluate(path, own)
        if not is_values:
            rows = rows.withColumn("at", F.struct(F.lit(0).alias("branch"), F.col("node_id").alias("place")))
        name = f"_p{len(frame.columns)}"
        if count:
            found = rows.groupBy("doc_id", "ctx").agg(F.count("*").cast("double").alias(name))
        else:
            if not is_values:
                rows = rows.join(self.nodes.select("doc_id", "node_id", F.col("text").alias("value")), ["doc_id", "node_id"])
            found = rows.groupBy("doc_id", "ctx").agg(F.min_by("value", "at").alias(name))
        found = found.select(F.col("doc_id").alias("_d"), F.col("ctx").alias("_n"), name)
        joined = frame.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("node_id") == F.col("_n")), "left").drop("_d", "_n")
        return joined, Operand(F.coalesce(F.col(name), F.lit(0.0)) if count else F.col(name), count)

    def _value(self, frame: DataFrame, text: str) -> tuple[DataFrame, Operand]:
        text = text.strip()
        if text[:1] in ("'", '"') and text[-1:] == text[:1]:
            return frame, Operand(F.lit(text[1:-1]), False)
        if re.fullmatch(r"-?\d+(\.\d+)?", text):
            return frame, Operand(F.lit(float(text)), True)
        if m := re.fullmatch(r"(last|position)\(\)(?:\s*([+-])\s*(\d+))?", text):
            shift = float((m[2] or "+") + (m[3] or "0"))
            return frame, Operand(F.col("_size" if m[1] == "last" else "_place").cast("double") + F.lit(shift), True)
        if m := re.fullmatch(r"(normalize-space|string|string-length|count)\((.*)\)", text):
            if m[1] == "count":
                return self._path_operand(frame, m[2], True)
            if m[2].strip() in ("", "."):
                inner: Column = F.col("text")
            else:
                frame, operand = self._value(frame, m[2])
                inner = F.coalesce(operand.column.cast("string"), F.lit(""))
            if m[1] == "string-length":
                return frame, Operand(F.char_length(inner).cast("double"), True)
            return frame, Operand(F.trim(F.regexp_replace(inner, r"(?U)\s+", " ")), False)
        if text == ".":
            return frame, Operand(F.col("text"), False)
        if text == "text()":
            return frame, Operand(F.col("own_text"), False)
        if text.startswith("@") and "/" not in text:
            return frame, Operand(F.element_at("attrs", text[1:].lower()), False)
        return self._path_operand(frame, text, False)

    def _holds(self, frame: DataFrame, condition: str) -> tuple[DataFrame, Column]:
        """frame with the columns that a condition takes, and the condition; it is never null."""
        condition = condition.strip()
        for word in ("or", "and"):
            parts = _split_word(condition, word)
            if len(parts) > 1:
                out = None
                for part in parts:
                    frame, holds = self._holds(frame, part)
                    out = holds if out is None else (out | holds) if word == "or" else (out & holds)
                return frame, out
        if m := re.fullmatch(r"not\s*\((.*)\)", condition, re.DOTALL):
            frame, holds = self._holds(frame, m[1])
            return frame, ~holds
        if m := re.fullmatch(r"(contains|starts-with|ends-with)\s*\((.*)\)", condition, re.DOTALL):
            sides = []
            for side in split_plain(m[2], ","):
                frame, operand = self._value(frame, side)
                sides.append(F.coalesce(operand.column.cast("string"), F.lit("")))
            if len(sides) != 2:
                raise RuleError(f"invalid XPath condition: {condition}")
            return frame, {"contains": sides[0].contains, "starts-with": sides[0].startswith, "ends-with": sides[0].endswith}[m[1]](sides[1])
        places = set(open_places(condition))
        if m := next((m for m in re.finditer(r"!=|<=|>=|=|<|>", condition) if m.start() in places), None):
            frame, a = self._value(frame, condition[: m.start()])
            frame, b = self._value(frame, condition[m.end() :])
            return frame, _compared(a, b, m[0])
        frame, found = self._value(frame, condition)
        if found.number:
            return frame, F.coalesce(found.column == F.col("_place"), F.lit(False))
        there = found.column.isNotNull()
        return frame, there if condition[:1] == "@" else there & (F.coalesce(found.column, F.lit("")) != "")

    def _where(self, found: DataFrame, predicate: str) -> DataFrame:
        """found without the nodes that fail a predicate; places count over a context's whole list."""
        own = Window.partitionBy("doc_id", "ctx")
        if _PLACES.search(predicate):
            found = found.withColumn("_place", F.row_number().over(own.orderBy("node_id"))).withColumn("_size", F.count("*").over(own))
        frame = found.join(self.nodes.select("doc_id", "node_id", "attrs", "own_text", "text"), ["doc_id", "node_id"])
        frame, holds = self._holds(frame, predicate)
        return frame.where(holds).select(*KEY)

    # ---- paths

    def _one(self, path: str, contexts: DataFrame | None) -> tuple[DataFrame, bool]:
        """Nodes of a path (doc_id, ctx, node_id), or its values (with value), in the order of nodes."""
        now, single = contexts, contexts is None
        if path.startswith("/") and contexts is not None:  # from the root, for each context
            roots = contexts.select("doc_id", "ctx").distinct()
            everywhere, values = self._one(path, None)
            return everywhere.drop("ctx").join(roots, "doc_id"), values
        for step in parse(path):
            if step.axis in ("attr", "text", "string"):
                value = {"attr": F.element_at("attrs", step.name), "text": F.when(F.col("own_text") != "", F.col("own_text")), "string": F.col("text")}[step.axis]
                if now is None:  # the root has no attributes or text of its own
                    now = _contexts(self.nodes).where(F.lit(False))
                return now.join(self.nodes.select("doc_id", "node_id", value.alias("value")), ["doc_id", "node_id"]).where("value IS NOT NULL"), True
            now = _axis(self.nodes, now, step, single)
            for predicate in step.predicates:
                now = self._where(now, predicate)
        return (now if now is not None else _contexts(self.nodes)), False

    def evaluate(self, path: str, contexts: DataFrame | None = None) -> tuple[DataFrame, bool]:
        """(doc_id, ctx, node_id) and False; or (doc_id, ctx, at, value) and True if a branch of a union yields values."""
        found = [self._one(p, contexts) for p in split_plain(path, "|")]
        if not any(values for _, values in found):
            out = found[0][0].select(*KEY)
            for rows, _ in found[1:]:
                out = out.unionByName(rows.select(*KEY))
            return (out.distinct() if len(found) > 1 else out), False
        out = None
        for i, (rows, values) in enumerate(found):
            if not values:
                rows = rows.join(self.nodes.select("doc_id", "node_id", F.col("text").alias("value")), ["doc_id", "node_id"])
            rows = rows.select("doc_id", "ctx", F.struct(F.lit(i).alias("branch"), F.col("node_id").alias("place")).alias("at"), "value")
            out = rows if out is None else out.unionByName(rows)
        return out, True


def _compared(a: Operand, b: Operand, sign: str) -> Column:
    """A comparison: by numbers if either side is one or the sign is an order, else by text; false where a side is missing, and
    where one that isn't a number is compared as such (but for !=)."""
    if sign in ("=", "!=") and not a.number and not b.number:
        x, y = a.column, b.column
        result = (x == y) if sign == "=" else (x != y)
        return F.coalesce(result, F.lit(False))
    x, y = (o.column if o.number else o.column.try_cast("double") for o in (a, b))
    result = {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign]
    there = a.column.isNotNull() & b.column.isNotNull()
    return there & F.coalesce(result, F.lit(sign == "!="))


def xpath_nodes(nodes: DataFrame, path: str) -> DataFrame:
    """doc_id and node_id of what a path finds in each document, each once."""
    rows, values = Planner(nodes).evaluate(path)
    if values:
        raise RuleError(f"{path} yields values, not nodes")
    return rows.select("doc_id", "node_id")


def xpath_values(nodes: DataFrame, path: str) -> DataFrame:
    """doc_id, place (sorts them) and value of what a path finds: texts of nodes, or values, in document order; branches of a
    union that yield values one after the other."""
    rows, values = Planner(nodes).evaluate(path)
    if not values:
        rows = rows.join(nodes.select("doc_id", "node_id", F.col("text").alias("value")), ["doc_id", "node_id"])
        rows = rows.withColumn("at", F.struct(F.lit(0).alias("branch"), F.col("node_id").alias("place")))
    return rows.select("doc_id", F.col("at").alias("place"), "value")

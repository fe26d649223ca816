"""Any number of selectors over a node table at once.

Selectors are cut into steps (a combinator and a compound of tests), and steps with the same beginning share a state, so all
of them make one automaton: transitions (state before, combinator, compound, state after) and, for each state in which a
selector ends, the selector. Tables hold it, so it may come from a table of sources and be as large as that.

Which compounds a node meets is one join, by the rarest kind of test that a compound has (id, class, tag, attribute name),
and a check of the others. Then states go down the trees, one join for each step of the longest selector: a node gets the
state after a transition if it meets the compound and the state before is at its parent (or above it, or at a sibling before
it). What that costs depends on how many nodes are in some state, not on how many selectors there are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import UnsupportedRule
from ..plans.lexer import split_plain
from .nodes import _TOKEN
from .staging import kept
from .trees import below_any, pairs_below

COMPOUND = "struct<key: string, anchor: string, tag: string, id: string, classes: array<string>, attrs: array<struct<name: string, op: string, value: string>>>"
STEPS = f"array<array<struct<before: string, combinator: string, compound: {COMPOUND}, after: string>>>"


def _compound(text: str) -> dict:
    """A compound of tests in a form of its own: the same for the same tests in another order."""
    tag, own_id, classes, attrs, end = None, None, set(), set(), 0
    while end < len(text):
        m = _TOKEN.match(text, end)
        if not m or m["pseudo"]:
            raise UnsupportedRule(f"selector {text!r} among many")
        end = m.end()
        if m["tag"] and m["tag"] != "*":
            tag = m["tag"].lower()
        elif m["cls"]:
            classes.add(m["cls"])
        elif m["id"]:
            if own_id not in (None, m["id"]):
                raise UnsupportedRule(f"selector {text!r} has two ids")
            own_id = m["id"]
        elif m["attr"]:
            attrs.add((m["attr"].lower(), m["op"] or "", (m["val"] or "").strip().strip("'\"")))
    named = [{"name": n, "op": o, "value": v} for n, o, v in sorted(attrs)]
    key = f"{tag or '*'}{'#' + own_id if own_id else ''}{''.join('.' + c for c in sorted(classes))}{''.join('[%s%s%r]' % x for x in sorted(attrs))}"
    there = [n for n, o, _ in sorted(attrs) if o != "!="]
    anchor = f"#{own_id}" if own_id else f".{min(classes)}" if classes else f"<{tag}" if tag else f"[{there[0]}" if there else "*"
    return {"key": key, "anchor": anchor, "tag": tag, "id": own_id, "classes": sorted(classes), "attrs": named}


def steps_of(selector: str) -> list[list[dict]]:
    """The steps of each of a selector's groups, with the states before and after them."""
    out = []
    for group in split_plain(selector, ","):
        parts = re.findall(r"\s*([>+~]|\s)\s*((?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|[^\s>+~\[(])+)", " " + group)
        if not parts:
            raise UnsupportedRule(f"empty selector: {selector!r}")
        state, steps = "", []
        for n, (combinator, compound) in enumerate(parts):
            made = _compound(compound)
            sign = combinator.strip() or " "
            after = f"{state}{sign if n else ''}{made['key']}"
            steps.append({"before": state, "combinator": sign, "compound": made, "after": after})
            state = after
        out.append(steps)
    return out


class Automaton:
    """The automaton of a table of selectors (rule, selector): transitions, compounds, ends and the longest selector's steps."""

    def __init__(self, selectors: DataFrame):
        @F.pandas_udf(STEPS)
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(steps_of)

        groups = kept(selectors.select("rule", F.explode(cut("selector")).alias("steps")), "selector-steps")
        steps = groups.select(F.posexplode("steps").alias("n", "s")).select("n", "s.*")
        self.transitions = kept(steps.groupBy("n", "before", "combinator", "after").agg(F.first("compound").alias("c")).select("n", "before", "combinator", "after", F.col("c.key").alias("key")), "selector-transitions")
        self.compounds = kept(steps.select("compound.*").groupBy("key", "anchor").agg(*[F.first(c).alias(c) for c in ("tag", "id", "classes", "attrs")]), "selector-compounds")
        self.ends = groups.select("rule", F.element_at("steps", -1)["after"].alias("state")).distinct()
        self.length = (self.transitions.agg(F.max("n")).first()[0] or 0) + 1


def _meets(attribute: Column, a: Column) -> Column:
    """Whether an attribute's value passes a test."""
    value, op = a["value"], a["op"]
    return F.coalesce(
        F.when(op == "", attribute.isNotNull()).when(op == "=", attribute == value).when(op == "!=", attribute.isNull() | (attribute != value)).when(op == "*=", attribute.contains(value)).when(op == "^=", attribute.startswith(value))
        .when(op == "$=", attribute.endswith(value)).when(op == "~=", F.rlike(attribute, value)).when(op == "|=", (attribute == value) | attribute.startswith(F.concat(value, F.lit("-")))),
        F.lit(False),
    )


def _met(nodes: DataFrame, compounds: DataFrame) -> DataFrame:
    """A row for each node and each compound that it meets: doc_id, node_id, last_id, parent_id, ord and key."""
    of_class, of_attr = F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.transform(F.map_keys("attrs"), lambda k: F.concat(F.lit("["), k))
    anchors = F.array_distinct(F.concat(F.array(F.lit("*"), F.concat(F.lit("<"), "tag")), F.when(F.col("elem_id").isNotNull(), F.array(F.concat(F.lit("#"), "elem_id"))).otherwise(F.array().cast("array<string>")), of_class, of_attr))
    wanted = compounds.select(F.col("key"), F.col("anchor"), *[F.col(c).alias(f"_{c}") for c in ("tag", "id", "classes", "attrs")])
    tried = nodes.select("doc_id", "node_id", "last_id", "parent_id", "ord", "tag", "elem_id", "classes", "attrs", F.explode(anchors).alias("anchor")).join(wanted, "anchor")
    same = lambda mine, theirs: F.col(theirs).isNull() | F.coalesce(F.col(mine) == F.col(theirs), F.lit(False))
    every = (F.size(F.array_except("_classes", "classes")) == 0) & F.forall("_attrs", lambda a: _meets(F.element_at("attrs", a["name"]), a))
    return tried.where(same("tag", "_tag") & same("elem_id", "_id") & every).select("doc_id", "node_id", "last_id", "parent_id", "ord", "key")


def match_selectors(nodes: DataFrame, selectors: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(rule, doc_id, node_id), each once: what each selector of a table (rule, selector) finds in each document.

    scope (doc_id, rule), if given, says which selectors are for which documents; states that lead to no other are left out
    from the start. Selectors have tags, classes, ids and attribute tests, all combinators and groups."""
    a = Automaton(selectors)
    met = kept(_met(nodes, a.compounds), "compound-nodes")
    allowed = None
    if scope is not None:  # the states on the way to the ends that count for a document
        ways = a.transitions.select(F.col("before"), F.col("after"), F.col("n"))
        reached = a.ends.join(scope, "rule").select("doc_id", F.col("state").alias("after")).distinct()
        allowed = reached
        for _ in range(a.length - 1):
            reached = reached.join(ways, "after").where("before <> ''").select("doc_id", F.col("before").alias("after")).distinct()
            allowed = allowed.unionByName(reached)
        allowed = kept(allowed.distinct(), "selector-scope")
    found, now = None, None
    for n in range(a.length):
        moves = met.join(a.transitions.where(F.col("n") == n).select("before", "combinator", "key", "after"), "key")
        if allowed is not None:
            moves = moves.join(allowed, ["doc_id", "after"], "left_semi")
        if now is not None:
            up = now.select(F.col("doc_id").alias("_d"), F.col("after").alias("_s"), F.col("node_id").alias("_n"), F.col("parent_id").alias("_p"), F.col("ord").alias("_o"))
            base = (F.col("doc_id") == F.col("_d")) & (F.col("before") == F.col("_s"))
            of = lambda sign: moves.where(F.col("combinator") == sign)
            child = of(">").join(up, base & (F.col("parent_id") == F.col("_n")), "left_semi")
            beside = of("+").join(up, base & (F.col("parent_id") == F.col("_p")) & (F.col("ord") == F.col("_o") + 1), "left_semi")
            first = up.groupBy("_d", "_s", "_p").agg(F.min("_o").alias("_o"))
            behind = of("~").join(first, base & (F.col("parent_id") == F.col("_p")) & (F.col("ord") > F.col("_o")), "left_semi")
            below = below_any(of(" "), now.withColumnRenamed("after", "_state").select("doc_id", "node_id", "last_id", F.col("_state").alias("before")), ["before"])
            moves = child.unionByName(beside).unionByName(behind).unionByName(below)
        now = kept(moves.select("doc_id", "node_id", "last_id", "parent_id", "ord", "after"), "selector-states")
        ended = now.join(a.ends.withColumnRenamed("state", "after"), "after").select("rule", "doc_id", "node_id")
        found = ended if found is None else found.unionByName(ended)
    found = found.distinct()
    return found if scope is None else found.join(scope.select("doc_id", "rule"), ["doc_id", "rule"], "left_semi").select("rule", "doc_id", "node_id")


def extract_many(nodes: DataFrame, rules: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(rule, doc_id, item, field, value): the fields of the items of many list rules.

    rules has rule, field, selector and mode; the field "" is the list itself. A field's value is that of the nodes below an
    item that its selector finds, in document order, joined by line ends, empty ones left out; mode is text, ownText or an
    attribute. Items without a value of a field have no row for it."""
    named = rules.withColumn("_one", F.concat_ws("\n", "rule", "field"))
    wide = None if scope is None else scope.join(named.select("rule", F.col("_one")), "rule").select("doc_id", F.col("_one").alias("rule"))
    found = match_selectors(nodes, named.select(F.col("_one").alias("rule"), "selector"), wide)
    found = kept(found.join(named.select(F.col("_one"), F.col("rule").alias("of"), "field", "mode"), F.col("rule") == F.col("_one")).select(F.col("of").alias("rule"), "field", "mode", "doc_id", "node_id"), "many-nodes")
    ends = nodes.select("doc_id", "node_id", "last_id", "doc_last")
    items = found.where("field = ''").join(ends, ["doc_id", "node_id"])
    order = F.row_number().over(Window.partitionBy("rule", "doc_id").orderBy("node_id")) - 1
    items = items.select("rule", "doc_id", order.alias("item"), "node_id", "last_id")
    targets = found.where("field <> ''").select("doc_id", "node_id").distinct().join(ends.select("doc_id", "node_id", "doc_last"), ["doc_id", "node_id"])
    pairs = pairs_below(items, targets, ["rule", "item"])
    fields = found.where("field <> ''").select("rule", "doc_id", "node_id", "field", "mode")
    held = pairs.join(fields, ["rule", "doc_id", "node_id"]).join(nodes.select("doc_id", "node_id", "text", "own_text", "attrs"), ["doc_id", "node_id"])
    value = F.when(F.col("mode") == "text", F.col("text")).when(F.col("mode") == "ownText", F.col("own_text")).otherwise(F.coalesce(F.element_at("attrs", F.col("mode")), F.lit("")))
    parts = held.select("rule", "doc_id", "item", "field", F.struct("node_id", value.alias("value")).alias("v")).where("v.value <> ''")
    return parts.groupBy("rule", "doc_id", "item", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["value"]), "\n").alias("value"))

"""Chains of selectors with index suffixes over a node table: nav@li@a.0, tag.p[1:3], class.item!0.

The context of a chain is a list relation (see trees.py). A step finds, for each place of the list, the nodes below it that
its selector matches, by one join over dyadic blocks; an index suffix is then a window for each place, and the lists are
strung together in the order of places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rule as R
from ..plans.errors import UnsupportedRule
from .indexes import cut
from .nodes import pick_position, select_nodes
from .trees import numbered, pairs_below, picked, values_in_order

#: What can be read from a node; other modes are attributes. The markup of a node takes its document (operators/dom.py).
MODES = {"text": "text", "ownText": "own_text"}


def candidates(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes that one selector of a chain stands for, wherever they are: a prefix class., tag., id. or text., or CSS."""
    kind, _, value = selector.partition(".")
    if value and kind in ("class", "tag", "id", "text"):
        test: dict[str, Column] = {"class": F.array_contains("classes", value), "tag": F.col("tag") == value.lower(), "id": F.col("elem_id") == value, "text": F.col("own_text").contains(value)}
        return nodes.where(test[kind])
    return select_nodes(nodes, selector)


def step_below(nodes: DataFrame, context: DataFrame | None, step: str) -> DataFrame:
    """One step from a list relation (None: the documents themselves), as a list relation."""
    selector, indexes = cut(step)
    if selector in ("", "children"):
        if context is None:
            found = nodes.where("parent_id = 0").select("doc_id", F.lit(0).alias("place"), "node_id")
        else:
            up = context.select(F.col("doc_id").alias("_d"), "place", F.col("node_id").alias("_n"))
            found = nodes.join(up, (nodes["doc_id"] == up["_d"]) & (nodes["parent_id"] == up["_n"])).select("doc_id", "place", "node_id")
    else:
        wanted = candidates(nodes, selector)
        if context is None:
            found = wanted.select("doc_id", F.lit(0).alias("place"), "node_id")
        else:
            up = context.join(nodes.select("doc_id", "node_id", "last_id"), ["doc_id", "node_id"]).where("last_id > node_id")
            found = pairs_below(up, wanted, ["place"])
    return picked(found, indexes)


def chain(nodes: DataFrame, steps: Sequence[str], context: DataFrame | None = None) -> DataFrame:
    """The nodes at the end of a chain as a list relation: doc_id, place, node_id."""
    for step in steps:
        context = step_below(nodes, context, step)
    if context is None:
        raise UnsupportedRule("a chain without steps")
    return context


def css(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes that a CSS selector finds in each document, as a list relation; one positional filter may end it."""
    base, _, last = selector.rpartition(":")
    name, _, argument = last.partition("(")
    if base and name in ("eq", "lt", "gt", "first", "last", "even", "odd"):
        return numbered(pick_position(select_nodes(nodes, base), name, int(argument.rstrip(")") or 0)), "node_id")
    return numbered(select_nodes(nodes, selector), "node_id")


def read(nodes: DataFrame, found: DataFrame, mode: str) -> DataFrame:
    """A list relation with the value of each node: doc_id, place, node_id, value."""
    if mode in ("html", "all", "textNodes"):
        raise UnsupportedRule(f"@{mode} from a node table")
    value = F.col(MODES[mode]) if mode in MODES else F.coalesce(F.element_at("attrs", mode), F.lit(""))
    return found.join(nodes.select("doc_id", "node_id", value.alias("value")), ["doc_id", "node_id"])


def rule_values(nodes: DataFrame, rule: str) -> DataFrame:
    """doc_id and the values (array<string>) of a rule without combinators: @css:..., a chain, an XPath, or one of these after a
    minus sign, which turns the list round. Documents without values have no row."""
    from .xpath_joins import xpath_values

    tree = R.parse(rule, "full")
    turned = isinstance(tree, R.Reverse)
    tree = tree.base if turned else tree
    if isinstance(tree, R.XPath):
        rows = xpath_values(nodes, tree.path)
    elif isinstance(tree, R.Css):
        rows = read(nodes, css(nodes, tree.selector), tree.mode)
    elif isinstance(tree, R.Chain):
        rows = read(nodes, chain(nodes, tree.steps), tree.mode)
    else:
        raise UnsupportedRule(f"{rule} over a node table")
    found = values_in_order(rows, F.col("value"))
    return found.select("doc_id", F.reverse("values").alias("values")) if turned else found


def rules_values(nodes: DataFrame, rules: dict[str, str]) -> DataFrame:
    """doc_id and an array column for each rule; documents without any value have no row."""
    out = None
    for name, rule in rules.items():
        tall = rule_values(nodes, rule).select("doc_id", F.lit(name).alias("_rule"), "values")
        out = tall if out is None else out.unionByName(tall)
    own = lambda name: F.first(F.when(F.col("_rule") == name, F.col("values")), ignorenulls=True).alias(name)
    return out.groupBy("doc_id").agg(*map(own, rules))

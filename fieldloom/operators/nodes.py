"""HTML as a table of nodes, and selectors as joins over it.

A node has its number in document order (node_id) and the last number below it (last_id), so what is below it is a range;
trees.py says how such ranges are joined without comparing all with all. A child join is an equality. For many selectors
over the same pages this parses once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.errors import UnsupportedRule
from ..plans.lexer import split_plain
from .dom import Document
from .trees import below_any, has_below

_FIELDS = [
    ("node_id", pa.int32()), ("last_id", pa.int32()), ("doc_last", pa.int32()), ("parent_id", pa.int32()), ("ord", pa.int32()), ("siblings", pa.int32()), ("type_ord", pa.int32()), ("type_count", pa.int32()),
    ("depth", pa.int32()), ("tag", pa.string()), ("elem_id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()), ("text", pa.string()),
]
_TYPES = "node_id int, last_id int, doc_last int, parent_id int, ord int, siblings int, type_ord int, type_count int, depth int, tag string, elem_id string, classes array<string>, attrs map<string,string>, own_text string, text string"


def _rows(d: Document) -> list[tuple]:
    depth, out = [0] * len(d.tags), []
    place: dict[int, tuple[int, int, int, int]] = {}
    for parent in range(len(d.tags)):
        row = d.children(parent)
        seen: dict[str, int] = {}
        for i, n in enumerate(row, 1):
            seen[d.tags[n]] = seen.get(d.tags[n], 0) + 1
            place[n] = (i, len(row), seen[d.tags[n]], 0)
        for n in row:
            place[n] = (*place[n][:3], seen[d.tags[n]])
    for n in range(1, len(d.tags)):
        depth[n] = depth[d.parents[n]] + 1
        out.append((n, d.last[n], d.last[0], d.parents[n], *place[n], depth[n], d.tags[n], d.attrs_of[n].get("id"), d.classes(n), list(d.attrs_of[n].items()), d.own_text(n), d.text(n)))
    return out


def shred_html(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """A row for each element of each document, under doc_id; null documents have none."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, html in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = _rows(Document(html)) if html else []
                columns = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
                arrays = [pa.array([key.as_py()] * len(rows), batch.schema.field(0).type), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(n for n, _ in _FIELDS)])

    return df.select(id_col, col).mapInArrow(run, f"doc_id {id_type}, {_TYPES}")


_TOKEN = re.compile(r"(?P<tag>\*|[\w-]+)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$!~|]?=)(?P<val>[^\]]*))?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?")


def _nth(place: Column, formula: str) -> Column:
    text = {"odd": "2n+1", "even": "2n"}.get(formula.strip().lower(), formula.replace(" ", "").lower())
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text)
    if not m:
        return place == int(text)
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return (place == b) if a == 0 else (((place - b) % a == 0) & ((place - b) / a >= 0))


def _test(n: DataFrame, m: re.Match[str]) -> Column:
    """A simple test as a predicate on the node table."""
    if m["tag"]:
        return F.lit(True) if m["tag"] == "*" else n["tag"] == m["tag"].lower()
    if m["cls"]:
        return F.array_contains(n["classes"], m["cls"])
    if m["id"]:
        return n["elem_id"] == m["id"]
    if m["attr"]:
        value = F.element_at(n["attrs"], m["attr"].lower())
        wanted = (m["val"] or "").strip().strip("'\"")
        if not m["op"]:
            return value.isNotNull()
        return {
            "=": value == wanted, "!=": value.isNull() | (value != wanted), "*=": value.contains(wanted), "^=": value.startswith(wanted), "$=": value.endswith(wanted),
            "~=": value.rlike(wanted), "|=": (value == wanted) | value.startswith(wanted + "-"),
        }[m["op"]]
    name, arg = m["pseudo"].lower(), m["arg"]
    places = {"child": ("ord", "siblings"), "of-type": ("type_ord", "type_count")}
    kind = re.fullmatch(r"(first|last|only|nth|nth-last)-(child|of-type)", name)
    if kind:
        at, count = (n[c] for c in places[kind[2]])
        return {"first": lambda: at == 1, "last": lambda: at == count, "only": lambda: count == 1, "nth": lambda: _nth(at, arg), "nth-last": lambda: _nth(count - at + 1, arg)}[kind[1]]()
    if name == "root":
        return n["parent_id"] == 0
    if name == "empty":
        return (n["last_id"] == n["node_id"]) & (n["own_text"] == "")
    if name == "contains":
        return n["text"].contains(arg.strip().strip("'\""))
    raise UnsupportedRule(f":{name} as a join")


def _simple(nodes: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """found without the nodes that fail the tests of one compound; :has and :not are semi and anti joins."""
    end = 0
    while end < len(text):
        m = _TOKEN.match(text, end)
        if not m:
            raise UnsupportedRule(f"selector {text!r} as a join")
        end = m.end()
        name = (m["pseudo"] or "").lower()
        if name == "has":
            found = has_below(found, select_nodes(nodes, m["arg"]))
        elif name == "not":
            inner = select_nodes(nodes, m["arg"]).select("doc_id", "node_id")
            found = found.join(inner, ["doc_id", "node_id"], "left_anti")
        else:
            found = found.where(_test(found, m))
    return found


def _related(step: DataFrame, up: DataFrame, combinator: str) -> DataFrame:
    """The rows of step that stand in a combinator's relation to a row of up."""
    if combinator.strip() == "":
        return below_any(step, up)
    up = up.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("parent_id").alias("_p"), F.col("ord").alias("_o"))
    same = step["doc_id"] == up["_d"]
    if combinator == ">":
        return step.join(up, same & (step["parent_id"] == up["_n"]), "left_semi")
    if combinator == "+":
        return step.join(up, same & (step["parent_id"] == up["_p"]) & (step["ord"] == up["_o"] + 1), "left_semi")
    first = up.groupBy("_d", "_p").agg(F.min("_o").alias("_o"))  # of several siblings before, the first one says it all
    return step.join(first, (step["doc_id"] == first["_d"]) & (step["parent_id"] == first["_p"]) & (step["ord"] > first["_o"]), "left_semi")


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """The rows of a node table that a selector matches, each once. Combinators are joins or windows within a document."""
    out = None
    groups = split_plain(selector, ",")
    for group in groups:
        parts = re.findall(r"\s*([>+~]|\s)\s*((?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|[^\s>+~\[(])+)", " " + group)
        now = None
        for combinator, compound in parts:
            step = _simple(nodes, nodes, compound)
            now = step if now is None else _related(step, now, combinator)
        out = now if out is None else out.unionByName(now)
    return out.dropDuplicates(["doc_id", "node_id"]) if len(groups) > 1 else out


def pick_position(found: DataFrame, name: str, k: int = 0) -> DataFrame:
    """:eq, :lt, :gt, :first, :last, :even and :odd over what a selector found in each document."""
    by = Window.partitionBy("doc_id")
    at, n = F.row_number().over(by.orderBy("node_id")) - 1, F.count("*").over(by)
    k = F.lit(k) if k >= 0 else n + k
    test = {"eq": at == k, "lt": at < k, "gt": at > k, "first": at == 0, "last": at == n - 1, "even": at % 2 == 0, "odd": at % 2 == 1}[name]
    return found.withColumn("_keep", test).where("_keep").drop("_keep")

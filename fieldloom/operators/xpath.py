"""XPath over a Document: the axes and predicates that extraction rules use.

Places count over a step's whole list of candidates, not per parent: //li[1] is the first li of the document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from ..plans.errors import RuleError
from ..plans.lexer import open_places, split_plain
from .dom import Document


@dataclass(frozen=True)
class Step:
    axis: str  # "child", "deep", "self", "parent", "attr", "text" or "string"
    name: str
    predicates: tuple[str, ...]


def _pieces(path: str) -> list[tuple[bool, str]]:
    """(whether // stands before it, step text) of each step."""
    out, start, deep, i = [], 0, False, 0
    places = set(open_places(path))
    while i <= len(path):
        if i == len(path) or (path[i] == "/" and i in places):
            if i > start:
                out.append((deep, path[start:i].strip()))
                deep = False
            if path[i : i + 2] == "//":
                deep, i = True, i + 1
            start = i + 1
        i += 1
    return out


@lru_cache(512)
def parse(path: str) -> tuple[Step, ...]:
    steps = []
    for deep, text in _pieces(path.strip()):
        name, predicates = text, []
        if "[" in text:
            name, rest = text[: text.index("[")].strip(), text[text.index("[") :]
            while rest:
                depth, quote = 0, ""
                for i, c in enumerate(rest):
                    if quote:
                        quote = "" if c == quote else quote
                    elif c in "'\"":
                        quote = c
                    elif c in "[]":
                        depth += 1 if c == "[" else -1
                        if depth == 0:
                            break
                if depth:
                    raise RuleError(f"invalid XPath: {path}")
                predicates.append(rest[1:i].strip())
                rest = rest[i + 1 :].strip()
        name = re.sub(r"^(child|descendant|self|parent|attribute)::", lambda m: {"attribute": "@"}.get(m[1], ""), name)
        axis = {".": "self", "..": "parent", "text()": "text", "string()": "string"}.get(name, "attr" if name.startswith("@") else "child")
        steps.append(Step("deep" if deep and axis == "child" else axis, name.lstrip("@").lower() if axis in ("attr", "child") else name, tuple(predicates)))
        if deep and axis not in ("child", "self"):
            steps.insert(len(steps) - 1, Step("deep", "*", ()))
    return tuple(steps)


def _matches(d: Document, n: int, name: str) -> bool:
    tag = d.tags[n]
    return name in ("*", "node()") or tag == name or tag.rpartition(":")[2] == name


def _value(d: Document, n: int, text: str, place: int, size: int):
    """The value of an operand: a string, a number, or None if there is none."""
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1]:
        return text[1:-1]
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text)
    if text in ("position()", "last()"):
        return float(place if text == "position()" else size)
    m = re.fullmatch(r"(last\(\)|position\(\))\s*([+-])\s*(\d+)", text)
    if m:
        return _value(d, n, m[1], place, size) + float(m[2] + m[3])
    m = re.fullmatch(r"(normalize-space|string|string-length|count)\((.*)\)", text)
    if m:
        if m[1] == "count":
            return float(len(evaluate(d, n, m[2])[1]))
        inner = d.text(n) if m[2].strip() in ("", ".") else _value(d, n, m[2], place, size) or ""
        return float(len(inner)) if m[1] == "string-length" else " ".join(str(inner).split())
    if text == ".":
        return d.text(n)
    if text == "text()":
        return d.own_text(n)
    if text.startswith("@") and "/" not in text:
        return d.attrs_of[n].get(text[1:].lower())
    kind, found = evaluate(d, n, text)
    return (found[0] if kind == "values" else d.text(found[0])) if found else None


def _split_word(text: str, word: str) -> list[str]:
    cuts, last = [], -1
    for i in open_places(text):
        if i > last and text.startswith(f" {word} ", i):
            cuts.append(i)
            last = i + len(word)
    begins = [0, *(c + len(word) + 2 for c in cuts)]
    return [text[a:b] for a, b in zip(begins, [*cuts, len(text)])]


def _holds(d: Document, n: int, condition: str, place: int, size: int) -> bool:
    condition = condition.strip()
    for word, join in (("or", any), ("and", all)):
        parts = _split_word(condition, word)
        if len(parts) > 1:
            return join(_holds(d, n, p, place, size) for p in parts)
    m = re.fullmatch(r"not\s*\((.*)\)", condition, re.DOTALL)
    if m:
        return not _holds(d, n, m[1], place, size)
    m = re.fullmatch(r"(contains|starts-with|ends-with)\s*\((.*)\)", condition, re.DOTALL)
    if m:
        a, b = (str(_value(d, n, x, place, size) or "") for x in split_plain(m[2], ","))
        return {"contains": b in a, "starts-with": a.startswith(b), "ends-with": a.endswith(b)}[m[1]]
    places = set(open_places(condition))
    m = next((m for m in re.finditer(r"!=|<=|>=|=|<|>", condition) if m.start() in places), None)
    if m:
        a, b = _value(d, n, condition[: m.start()], place, size), _value(d, n, condition[m.end() :], place, size)
        if a is None or b is None:
            return False
        if m[0] not in ("=", "!=") or isinstance(a, float) or isinstance(b, float):
            try:
                a, b = float(a), float(b)
            except ValueError:
                return m[0] == "!="
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[m[0]]
    found = _value(d, n, condition, place, size)
    return found == float(place) if isinstance(found, float) else found is not None and (condition[:1] == "@" or bool(found))


def _evaluate_one(d: Document, context: int, path: str) -> tuple[str, list]:
    nodes = [context]
    absolute = path.startswith("/")
    if absolute:
        nodes = [0]
    for step in parse(path):
        if step.axis == "attr":
            return "values", [v for n in nodes if (v := d.attrs_of[n].get(step.name)) is not None]
        if step.axis == "text":
            return "values", [v for n in nodes if (v := d.own_text(n))]
        if step.axis == "string":
            return "values", [d.text(n) for n in nodes]
        if step.axis == "self":
            found = nodes
        elif step.axis == "parent":
            found = [d.parents[n] for n in nodes if d.parents[n] > 0]
        else:
            found = [c for n in nodes for c in (d.below(n) if step.axis == "deep" else d.children(n)) if _matches(d, c, step.name)]
        nodes = sorted(set(found))
        for p in step.predicates:
            size = len(nodes)
            nodes = [n for i, n in enumerate(nodes, 1) if _holds(d, n, p, i, size)]
    return "nodes", nodes


def evaluate(d: Document, context: int, path: str) -> tuple[str, list]:
    """("nodes", numbers) or ("values", strings); unions of paths keep the document's order of nodes."""
    found = [_evaluate_one(d, context, p) for p in split_plain(path, "|")]
    if all(kind == "nodes" for kind, _ in found):
        return "nodes", sorted({n for _, nodes in found for n in nodes})
    return "values", [v if kind == "values" else d.text(v) for kind, values in found for v in values]

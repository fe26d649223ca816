"""CSS selectors over a Document, with the positional extensions of jQuery.

A selector compiles to groups of steps. A step narrows a set of nodes by its combinator and then by its tests. The last
tests may be positional; they then number the nodes that the whole group has selected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from ..plans.errors import RuleError
from ..plans.lexer import split_plain
from .dom import Document

Test = Callable[[Document, int], bool]
POSITIONAL = ("eq", "lt", "gt", "first", "last", "even", "odd")


@dataclass(frozen=True)
class Step:
    combinator: str  # "", " ", ">", "+" or "~"
    tests: tuple[Test, ...]


@dataclass(frozen=True)
class Group:
    steps: tuple[Step, ...]
    positions: tuple[tuple[str, int], ...]


def _unquote(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def nth(formula: str) -> Callable[[int], bool]:
    """The test of an+b, odd, even or a number on a place from 1."""
    text = formula.replace(" ", "").lower()
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    if re.fullmatch(r"[+-]?\d+", text):
        return lambda place: place == int(text)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text)
    if not m:
        raise RuleError(f"invalid position formula: {formula}")
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda place: (place == b) if a == 0 else ((place - b) % a == 0 and (place - b) // a >= 0)


def _attribute(body: str, dialect: str) -> Test:
    m = re.match(r"\s*([^\s=~|^$*!]+)\s*(?:([~|^$*!]?=)\s*(.*))?$", body, re.DOTALL)
    if not m:
        raise RuleError(f"invalid attribute test: [{body}]")
    name, op, wanted = m[1].lower(), m[2], _unquote(m[3] or "")
    if op is None:
        return lambda d, n: name in d.attrs_of[n]
    if op == "!=":
        if dialect == "full":
            return lambda d, n: d.attrs_of[n].get(name) != wanted
        return lambda d, n: name in d.attrs_of[n] and d.attrs_of[n][name] != wanted
    if op == "~=" and dialect == "full":
        pattern = re.compile(wanted)
        return lambda d, n: (v := d.attrs_of[n].get(name)) is not None and bool(pattern.search(v))
    compare: dict[str, Callable[[str], bool]] = {
        "=": lambda v: v == wanted,
        "*=": lambda v: wanted in v,
        "^=": lambda v: v.startswith(wanted),
        "$=": lambda v: v.endswith(wanted),
        "~=": lambda v: wanted in v.split(),
        "|=": lambda v: v == wanted or v.startswith(wanted + "-"),
    }
    holds = compare[op]
    return lambda d, n: (v := d.attrs_of[n].get(name)) is not None and holds(v)


def _place(of_type: bool, from_end: bool, holds: Callable[[int], bool]) -> Test:
    def test(d: Document, n: int) -> bool:
        row = [s for s in d.siblings(n) if not of_type or d.tags[s] == d.tags[n]]
        at = row.index(n)
        return holds(len(row) - at if from_end else at + 1)

    return test


def _only(of_type: bool) -> Test:
    return lambda d, n: [s for s in d.siblings(n) if not of_type or d.tags[s] == d.tags[n]] == [n]


def _pseudo(name: str, argument: str | None, dialect: str) -> Test:
    m = re.fullmatch(r"(first|last|only|nth|nth-last)-(child|of-type)", name)
    if m:
        of_type = m[2] == "of-type"
        if m[1] == "only":
            return _only(of_type)
        holds = nth(argument or "") if m[1].startswith("nth") else (lambda place: place == 1)
        return _place(of_type, m[1] in ("last", "nth-last"), holds)
    if name == "root":
        return lambda d, n: d.parents[n] == 0
    if name == "empty":
        return lambda d, n: not d.children(n) and not d.own_text(n)
    if name == "contains":
        wanted = _unquote(argument or "")
        return lambda d, n: wanted in d.text(n)
    if name == "has":
        inner = parse(argument or "*", dialect)
        return lambda d, n: bool(_selected(d, n, inner))
    if name == "not":
        inner = parse(argument or "*", dialect)
        return lambda d, n: not any(_ends_in(d, n, g) for g in inner)
    raise RuleError(f"unknown pseudo class :{name}")


def _closing(text: str, start: int, opening: str, closing: str) -> int:
    depth, quote = 0, ""
    for i in range(start, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if depth == 0:
                return i
    raise RuleError(f"unclosed {opening} in {text}")


def _group(text: str, dialect: str) -> Group:
    steps: list[Step] = []
    positions: list[tuple[str, int]] = []
    i, combinator, tests, seen = 0, "", [], False

    def finish() -> None:
        nonlocal tests, seen
        if seen:
            steps.append(Step(combinator if steps else "", tuple(tests)))
        tests, seen = [], False

    while i < len(text):
        c = text[i]
        if c.isspace() or c in ">+~":
            m = re.compile(r"\s*([>+~]?)\s*").match(text, i)
            finish()
            combinator = m[1] or " "
            i = m.end()
            continue
        seen = True
        if c == "[":
            end = _closing(text, i, "[", "]")
            tests.append(_attribute(text[i + 1 : end], dialect))
            i = end + 1
            continue
        m = re.compile(r"([.#:]?)((?:\\.|[\w\-]|[^\x00-\x7f])+|\*)").match(text, i)
        if not m:
            raise RuleError(f"invalid selector: {text}")
        kind, name = m[1], re.sub(r"\\(.)", r"\1", m[2])
        i = m.end()
        if kind == ":":
            argument = None
            if i < len(text) and text[i] == "(":
                end = _closing(text, i, "(", ")")
                argument, i = text[i + 1 : end], end + 1
            name = name.lower()
            if name in POSITIONAL:
                positions.append((name, int(argument or 0)))
            else:
                tests.append(_pseudo(name, argument, dialect))
        elif kind == ".":
            tests.append(lambda d, n, name=name: name in d.classes(n))
        elif kind == "#":
            tests.append(lambda d, n, name=name: d.attrs_of[n].get("id") == name)
        elif name != "*":
            tests.append(lambda d, n, name=name.lower(): d.tags[n] == name)
    finish()
    if not steps:
        raise RuleError(f"empty selector: {text!r}")
    return Group(tuple(steps), tuple(positions))


@lru_cache(512)
def parse(selector: str, dialect: str = "full") -> tuple[Group, ...]:
    return tuple(_group(part, dialect) for part in split_plain(selector, ","))


def _ends_in(d: Document, node: int, group: Group) -> bool:
    """Whether a node is what the group's steps lead to; ancestors may lie above any context."""

    def reaches(n: int, k: int) -> bool:
        step = group.steps[k]
        if not all(t(d, n) for t in step.tests):
            return False
        if k == 0:
            return True
        if step.combinator in (">", " "):
            up = d.parents[n]
            while up > 0:
                if reaches(up, k - 1):
                    return True
                if step.combinator == ">":
                    break
                up = d.parents[up]
            return False
        row = d.siblings(n)
        before = row[: row.index(n)]
        return any(reaches(s, k - 1) for s in (before[-1:] if step.combinator == "+" else before))

    return reaches(node, len(group.steps) - 1)


def _selected(d: Document, context: int, groups: Iterable[Group]) -> list[int]:
    out: dict[int, None] = {}
    for g in groups:
        found = [n for n in d.below(context) if _ends_in(d, n, g)]
        for name, k in g.positions:
            k = k + len(found) if k < 0 else k
            found = {"eq": found[k : k + 1] if k >= 0 else [], "lt": found[: max(k, 0)], "gt": found[k + 1 :], "first": found[:1], "last": found[-1:], "even": found[::2], "odd": found[1::2]}[name]
        out |= dict.fromkeys(found)
    return list(out)


def select(d: Document, context: int, selector: str, dialect: str = "full") -> list[int]:
    """Nodes below context, each once: in document order ("full"), or group by group ("strict")."""
    found = _selected(d, context, parse(selector, dialect))
    return sorted(found) if dialect == "full" else found

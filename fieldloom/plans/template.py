"""Templates as trees: the literal parts of a text and the holes between them, found in one scan.

{{...}} is an expression; in the full dialect @get:{name} is a stored value and {$.path} a path into JSON content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Hole:
    """An expression, with every reading that its form allows; which one holds depends on what there is at run time."""

    source: str
    #: Names to walk along from a variable: root.path[0].
    steps: tuple[str, ...] = ()
    #: How far from the current page.
    shift: int | None = None
    quoted: str | None = None


@dataclass(frozen=True)
class Stored:
    name: str


@dataclass(frozen=True)
class Embedded:
    path: str


Part = str | Hole | Stored | Embedded


@lru_cache(2048)
def hole(expression: str) -> Hole:
    source = expression.strip()
    if len(source) > 1 and source[0] == source[-1] and source[0] in "'\"":
        return Hole(source, quoted=source[1:-1])
    if shift := re.fullmatch(r"page\s*(?P<sign>[-+])\s*(?P<far>\d+)", source):
        return Hole(source, shift=int(shift["far"]) * (1 if shift["sign"] == "+" else -1))
    names = source.replace("[", ".").replace("]", ".").split(".")
    return Hole(source, tuple(filter(None, names)) if "." in source else ())


def _hole_at(text: str, at: int, full: bool) -> tuple[Part, int] | None:
    """The hole that starts here and where it ends."""
    if text.startswith("{{", at):
        first = end = text.find("}}", at + 2)
        while end >= 0 and text.count("{", at + 2, end) > text.count("}", at + 2, end):  # a brace that is opened within is closed within
            end = text.find("}}", end + 1)
        end = end if end >= 0 else first
        return (hole(text[at + 2 : end]), end + 2) if end >= 0 else None
    if not full:
        return None
    if text[at : at + 6].lower() == "@get:{":
        end = text.find("}", at + 6)
        name = text[at + 6 : end].strip()
        return (Stored(name.removeprefix(name[:1] if name[:1] in "'\"" else "").removesuffix(name[-1:] if name[-1:] in "'\"" else "")), end + 1) if end >= 0 else None
    if text.startswith(("{$.", "{$["), at):
        end = text.find("}", at)
        return (Embedded(text[at + 1 : end]), end + 1) if end >= 0 and "{" not in text[at + 1 : end] else None
    return None


@lru_cache(2048)
def parts(text: str, full: bool) -> tuple[Part, ...]:
    """Literals and holes in turn; a sign that opens no hole is part of a literal."""
    found: list[Part] = []
    at = done = 0
    while at < len(text):
        hit = _hole_at(text, at, full) if text[at] in "{@" else None
        if hit is None:
            at += 1
            continue
        found += [text[done:at], hit[0]] if at > done else [hit[0]]
        at = done = hit[1]
    return tuple([*found, text[done:]] if done < len(text) else found)

"""Rules as trees: what a rule string means, before any document is there.

dialect "strict" has selectors, JSON paths, regular expressions, templates and replacements; "full" adds XPath, the
leading -, + and :, @put and @get, and inline rules in templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .errors import UnsupportedRule
from .lexer import COMBINATORS, split

SCRIPT = ("<js>", "@js:", "@webjs:")


@dataclass(frozen=True)
class Text:
    """A literal."""

    value: str


@dataclass(frozen=True)
class Pattern:
    """All matches of a regular expression, or their first group."""

    pattern: str


@dataclass(frozen=True)
class Json:
    path: str


@dataclass(frozen=True)
class Css:
    selector: str
    mode: str


@dataclass(frozen=True)
class Chain:
    """Selectors one within the other, and what to read in the end."""

    steps: tuple[str, ...]
    mode: str


@dataclass(frozen=True)
class XPath:
    path: str


@dataclass(frozen=True)
class Templated:
    """A rule with {{...}} or @get:{...} in it; its meaning depends on the row."""

    source: str


@dataclass(frozen=True)
class Replace:
    base: Rule
    pattern: str
    replacement: str
    first: bool


@dataclass(frozen=True)
class Combine:
    operator: str
    parts: tuple[Rule, ...]


@dataclass(frozen=True)
class Reverse:
    base: Rule


@dataclass(frozen=True)
class Put:
    """Evaluates named rules into the row's variables, then the base."""

    names: tuple[tuple[str, Rule], ...]
    base: Rule | None


@dataclass(frozen=True)
class Script:
    """A script, applied to the values of base if there is one; values of then are read from its result."""

    code: str
    base: Rule | None = None


Rule = Text | Pattern | Json | Css | Chain | XPath | Templated | Replace | Combine | Reverse | Put | Script


def selector_and_mode(expression: str) -> tuple[str, str]:
    selector, at, mode = expression.rpartition("@")
    return (selector.strip(), mode.strip() or "text") if at else (expression.strip(), "text")


def simple(rule: str, dialect: str) -> Rule:
    """A rule without combinators, replacements and templates."""
    lowered = rule.lower()
    if lowered.startswith(SCRIPT):
        code = re.sub(r"^<js>|</js>\s*$|^@(web)?js:", "", rule, flags=re.IGNORECASE)
        return Script(code.strip())
    if lowered.startswith("@xpath:") or rule.startswith("/") and (dialect == "full" or not rule.startswith("//")):
        if dialect == "strict":
            raise UnsupportedRule("XPath source rule")
        return XPath(rule[7:].strip() if lowered.startswith("@xpath:") else rule)
    if lowered.startswith("@text:"):
        return Text(rule[6:])
    if lowered.startswith("@regex:"):
        return Pattern(rule[7:])
    if dialect == "full" and rule.startswith(":"):
        return Pattern(rule[1:])
    if lowered.startswith("@json:") or rule.startswith("$"):
        return Json(rule)
    if lowered.startswith("@css:"):
        return Css(*selector_and_mode(rule[5:]))
    if rule.startswith("@@"):
        return Css(*selector_and_mode(rule[2:]))
    steps = [s.strip() for s in rule.split("@")]
    return Chain(tuple(steps[:-1]), steps[-1]) if len(steps) > 1 else Chain((steps[0],), "text")


_PUT = re.compile(r"@put:\{((?:[^{}]|\{[^{}]*\})*)\}", re.IGNORECASE)
_INLINE_SCRIPT = re.compile(r"<js>(.*?)</js>|@js:(.*)$", re.IGNORECASE | re.DOTALL)


@lru_cache(2048)
def parse(rule: str, dialect: str = "full") -> Rule | None:
    """The tree of a rule; None for a blank one."""
    if not rule or not rule.strip():
        return None
    if dialect == "full":
        puts = _PUT.findall(rule)
        if puts:
            names = []
            for body in puts:
                for entry in split(body, (",",))[0]:
                    name, _, value = entry.partition(":")
                    names.append((name.strip().strip("'\""), parse(value.strip().strip("'\""), dialect)))
            return Put(tuple((n, r) for n, r in names if r is not None), parse(_PUT.sub("", rule), dialect))
        stripped = rule.strip()
        if stripped[0] in "+-" and len(stripped) > 1:
            base = parse(stripped[1:], dialect)
            return Reverse(base) if stripped[0] == "-" and base is not None else base
        script = _INLINE_SCRIPT.search(rule)
        if script and rule[: script.start()].strip():
            return Script((script[1] or script[2] or "").strip(), parse(rule[: script.start()], dialect))
    parts, operator = split(rule, COMBINATORS)
    if operator and len(parts) > 1:
        return Combine(operator, tuple(parse(p, dialect) or Text("") for p in parts))
    pieces, _ = split(rule, ("##",))
    base = pieces[0]
    if "{{" in base or dialect == "full" and re.search(r"@get:\{", base, re.IGNORECASE) or dialect == "full" and re.search(r"\{\$[.\[]", base):
        tree: Rule = Templated(base)
    else:
        tree = simple(base, dialect) if base else Text("")
    if len(pieces) > 1:
        tree = Replace(tree, pieces[1], pieces[2] if len(pieces) > 2 else "", len(pieces) > 3)
    return tree


def uses_markup(tree: Rule | None) -> bool:
    """Whether a tree reads HTML nodes (so that parsing the document once serves many rules)."""
    if isinstance(tree, (Css, Chain, XPath, Templated, Script)):
        return True
    if isinstance(tree, (Replace, Reverse)):
        return uses_markup(tree.base)
    if isinstance(tree, Combine):
        return any(map(uses_markup, tree.parts))
    return isinstance(tree, Put)

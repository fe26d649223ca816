"""Scanning of rule strings: where operators stand outside quotes, brackets and escapes."""

from __future__ import annotations

from collections.abc import Iterator

COMBINATORS = ("||", "&&", "%%")
_CLOSING = {"]": "[", ")": "(", "}": "{"}


def open_places(text: str) -> Iterator[int]:
    """Places that nothing shields: neither quotes nor brackets nor a backslash before them."""
    depth = dict.fromkeys("[({", 0)
    quote, skip = "", False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            if c in depth:
                depth[c] += 1
            elif c in _CLOSING:
                depth[_CLOSING[c]] = max(0, depth[_CLOSING[c]] - 1)
            if not any(depth.values()):
                yield i


def tidy(part: str) -> str:
    """A part without the space around it; what follows @text: is data and stays."""
    return part.lstrip() if part.strip().lower().startswith("@text:") else part.strip()


def split(text: str, operators: tuple[str, ...]) -> tuple[list[str], str | None]:
    """The parts between the operator that comes first outside all shields, and that operator; others stay in the parts."""
    found, cuts, free = None, [], 0
    for i in open_places(text):
        if i < free:
            continue
        hit = next((o for o in operators if text.startswith(o, i)), None)
        if hit and found in (None, hit):
            found = hit
            cuts.append(i)
            free = i + len(hit)
    if found is None:
        return [tidy(text)], None
    begins = [0, *(c + len(found) for c in cuts)]
    return [tidy(text[a:b]) for a, b in zip(begins, [*cuts, len(text)])], found


def split_plain(text: str, separator: str) -> list[str]:
    """All parts between unshielded separators, stripped."""
    return split(text, (separator,))[0]

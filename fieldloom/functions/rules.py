"""What a rule's text says about how it must be run, as columns: for planners that choose among sources and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a script begins, and what reads or writes a row's variables (fixed values).
SCRIPT_MARKS = ("<js>", "@js:", "@webjs:")
STATE_MARKS = ("@put:", "@get:")
#: Fields that details of a book are read by, and rules that run before them (fixed values).
DETAIL_FIELDS = ("name", "author", "intro", "kind", "lastChapter", "updateTime", "coverUrl", "wordCount", "tocUrl")
INIT_RULES = ("init", "bookInfoInit")


def _lowered(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_script(c: Column | str) -> Column:
    """Whether a rule is a script as a whole."""
    return _any([F.trim(_lowered(c)).startswith(m) for m in SCRIPT_MARKS])


def runs_script(c: Column | str) -> Column:
    """Whether there is a script anywhere in a rule."""
    return _any([_lowered(c).contains(m) for m in SCRIPT_MARKS])


def touches_state(c: Column | str) -> Column:
    """Whether running a rule may read or change anything but its document: it has a script, or names variables."""
    return runs_script(c) | _any([_lowered(c).contains(m) for m in STATE_MARKS])


def is_plain_name(c: Column | str) -> Column:
    """Whether a rule is one bare name, such as text or href, which may be read off an element that is selected already."""
    text = F.regexp_replace(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "^[+-]", "")
    return text.rlike(r"^[A-Za-z][\w:-]*$")


def details_known(book_url: Column | str, toc_url: Column | str, rules: Column | str) -> Column:
    """Whether a book's own details may stand for those of its page: it has both URLs, and its source's rules for details (a
    map, or null) neither narrow the page first nor touch anything else."""
    filled = lambda c: F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) != ""
    rules = F.col(rules) if isinstance(rules, str) else rules
    of = lambda name: F.element_at(rules, name)
    return filled(book_url) & filled(toc_url) & ~_any([filled(of(r)) for r in INIT_RULES]) & ~_any([touches_state(of(f)) for f in DETAIL_FIELDS])

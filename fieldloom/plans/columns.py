"""Rules as columns: in the JVM where Spark can express them, else in one Arrow UDF for all rules of a select."""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import Content, Context, Evaluator, Node, child_context
from . import rule as R
from . import template
from .errors import RuleError

LIST = "array<string>"


def _empty() -> Column:
    return F.array().cast(LIST)


def _dropped(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def java_replacement(text: str) -> str:
    """$1, $& and $$ as Java takes them."""
    return re.sub(r"\$(\$|&)|\\", lambda m: {"$$": r"\$", "$&": "$0", "\\": r"\\"}[m[0]], text)


def replaced(value: Column, pattern: str, replacement: str, first: bool) -> Column | None:
    """A replacement as a column. Without special characters it is a plain one; a first-only one is anchored at the
    start and takes along what is before the match, which needs a pattern without anchors, look-behind and references."""
    plain = not re.search(r"[\\^$.|?*+()\[\]{}]", pattern)
    if not first:
        if plain and pattern and not re.search(r"[$\\]", replacement):
            return F.replace(value, F.lit(pattern), F.lit(replacement))
        return F.regexp_replace(value, pattern, java_replacement(replacement))
    if re.search(r"\\[1-9AbBGzZ]|\^|\$|\(\?", pattern):
        return None
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 2}", replacement.replace("$$", "\0")).replace("$&", "$2").replace("\0", r"\$")
    return F.regexp_replace(value, rf"\A((?s:.*?))({pattern})", "$1" + shifted)


def lower(content: Column, tree: R.Rule | None, context: Context) -> Column | None:
    """The list of a rule's values without Python, or None if it takes Python."""
    if tree is None:
        return _empty()
    if isinstance(tree, R.Text):
        return F.array(F.lit(tree.value)) if tree.value else _empty()
    if isinstance(tree, R.Templated):
        values, parts = context.values(), template.parts(tree.source, True)
        if not all(isinstance(p, str) or isinstance(p, template.Hole) and isinstance(values.get(p.source), (str, int)) for p in parts):
            return None
        text = "".join(p if isinstance(p, str) else str(values[p.source]) for p in parts)
        return lower(content, R.parse(text, "strict") if text.lower().startswith("@text:") else R.Text(text), context)
    if isinstance(tree, R.Pattern):
        pattern = "(?s)" + tree.pattern
        try:
            groups = re.compile(tree.pattern).groups
        except re.error:
            return None
        return _dropped(F.regexp_extract_all(content, F.lit(pattern), F.lit(1 if groups else 0)))
    if isinstance(tree, R.Json):
        path = re.sub(r"^@json:\s*", "", tree.path, flags=re.IGNORECASE)
        path = path if path.startswith("$") else "$." + path
        if not re.fullmatch(r"\$(\.[A-Za-z_][\w]*)+", path):
            return None
        found = F.get_json_object(content, path)
        return _dropped(F.array(found))
    if isinstance(tree, R.Replace):
        base = lower(content, tree.base, context)
        if base is None or replaced(content, tree.pattern, tree.replacement, tree.first) is None:
            return None
        return _dropped(F.transform(base, lambda v: replaced(v, tree.pattern, tree.replacement, tree.first)))
    if isinstance(tree, R.Reverse):
        base = lower(content, tree.base, context)
        return None if base is None else F.reverse(base)
    if isinstance(tree, R.Combine):
        parts = [lower(content, p, context) for p in tree.parts]
        if any(p is None for p in parts):
            return None
        return combined(tree.operator, parts)
    return None


def combined(operator: str, parts: list[Column]) -> Column:
    """Lists of values joined by || (the first that isn't empty), && (one string) or %% (in turn)."""
    if operator == "||":
        return F.coalesce(*[F.when(F.size(p) > 0, p) for p in parts], _empty())
    if operator == "&&":
        return F.array(F.array_join(F.concat(*parts), ""))
    longest = F.greatest(*[F.size(p) for p in parts], F.lit(1))
    turns = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.array(*[F.get(p, i) for p in parts]))
    return F.filter(F.flatten(turns), lambda v: v.isNotNull())


def _context(ctx: Mapping[str, Any] | Context | None) -> Context:
    if isinstance(ctx, Context):
        return ctx
    ctx = dict(ctx or {})
    known = {k: ctx.pop(k) for k in ("key", "page", "base_url", "result") if k in ctx}
    return Context(**known, variables=ctx.pop("variables", {}) | ctx)


def _guarded(on_error: str, otherwise: Any, f, *args):
    try:
        return f(*args)
    except RuleError:
        if on_error == "raise":
            raise
        return otherwise


def rule_list(col: Column | str, rule: str, ctx=None, *, dialect: str = "full", on_error: str = "raise") -> Column:
    """The ordered values of a rule for each document. A null document counts as empty. on_error: "raise" or "null"."""
    content, context = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), _context(ctx)
    found = lower(content, R.parse(rule, dialect), context)
    if found is not None:
        return found

    e = Evaluator(dialect)

    @F.pandas_udf(LIST)
    def evaluate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _guarded(on_error, None, e.parse_list, t, rule, child_context(context)))

    return evaluate(content)


def rule_text(col: Column | str, rule: str, ctx=None, **options) -> Column:
    """The values of a rule joined by line ends."""
    return F.array_join(rule_list(col, rule, ctx, **options), "\n")


def apply_text_rule(col: Column | str, rule: str, ctx=None, *, dialect: str = "full") -> Column:
    """A replacement over whole texts, whose lines are trimmed first; in the JVM unless it has a base rule, a template or can't be anchored."""
    from .lexer import split

    content = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    if not rule.strip():
        return content
    pieces, _ = split(rule, ("##",))
    if not pieces[0] and "{{" not in rule and len(pieces) > 1:
        lines = F.split(F.regexp_replace(content, r"\r\n|\r", "\n"), "\n")
        text = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
        first = len(pieces) > 3
        out = replaced(text, pieces[1], pieces[2] if len(pieces) > 2 else "", first)
        if out is not None:
            return F.when(text.rlike(pieces[1]), out).otherwise("") if first else out
    context = _context(ctx)

    e = Evaluator(dialect)

    @F.pandas_udf("string")
    def evaluate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: e.apply_text_rule(t, rule, child_context(context)))

    return evaluate(content)


def _row_json(row: Any) -> str:
    return row.get("all") if isinstance(row, Node) else json.dumps(row, ensure_ascii=False)


def rule_elements(df: DataFrame, col: str, rule: str, *, ctx=None, dialect: str = "full") -> DataFrame:
    """A row for each node (as HTML) or value (as JSON) that a list rule yields, with its ordinal; all columns of df stay."""
    context = _context(ctx)

    e = Evaluator(dialect)

    @F.pandas_udf(LIST)
    def evaluate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [_row_json(r) for r in e.elements(t, rule, child_context(context))])

    return df.select("*", F.posexplode(evaluate(F.coalesce(F.col(col), F.lit("")))).alias("ordinal", "element"))


ROWS = "array<struct<ordinal: int, fields: array<string>, errors: array<string>>>"


def extracted(e: Evaluator, text: str, fields: Mapping[str, str], list_rule: str | None, context: Context, on_error: str, optional: Collection[str] | None = None) -> list[dict]:
    """The rows of one document: values of the fields in order, for the document or for each element of the list rule. Of the
    optional fields one that fails isn't tried again in the document: it is null from there on, and its error is in the row
    where it failed."""
    base = child_context(context)
    document = Content(text)
    items = [document] if list_rule is None else e.elements(document, list_rule, base)
    out, stopped = [], set()
    for i, item in enumerate(items):
        own, values, errors = child_context(base), [], []
        held = item if isinstance(item, Content) else Content(item)
        for name, rule in fields.items():
            if name in stopped:
                values.append(None)
                continue
            try:
                values.append(e.field(item, rule, own) if isinstance(item, list) else e.parse_text(held, rule, own))
            except RuleError as err:
                if on_error == "raise":
                    raise
                values.append(None)
                errors.append(f"{name}: {err}")
                if optional is not None and name in optional:
                    stopped.add(name)
        out.append({"ordinal": i, "fields": values, "errors": errors})
    return out


def extract(df: DataFrame, col: str, fields: Mapping[str, str], list_rule: str | None = None, *, ctx: Mapping | None = None, keep: list[str] | None = None, dialect: str = "full", on_error: str = "raise", optional: Collection[str] | None = None) -> DataFrame:
    """Columns keep (default: all of df), then a string column for each field; with list_rule a row for each element, and its ordinal.

    One pass parses each document once for all fields. Fields are evaluated in order, so a variable that one puts is there
    for those after it. on_error: "raise"; "null" makes a failed field null; "column" adds the messages in `errors`. A field
    in `optional` that fails isn't tried again in the rest of its document."""
    context = _context(ctx)
    keep = df.columns if keep is None else keep

    e = Evaluator(dialect)

    @F.pandas_udf(ROWS)
    def evaluate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: extracted(e, text, fields, list_rule, context, on_error, optional))

    made = df.select(*[F.col(f"`{k}`") for k in keep], F.explode(evaluate(F.coalesce(F.col(col), F.lit("")))).alias("_row"))
    columns = [F.col("_row.fields")[i].alias(n) for i, n in enumerate(fields)]
    ordinal = [F.col("_row.ordinal").alias("ordinal")] if list_rule is not None else []
    errors = [F.col("_row.errors").alias("errors")] if on_error == "column" else []
    return made.select(*[F.col(f"`{k}`") for k in keep], *ordinal, *columns, *errors)

"""URLs: absolute forms, options behind a URL, page lists, data URIs."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPTIONS = r",\s*(\{.*\})\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_options(c: Column | str) -> Column:
    """A struct of url and options: what follows the URL as ,{...}, with typographic quotes made straight; null without."""
    text = F.trim(F.coalesce(_c(c), F.lit("")))
    options = F.translate(F.regexp_extract(text, "(?s)" + _OPTIONS, 1), "“”‘’", "\"\"''")
    return F.struct(F.trim(F.regexp_replace(text, "(?s)" + _OPTIONS, "")).alias("url"), F.nullif(options, F.lit("")).alias("options"))


def _direct(base: Column, link: Column) -> Column:
    """link seen from base where that takes no resolver: absolute, protocol-relative, root-relative and data: links; else null."""
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*:)//", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*://[^/?#]*)", 1)
    fast = F.when(link == "", "").when(link.rlike(r"^[a-zA-Z][\w+.\-]*:"), link)
    return fast.when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link))


def absolute_url(base: Column | str, link: Column | str) -> Column:
    """link seen from base. What takes no resolver stays in the JVM; the rest is resolved in an Arrow UDF. Options behind the
    link stay behind it."""
    base, link = F.coalesce(_c(base), F.lit("")), F.trim(F.coalesce(_c(link), F.lit("")))

    @F.pandas_udf("string")
    def resolve(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([_join(b, x) for b, x in zip(bases, links)])

    # a UDF runs for every row that reaches it: rows of the other cases give it nothing to do
    slow = F.when(link.rlike(r"^(?![a-zA-Z][\w+.\-]*:)(?!/)."), link)
    return F.coalesce(_direct(base, link), resolve(base, slow))


def absolute_urls(base: Column | str, links: Column | str) -> Column:
    """A list of links seen from base, each once and blank ones left out; only lists with a link that takes a resolver are
    handed to Python."""
    base = F.coalesce(_c(base), F.lit(""))
    links = F.filter(F.transform(F.coalesce(_c(links), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    fast = F.transform(links, lambda x: _direct(base, x))

    @F.pandas_udf("array<string>")
    def resolve(bases: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if found is None else [_join(b, x) for x in found] for b, found in zip(bases, lists)])

    slow = F.exists(fast, lambda x: x.isNull())
    return F.array_distinct(F.when(slow, resolve(base, F.when(slow, links))).otherwise(fast))


def _join(base: str, link: str | None) -> str | None:
    if link is None:
        return None
    m = re.search(_OPTIONS, link, re.DOTALL)
    tail = link[m.start() :] if m else ""
    return urljoin(base, link[: len(link) - len(tail)]) + tail


def encode_uri(c: Column | str, charset: str = "utf-8") -> Column:
    """Percent-encoding in which a space is %20."""
    if charset.lower() in ("utf-8", "utf8"):
        return F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20"))

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else quote(v.encode(charset, "replace"), safe=""))

    return convert(_c(c))


def choose_page(c: Column | str, page: Column | int) -> Column:
    """A URL in which <a,b,c> stands for the page's choice; the last choice serves all further pages."""
    text = _c(c)
    choices = F.split(F.regexp_extract(text, r"<([^<>]*)>", 1), ",")
    page = F.lit(page) if isinstance(page, int) else page
    chosen = F.trim(F.element_at(choices, F.greatest(F.lit(1), F.least(page, F.size(choices))).cast("int")))
    found = F.regexp_extract(text, r"<[^<>]*>", 0)
    return F.when(found == "", text).otherwise(F.replace(text, found, chosen))


def data_uri(c: Column | str) -> Column:
    """The bytes of a data: URI, in base64 or percent-encoded; null for others."""
    text = _c(c)
    head, body = F.regexp_extract(text, r"(?s)^data:([^,]*),", 1), F.regexp_extract(text, r"(?s)^data:[^,]*,(.*)$", 1)
    return F.when(~text.startswith("data:"), None).when(head.contains(";base64"), F.try_to_binary(body, F.lit("base64"))).otherwise(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary"))

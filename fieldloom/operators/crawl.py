"""Source definitions applied to fetched pages: search, details, paginated lists and contents.

A page is a row of pages(url, html); fetching is a join. Pagination is a frontier: a table of what is pending, joined
with pages level by level, with the pages seen so far left out. A single next link is followed on; several are pages of
their own and their next links aren't followed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.content import clean_lines, html_to_text, without_title
from ..functions.text import bool_value
from ..functions.urls import absolute_url, absolute_urls, split_options
from ..plans.columns import ROWS, extract, extracted, rule_list
from ..plans.errors import RuleError
from .search import MOST_PAGES, cap_per_source
from .evaluate import Content, Context, Evaluator, child_context
from .staging import kept

HIT_FIELDS = ("name", "author", "bookUrl", "coverUrl", "intro", "kind", "lastChapter", "updateTime", "wordCount", "tocUrl")
LIGHT_FIELDS = ("name", "author", "bookUrl", "lastChapter", "tocUrl")
#: Fields that a hit may lack: all but its name and address.
OPTIONAL_FIELDS = tuple(f for f in HIT_FIELDS if f not in ("name", "bookUrl"))
INFO_FIELDS = ("name", "author", "intro", "kind", "lastChapter", "updateTime", "coverUrl", "wordCount", "tocUrl")
#: Pages that one list or content may have (fixed values).
LIST_PAGES, CONTENT_PAGES = 50, 20


def search_url(template: str, keyword: str, page: int = 1) -> str:
    """The URL that a source's template gives for a keyword and page; <a,b> is a list of pages."""
    url = Evaluator("full").expand(template, Content(""), Context(key=quote(keyword), page=page))
    return re.sub(r"<([^<>]*)>", lambda m: (choices := m[1].split(","))[min(max(page, 1), len(choices)) - 1].strip(), url)


def fetch(wanted: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """wanted joined with the pages that were fetched; what isn't there has a null html."""
    found = pages.select(F.col("url").alias("_url"), "html")
    return wanted.join(found, F.col(url) == F.col("_url"), "left").drop("_url")


#: Steps that a redirection may have (fixed value), and status codes that are one.
MOST_REDIRECTS, REDIRECTS = 5, (301, 302, 303, 307, 308)


def fetch_responses(wanted: DataFrame, fetched: DataFrame, url: str = "url") -> DataFrame:
    """wanted with a struct `response` (url, method, status, ok, headers, charset, text), null where nothing was fetched.

    A wanted URL may have options behind it, of which the method counts (GET without). fetched has url, method, status,
    headers (a map) and body (bytes). Redirections are followed by joins, up to MOST_REDIRECTS; one more is not ok. The
    body is decoded as its content type says, else as UTF-8."""
    asked = wanted.withColumn("_o", split_options(F.col(url)))
    asked = asked.withColumns({"_at": F.col("_o.url"), "_method": F.upper(F.coalesce(F.get_json_object("_o.options", "$.method"), F.lit("GET")))}).drop("_o")
    answers = fetched.select(F.col("url").alias("_u"), F.upper("method").alias("_m"), "status", F.transform_keys("headers", lambda k, v: F.lower(k)).alias("headers"), "body")
    where = F.element_at("headers", "location")
    hops = answers.where(F.col("status").isin(*REDIRECTS) & where.isNotNull()).select("_u", "_m", absolute_url(F.col("_u"), where).alias("_next"), F.when(F.col("status") == 303, "GET").otherwise(F.col("_m")).alias("_as"))
    for _ in range(MOST_REDIRECTS):
        asked = asked.join(hops, (F.col("_at") == F.col("_u")) & (F.col("_method") == F.col("_m")), "left")
        asked = asked.withColumns({"_at": F.coalesce("_next", "_at"), "_method": F.coalesce("_as", "_method")}).drop("_u", "_m", "_next", "_as")
    found = asked.join(answers, (F.col("_at") == F.col("_u")) & (F.col("_method") == F.col("_m")), "left")
    charset = F.lower(F.coalesce(F.nullif(F.regexp_extract(F.element_at("headers", "content-type"), r"(?i)charset=[\"']?([\w-]+)", 1), F.lit("")), F.lit("utf-8")))

    @F.pandas_udf("string")
    def decoded(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else _decoded(bytes(b), n) for b, n in zip(bodies, names)], dtype=object)

    response = F.struct(F.col("_at").alias("url"), F.col("_method").alias("method"), "status", F.col("status").between(200, 299).alias("ok"), "headers", charset.alias("charset"), decoded("body", charset).alias("text"))
    return found.withColumn("response", F.when(F.col("status").isNotNull(), response)).select(*wanted.columns, "response")


def _decoded(body: bytes, charset: str) -> str:
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def extract_books(pages: DataFrame, rules: Mapping[str, str], list_field: str = "bookList", light: bool = False, keep: Iterable[str] = ("url",)) -> DataFrame:
    """Hits on result pages: a row for each element of the list rule with a name and a book URL. Another field that fails is null
    from there on, and isn't tried again on its page. A hit without a list of chapters has its own page for one."""
    fields = {f: rules[f] for f in (LIGHT_FIELDS if light else HIT_FIELDS) if rules.get(f)}
    rows = extract(pages, "html", fields, rules[list_field], keep=list(keep), on_error="null", optional=OPTIONAL_FIELDS)
    rows = rows.withColumns({f: F.lit(None).cast("string") for f in (LIGHT_FIELDS if light else HIT_FIELDS) if f not in fields})
    rows = rows.where((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.coalesce("bookUrl", F.lit("")) != ""))
    if "tocUrl" in fields:
        rows = rows.withColumn("tocUrl", F.coalesce(F.nullif("tocUrl", F.lit("")), F.col("bookUrl")))
    return rows.withColumns({f: absolute_url("url", f) for f in ("bookUrl", "coverUrl", "tocUrl") if f in fields})


def failed_fields(pages: DataFrame, rules: Mapping[str, str], list_field: str = "bookList", keep: Iterable[str] = ("url",)) -> DataFrame:
    """(keep, field, item, error): where each optional field of a page's hits failed first, with the item's number from 0; it was
    left out from there on."""
    fields = {f: rules[f] for f in HIT_FIELDS if rules.get(f)}
    rows = extract(pages, "html", fields, rules[list_field], keep=list(keep), on_error="column", optional=OPTIONAL_FIELDS)
    said = rows.select(*keep, F.col("ordinal").alias("item"), F.explode("errors").alias("e"))
    said = said.select(*keep, F.substring_index("e", ":", 1).alias("field"), "item", F.regexp_replace("e", r"^[^:]*: ", "").alias("error"))
    return said.where(F.col("field").isin(*OPTIONAL_FIELDS))


def search_all(sources: DataFrame, pages: DataFrame, keyword: str, page: int = 1) -> DataFrame:
    """Hits of all sources for a keyword, with source, page, arrival and error; any number of sources is one plan.

    sources has bookSourceName, searchUrl and rules (ruleSearch as JSON), in the order of `pos` if it has that. Their result
    pages are joined in, and each is read by its own source's rules. A source fails softly: a page that isn't there, or
    that the rules can't read, is one row without a hit and with the error. Pages after MOST_PAGES aren't asked for."""
    if not 1 <= page <= MOST_PAGES:
        raise RuleError(f"a search has {MOST_PAGES} pages")
    order = F.col("pos").cast("long") if "pos" in sources.columns else F.lit(0).cast("long")

    @F.pandas_udf("url string, error string")
    def asked(templates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tried(lambda x=x: (search_url(x, keyword, page), None)) for x in templates], columns=["url", "error"])

    wanted = sources.select(F.col("bookSourceName").alias("source"), order.alias("source_pos"), "rules", asked("searchUrl").alias("u")).select("source", "source_pos", "rules", "u.*")
    rows = fetch(wanted, pages)

    e = Evaluator("full")

    @F.pandas_udf("rows " + ROWS + ", error string")
    def hits(htmls: pd.Series, rules: pd.Series, errors: pd.Series) -> pd.DataFrame:
        out = []
        for html, rule, error in zip(htmls, rules, errors):
            if error is not None or html is None:
                out.append(([], error or "no page"))
                continue
            own = json.loads(rule)
            found, error = _tried(lambda own=own, html=html: (extracted(e, html, {f: own.get(f) or "" for f in HIT_FIELDS}, own["bookList"], Context(), "null", OPTIONAL_FIELDS), None))
            out.append((found or [], error))
        return pd.DataFrame(out, columns=["rows", "error"])

    found = rows.select("source", "source_pos", "url", hits("html", "rules", "error").alias("h"))
    found = found.select("source", "source_pos", "url", "h.error", F.explode_outer("h.rows").alias("r"))
    found = found.select("source", "source_pos", "url", "error", "r.ordinal", *[F.col("r.fields")[i].alias(f) for i, f in enumerate(HIT_FIELDS)])
    found = found.where(F.col("error").isNotNull() | (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.coalesce("bookUrl", F.lit("")) != ""))
    found = found.withColumns({f: absolute_url("url", f) for f in ("bookUrl", "coverUrl", "tocUrl")})
    found = cap_per_source(found, by="source", order="ordinal").withColumn("page", F.lit(page))
    return found.withColumn("arrival", (F.lit(page - 1) * (1 << 40) + F.col("source_pos")) * 1_000_000 + F.coalesce("ordinal", F.lit(0)))


def _tried(f) -> tuple[Any, str | None]:
    """What f gives, or nothing and what went wrong."""
    try:
        return f()
    except (RuleError, ValueError, KeyError) as e:
        return None, f"{type(e).__name__}: {e}"


def search_sources(spark: SparkSession, sources: list[Mapping[str, Any]], pages: DataFrame, keyword: str, page: int = 1) -> DataFrame:
    """search_all() for sources at hand, without the rows of failures."""
    if not sources:
        raise RuleError("no source can be searched")
    rows = [(n, s["bookSourceName"], s["searchUrl"], json.dumps(s.get("ruleSearch") or {})) for n, s in enumerate(sources)]
    return search_all(spark.createDataFrame(rows, "pos int, bookSourceName string, searchUrl string, rules string"), pages, keyword, page).where("error IS NULL").drop("error")


def explore_rules(source: Mapping[str, Any]) -> Mapping[str, str]:
    """Rules for browsing: those of their own, or else those of the search."""
    own = source.get("ruleExplore") or {}
    return own if own.get("bookList") else source.get("ruleSearch") or {}


def explore_actions(entries: DataFrame, values: str = "value") -> DataFrame:
    """Discovery entries (title, action and the chosen value) with actionResult and infoMap: what the action gives for the
    value, and the values as named by the entries' keys and titles.

    An action is a script: it goes to the script engine or a registered function; without an action the value stands."""
    key = F.col("key") if "key" in entries.columns else F.lit(None).cast("string")

    e = Evaluator("full")

    @F.pandas_udf("string")
    def run(actions: pd.Series, chosen: pd.Series) -> pd.Series:
        return pd.Series([e.parse_text(v or "", "@js:" + a, Context(result=v or "")) if (a or "").strip() else v or "" for a, v in zip(actions, chosen)])

    value = F.col(values).cast("string")
    named = F.filter(F.array(F.coalesce(key, F.col("title")), F.col("title")), lambda k: F.trim(F.coalesce(k, F.lit(""))) != "")
    info = F.map_from_entries(F.transform(F.array_distinct(named), lambda k: F.struct(k, value)))
    return entries.withColumns({"actionResult": run("action", value), "infoMap": F.when(value.isNotNull(), info)})


def book_info(pages: DataFrame, rules: Mapping[str, str], keep: Iterable[str] = ("url",)) -> DataFrame:
    """Details of books from their pages. An init rule narrows the page first; a blank tocUrl is the page itself."""
    page = pages
    if rules.get("init"):
        page = extract(pages, "html", {"html_": rules["init"] + ("@all" if not rules["init"].startswith(("$", "@json:")) else "")}, keep=list(pages.columns))
        page = page.withColumn("html", F.coalesce(F.nullif("html_", F.lit("")), "html")).drop("html_")
    fields = {f: rules[f] for f in INFO_FIELDS if rules.get(f)}
    rows = extract(page, "html", fields, keep=list(keep), on_error="null")
    toc = absolute_url("url", "tocUrl") if "tocUrl" in fields else F.lit("")
    return rows.withColumn("tocUrl", F.coalesce(F.nullif(toc, F.lit("")), F.col("url")))


_LEVEL = "book string, url string, path string, follow boolean"


def frontier(start: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame], most: int = LIST_PAGES) -> DataFrame:
    """(book, url, path): the pages of each book in order of path, from start (book, url) over links (url, targets).

    links has for each page the next URLs, or is a function that finds them for a table of URLs; it is asked once for each
    URL that a level reaches first, so that no page is parsed twice and none that nothing leads to. Each level is one join;
    levels are written to the shared folder, with how many pages a book has so far. A book that still has something pending
    after `most` pages is an error, as is a loop that never ends; pages seen are skipped."""
    read, known = (links if callable(links) else lambda wanted: wanted.join(links, "url")), None
    now = start.select("book", "url", F.lit("").alias("path"), F.lit(True).alias("follow"), F.lit(0).cast("long").alias("before"))
    seen, done = None, None
    for _ in range(most + 1):
        now = now.groupBy("book", "url").agg(F.min(F.struct("path", "follow", "before")).alias("m")).select("book", "url", "m.*")
        fresh = now if seen is None else now.join(seen, ["book", "url"], "left_anti")
        # all pages of a level are in one row group of their book: a running count needs no other levels
        fresh = kept(fresh.withColumn("before", F.col("before") + F.count("*").over(Window.partitionBy("book"))), "frontier")
        if not fresh.limit(1).count():
            return done if done is not None else fresh.drop("follow", "before")
        if over := fresh.where(F.col("before") > most).limit(1).collect():
            raise RuleError(f"{over[0].book} has over {most} pages")
        seen = fresh.select("book", "url") if seen is None else seen.unionByName(fresh.select("book", "url"))
        done = fresh.drop("follow", "before") if done is None else done.unionByName(fresh.drop("follow", "before"))
        wanted = fresh.where("follow").select("url").distinct()
        found = kept(read(wanted if known is None else wanted.join(known, "url", "left_anti")).select("url", "targets"), "frontier-links")
        known = found if known is None else known.unionByName(found)
        following = fresh.where("follow").join(known, "url").where(F.size("targets") > 0)
        now = following.select("book", "before", F.posexplode("targets").alias("n", "next"), "path", (F.size("targets") == 1).alias("single"))
        now = now.select("book", F.col("next").alias("url"), F.concat("path", F.lit("/"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("path"), F.col("single").alias("follow"), "before")
    raise RuleError(f"pages are pending after {most} levels")


def next_links(pages: DataFrame, rule: str) -> DataFrame:
    """(url, targets): the absolute next URLs of each page."""
    return pages.select("url", rule_list("html", rule).alias("raw")).select("url", absolute_urls("url", "raw").alias("targets"))


def chapter_list(start: DataFrame, pages: DataFrame, rules: Mapping[str, str], most: int = LIST_PAGES) -> DataFrame:
    """(book, index, name, url, isVip, isPay, isVolume, updateTime, page_url) from start (book, url of the first list page).

    Chapters are numbered through all pages of a book, in order. A chapter without a URL has its page's; a volume without
    one has its name and number. formatJs, a script for the hook or a registered function, gives each chapter its title."""
    order = start.select("book", "url", F.lit("").alias("path"))
    if rules.get("nextTocUrl"):
        order = frontier(start, lambda wanted: next_links(wanted.join(pages, "url"), rules["nextTocUrl"]), most)
    list_rule = rules["chapterList"]
    fields = {"name": rules.get("chapterName", "text"), "link": rules.get("chapterUrl", "href")} | {f: rules[f] for f in ("isVip", "isPay", "isVolume", "updateTime") if rules.get(f)}
    rows = extract(fetch(order, pages).where("html IS NOT NULL"), "html", fields, list_rule.lstrip("+-"), keep=["book", "url", "path"])
    rows = rows.withColumns({f: F.lit(None).cast("string") for f in ("isVip", "isPay", "isVolume", "updateTime") if f not in fields})
    place = F.col("ordinal") * (-1 if list_rule.startswith("-") else 1)
    number = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("path") if list_rule.startswith("-") else F.asc("path"), place))
    rows = rows.where(F.coalesce("name", F.lit("")) != "").withColumn("index", number)
    if code := (rules.get("formatJs") or "").strip():
        e = Evaluator("full")

        @F.pandas_udf("string")
        def formatted(names: pd.Series, numbers: pd.Series) -> pd.Series:
            return pd.Series([e.parse_text(n, "@js:" + code, Context(result=n, variables={"title": n, "index": int(i)})) or n for n, i in zip(names, numbers)])

        rows = rows.withColumn("name", formatted("name", "index"))
    flags = {f: bool_value(f) for f in ("isVip", "isPay", "isVolume")}
    url = F.when(F.coalesce("link", F.lit("")) != "", absolute_url("url", "link")).when(bool_value("isVolume"), F.concat("name", F.col("index").cast("string"))).otherwise(F.col("url"))
    return rows.withColumns({"page_url": F.col("url"), "url": url} | flags).select("book", "index", "name", "url", "isVip", "isPay", "isVolume", "updateTime", "page_url")


def chapter_content(start: DataFrame, pages: DataFrame, rules: Mapping[str, str], title: str | None = None, most: int = CONTENT_PAGES, exact_title: bool = False) -> DataFrame:
    """(book, title, text): the contents of all pages of each chapter, in order, cleaned. start has book (the chapter) and url.

    Pages are joined by a blank line; subContent follows; replaceRegex runs over the markup before it is flattened. The
    title comes from the first page, or from the column that `title` names. A first line that ends with it, marks aside, is
    left out; with exact_title one that is the title sign by sign."""
    order = start.select("book", "url", F.lit("").alias("path"))
    if rules.get("nextContentUrl"):
        order = frontier(start, lambda wanted: next_links(wanted.join(pages, "url"), rules["nextContentUrl"]), most)
    fields = {"content": rules["content"]} | ({"title": rules["title"]} if rules.get("title") else {}) | ({"sub": rules["subContent"]} if rules.get("subContent") else {})
    rows = extract(fetch(order, pages).where("html IS NOT NULL"), "html", fields, keep=["book", "path"])
    part = F.struct("path", "content", (F.col("title") if "title" in fields else F.lit(None).cast("string")).alias("title"), (F.col("sub") if "sub" in fields else F.lit("")).alias("sub"))
    whole = rows.groupBy("book").agg(F.array_sort(F.collect_list(part)).alias("p"))  # CONTENT_PAGES at most
    joined = F.array_join(F.transform("p", lambda x: x["content"]), "\n\n")
    sub = F.array_join(F.filter(F.transform("p", lambda x: x["sub"]), lambda x: x != ""), "\n\n")
    whole = whole.select("book", F.get("p", F.lit(0))["title"].alias("title"), F.when(sub != "", F.concat(joined, F.lit("\n\n"), sub)).otherwise(joined).alias("raw"))
    if title:
        whole = whole.drop("title").join(start.select("book", F.col(title).alias("title")), "book", "left")
    replace_rule = rules.get("replaceRegex") or ""

    e = Evaluator("full")

    @F.pandas_udf("string")
    def cleaned(raws: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([without_title(clean_lines(html_to_text(e.apply_text_rule(r or "", replace_rule, child_context(Context())))), t, exact=exact_title)[0] for r, t in zip(raws, titles)])

    return whole.select("book", "title", cleaned("raw", "title").alias("text"))


def sections_from(chapters: DataFrame, contents: DataFrame) -> DataFrame:
    """(book, index, title, content) for the chapters (book, index, name, url) whose contents (book=url, text) are there."""
    text = contents.select(F.col("book").alias("url"), F.col("text").alias("content"))
    return chapters.join(text, "url").select("book", "index", F.col("name").alias("title"), "content")

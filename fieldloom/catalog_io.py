"""Registered queries over archives, states and books that are written and read back, discovery entries, and many rules at once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import _SOURCE_JSON, H1, HREFS, LINKS, TITLE, _event_documents, _sources, _tree, flat, query, t
from .functions import text, urls
from .operators import crawl, json_tree, many, search, shelf
from .operators.evaluate import register_rule_function
from .operators.staging import kept, shared_folder
from .plans.errors import RuleError
from .sources import backup, books, containers


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"


# ---- archives and states


def _numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def _records(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Records of a member by nation (at): suppliers as sources, customers as a shelf, their orders as readings."""
    if kind == "bookSource.json":
        rows = _sources(spark, d).select(F.col("pos").alias("key"), "raw").join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("at")), "key")
        return _numbered(rows.select("at", "key", F.col("raw").alias("record")), "at", "key")
    customers = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("at"), "c_name", "c_mktsegment", "c_acctbal")
    if kind == "bookshelf.json":
        entry = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("author"), F.concat(F.lit("b"), "key").alias("bookUrl"), F.col("key").alias("durChapterIndex"), F.lit(3).alias("group"), F.struct(F.lit(1).alias("x")).alias("readConfig")))
        return _numbered(customers.select("at", "key", entry.alias("record")), "at", "key")
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_totalprice").alias("words")).join(customers, "key")
    reading = F.to_json(F.struct(F.col("c_name").alias("bookName"), F.col("o_orderkey").alias("id"), F.col("words").cast("long").alias("readTime")))
    return _numbered(orders.select("at", F.col("o_orderkey").alias("key"), reading.alias("record")), "at", "key")


def _archives(spark: SparkSession, d: str) -> str:
    """A backup archive for each nation, written out of the tables; where they are."""
    pieces = None
    for rank, member in enumerate(backup.MEMBERS):
        kind = member if rank < 2 else "readRecord.json"
        rows = _records(spark, d, kind)
        rows = rows if rank < 3 else rows.where("key % 2 = 0")
        own = backup.record_pieces(rows, member, by="at").select(F.concat(F.lit("nation-"), "at", F.lit(".zip")).alias("file"), F.lit(rank).alias("rank"), F.col("file").alias("name"), "pos", "content", F.lit(False).alias("stored"))
        pieces = own if pieces is None else pieces.unionByName(own)
    path = _new_folder(spark, "archives")
    containers.write_archives(pieces, path)
    return path


def _nation() -> Column:
    return F.regexp_extract("archive", r"nation-(\d+)\.zip$", 1).cast("int")


@query("SELECT c_nationkey AS nation, c_custkey AS pos, c_name AS name, c_mktsegment AS author, 'b' || c_custkey AS url, false AS unshelved FROM customer")
def archive_shelves(spark: SparkSession, d: str) -> DataFrame:
    """The shelves out of all nations' archives, of which this member alone is read, without another reader's own settings."""
    found = backup.archive_members(spark, _archives(spark, d), ["bookshelf.json"])
    entries = backup.shelf_table(found)
    return entries.select(_nation().alias("nation"), F.col("durChapterIndex").cast("int").alias("pos"), "name", "author", F.col("bookUrl").alias("url"), F.col("raw").rlike('"(group|readConfig)"').alias("unshelved"))


@query(f"""
SELECT s_nationkey AS nation, s_suppkey AS pos, name, type, enabled, content FROM (SELECT s_suppkey, s_nationkey, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS type, s_suppkey % 7 <> 0 AS enabled,
       json_extract_string({_SOURCE_JSON}, '$.ruleContent.content') AS content FROM supplier)
""")
def archive_sources(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of sources out of all nations' archives."""
    rows = backup.source_table(backup.archive_members(spark, _archives(spark, d), ["bookSource.json"]))
    return rows.select(_nation().alias("nation"), F.regexp_extract("bookSourceUrl", r"u(\d+)", 1).cast("int").alias("pos"), F.col("bookSourceName").alias("name"), F.col("bookSourceType").alias("type"), "enabled", F.col("ruleContent")["content"].alias("content"))


@query("""
WITH o AS (SELECT c_nationkey AS nation, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT nation, 'readRecord.json' AS name, count(*) AS records FROM o GROUP BY 1 UNION ALL SELECT nation, unnest(['readRecordDetail.json', 'readRecordSession.json']), count(*) FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1
UNION ALL SELECT c_nationkey, 'bookshelf.json', count(*) FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'bookSource.json', count(*) FROM supplier GROUP BY 1)
SELECT nation, name, records FROM n
""")
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """How many records each member of each nation's archive has."""
    found = backup.archive_members(spark, _archives(spark, d))
    counts = None
    for member in backup.MEMBERS:
        own = backup.records(found, member).groupBy(_nation().alias("nation")).agg(F.count("*").alias("records")).withColumn("name", F.lit(member))
        counts = own if counts is None else counts.unionByName(own)
    return counts.select("nation", "name", "records")


@query("""
WITH p AS (SELECT c_nationkey AS nation, 1 AS c, 0 AS s, 0 AS o FROM customer UNION ALL SELECT s_nationkey, 0, 1, 0 FROM supplier UNION ALL SELECT c_nationkey, 0, 0, 1 FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT nation, sum(c) AS c, sum(s) AS s, sum(o) AS o FROM p GROUP BY 1)
SELECT nation, unnest(CASE WHEN c = 0 THEN ['bookshelf.json'] ELSE [] END || CASE WHEN s = 0 THEN ['bookSource.json'] ELSE [] END || CASE WHEN o = 0 THEN ['readRecord.json', 'readRecordDetail.json', 'readRecordSession.json'] ELSE [] END) AS name, 'missing' AS fault FROM g
UNION ALL SELECT s_suppkey - 1000000, 'nested/' || s_name, 'unsafe' FROM supplier
""")
def archive_faults(spark: SparkSession, d: str) -> DataFrame:
    """What keeps archives from being read, by their directories alone; a further archive for each supplier has a member of an unsafe name."""
    path = _archives(spark, d)
    s = t(spark, d, "supplier").select(F.concat(F.lit("unsafe-"), "s_suppkey", F.lit(".zip")).alias("file"), F.lit(9).alias("rank"), F.concat(F.lit("nested/"), "s_name").alias("name"), F.lit(0).alias("pos"), F.lit("{}").alias("content"), F.lit(True).alias("stored"))
    members = s.select("file", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(m).alias("name")) for i, m in enumerate(backup.MEMBERS)])).alias("m"), "pos", "content", "stored").select("file", "m.*", "pos", "content", "stored")
    more = _new_folder(spark, "unsafe")
    containers.write_archives(s.unionByName(members), more)
    nation = F.coalesce(F.nullif(F.regexp_extract("archive", r"nation-(\d+)\.zip$", 1), F.lit("")).cast("long"), F.regexp_extract("archive", r"unsafe-(\d+)\.zip$", 1).cast("long") - 1_000_000)
    return backup.archive_faults(spark, path).unionByName(backup.archive_faults(spark, more)).select(nation.alias("nation"), "name", "fault")


@query("""
SELECT c_custkey AS pos, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS author FROM customer
""")
def state_shelf(spark: SparkSession, d: str) -> DataFrame:
    """A state written out of the tables, its shelf rewritten as one change, and read again after its sizes and hashes have been checked."""
    path = _new_folder(spark, "state")
    customers = t(spark, d, "customer").select((F.col("c_custkey").cast("long")).alias("pos"), "c_name", "c_mktsegment")
    entry = lambda author: customers.select("pos", F.to_json(F.struct(F.col("c_name").alias("name"), author.alias("author"), F.col("pos").alias("durChapterIndex"))).alias("record"))
    members = {m: customers.limit(0).select("pos", F.lit("").alias("record")) for m in backup.MEMBERS} | {"bookshelf.json": entry(F.col("c_mktsegment"))}
    pieces = lambda: reduce(DataFrame.unionByName, [backup.record_pieces(rows, m) for m, rows in members.items()])
    backup.write_state_pieces(pieces(), path)
    members["bookshelf.json"] = entry(F.when(F.col("pos") % 3 == 0, "changed").otherwise(F.col("c_mktsegment")))
    backup.write_state_pieces(pieces(), path, overwrite=True)
    rows = backup.shelf_table(backup.read_state(spark, path))
    return rows.select(F.col("durChapterIndex").cast("int").alias("pos"), "name", "author")


@query("SELECT conv_id::VARCHAR AS book, turn AS place, role AS title, strlen(text) AS bytes FROM conversations WHERE text IS NOT NULL")
def epub_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as EPUB files, and their chapters read out of these."""
    c = t(spark, d, "conversations").where("text IS NOT NULL")
    first = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sections = c.select(F.col("conv_id").alias("book"), F.col("turn").alias("index"), F.col("role").alias("title"), F.col("text").alias("content"), F.lit("several").alias("author"))
    path = _new_folder(spark, "epubs")
    books.write_epubs(sections, path)
    found = containers.zip_members(spark, path, pattern=r"^text/").select(F.regexp_extract("archive", r"([^/]+)\.epub$", 1).alias("book"), F.regexp_extract("name", r"(\d+)\.xhtml$", 1).cast("int").alias("n"), F.col("content").cast("string").alias("x"))
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    title = plain(F.regexp_extract("x", "<h1>(.*?)</h1>", 1))
    places = c.select(F.col("conv_id").cast("string").alias("book"), (F.row_number().over(first)).alias("n"), F.col("turn").alias("place"), F.octet_length("text").cast("long").alias("bytes"), F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"\s+", " ").alias("real"))
    body = F.array_join(F.transform(F.regexp_extract_all("x", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), plain), " ")
    same = F.regexp_replace(F.trim(F.regexp_replace(body, r"\s+", " ")), r"\s", "") == F.regexp_replace("real", r"\s", "")
    return found.join(places, ["book", "n"]).select("book", "place", title.alias("title"), F.when(same, F.col("bytes")).otherwise(-1).alias("bytes"))


# ---- discovery entries, hits, lists


@query(f"""
WITH p AS (SELECT page_id, [x FOR x, k IN {HREFS} IF list_position({HREFS}, x) = k] AS l FROM pages),
e AS (SELECT page_id, l, CASE WHEN page_id % 4 = 3 THEN list_sort(l) ELSE l END AS o FROM p)
SELECT page_id, i AS "index", CASE page_id % 4 WHEN 0 THEN 'T' || o[i] WHEN 1 THEN o[i] WHEN 2 THEN 'L' || i ELSE o[i] || '?m' END AS title, CASE page_id % 4 WHEN 3 THEN o[i] || '?m' ELSE o[i] END AS url,
       CASE page_id % 4 WHEN 0 THEN 'select' ELSE 'url' END AS type, CASE page_id % 4 WHEN 0 THEN 'k' || i WHEN 1 THEN o[i] WHEN 2 THEN 'L' || i ELSE o[i] || '?m' END AS key, CASE page_id % 4 WHEN 0 THEN 2 ELSE 0 END AS chars
FROM (SELECT page_id, o, unnest(range(1, len(o) + 1)) AS i FROM e)
""")
def explore_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Discovery entries made of each page's links, in all shapes: objects under other names, bare links as lines, titled lines, and one object of links."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    p = t(spark, d, "pages").select("page_id", F.transform(hrefs, lambda x, i: F.struct(x.alias("u"), (i + 1).cast("string").alias("i"))).alias("l"))
    named = F.to_json(F.transform("l", lambda x: F.struct(F.concat(F.lit("T"), x["u"]).alias("label"), x["u"].alias("exploreUrl"), F.lit(" SELECT ").alias("inputType"), F.concat(F.lit("k"), x["i"]).alias("infoKey"), F.lit("a, b").alias("values"))))
    bare = F.array_join(F.transform("l", lambda x: x["u"]), "\r\n")
    titled = F.array_join(F.transform("l", lambda x: F.concat(F.lit("L"), x["i"], F.lit(" :: "), x["u"])), " && ")
    mapped = F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["u"], F.concat(x["u"], F.lit("?m"))))))
    kind = F.col("page_id") % 4
    rows = p.select("page_id", F.when(kind == 0, named).when(kind == 1, bare).when(kind == 2, titled).otherwise(mapped).alias("exploreUrl"))
    found = search.explore_entries(rows, "page_id")
    return found.select("page_id", F.col("index").cast("long").alias("index"), "title", "url", "type", "key", F.size("chars").alias("chars"))


@query("""
WITH v AS (SELECT conv_id, turn, [turn::VARCHAR, role, text, CASE WHEN turn % 2 = 0 THEN '1' ELSE '0' END] AS x FROM conversations),
h AS (SELECT conv_id, ['k' || conv_id, 'u', '', count(*)::VARCHAR] || flatten(list(x ORDER BY turn)) AS t FROM v GROUP BY 1),
b AS (SELECT conv_id, list_prepend(5381::BIGINT, flatten([[strlen(s)] || [('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT FOR i IN range(0, strlen(s))] || [0] FOR s IN t])) AS n FROM h)
SELECT conv_id AS book, list_reduce(n, lambda a, x: (a * 33 + x) % 2147483647) AS session FROM b
""")
def list_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The number by which a book's list is known, over all bytes of all its chapters; whole texts stand for addresses."""
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("index"), F.col("role").alias("name"), F.col("text").alias("url"), (F.col("turn") % 2 == 0).alias("vip"))
    head = c.select("book").distinct().select("book", F.concat(F.lit("k"), "book").alias("key"), F.lit("u").alias("sourceUrl"), F.lit(None).cast("string").alias("sourceName"))
    return shelf.session_ids(head, c)


@query(f"""
WITH r AS (SELECT chr(i::INT) || chr(j::INT) AS rule FROM range(97, 123) a(i), range(97, 123) b(j)), l AS (SELECT page_id, unnest({HREFS}) AS link FROM pages)
SELECT rule, page_id, count(*) AS n FROM l JOIN r ON contains(link, rule) GROUP BY 1, 2
""")
def many_selectors(spark: SparkSession, d: str) -> DataFrame:
    """676 selectors over all pages at once, as one automaton."""
    letters = spark.range(26 * 26).select(F.concat(F.chr(F.floor(F.col("id") / 26) + 97), F.chr(F.col("id") % 26 + 97)).alias("rule"))
    rules = letters.select("rule", F.concat(F.lit("nav li > a[href*='"), "rule", F.lit("']")).alias("selector"))
    return many.match_selectors(_tree(spark, d), rules).groupBy("rule", F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, i - 1 AS item, l[i] AS link, names[i] AS name FROM (SELECT page_id, l, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS names, unnest(range(1, len(l) + 1)) AS i FROM {LINKS}) WHERE page_id % 3 <> 2")
def many_sources(spark: SparkSession, d: str) -> DataFrame:
    """Lists and fields of sources with different rules, each for its own pages, by joins; a third of the sources finds nothing."""
    n = _tree(spark, d)
    rules = [("s0", "", "nav li", "text"), ("s0", "link", "a", "href"), ("s0", "name", "li > a", "text"), ("s1", "", "ul > li", "text"), ("s1", "link", "[href]", "href"), ("s1", "name", "nav a", "ownText"), ("s2", "", "li.none", "text"), ("s2", "link", "a", "href")]
    scope = t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("s"), F.col("page_id") % 3).alias("rule"))
    found = many.extract_many(n, spark.createDataFrame(rules, "rule string, field string, selector string, mode string"), scope)
    pick = lambda name: F.first(F.when(F.col("field") == name, F.col("value")), ignorenulls=True).alias(name)
    return found.groupBy(F.col("doc_id").alias("page_id"), F.col("item").cast("long").alias("item")).agg(pick("link"), pick("name"))


def only_with_e(link: str) -> str:
    """A rule function that fails on links without an e."""
    if "e" not in link:
        raise RuleError("no e")
    return link


@query(f"""
SELECT page_id, 'http://h' || l[i] AS "bookUrl", CASE WHEN bad = 0 OR i < bad THEN l[i] END AS kind, CASE WHEN bad = i THEN 'no e' END AS error
FROM (SELECT page_id, l, coalesce(list_position([contains(x, 'e') FOR x IN l], false), 0) AS bad, unnest(range(1, len(l) + 1)) AS i FROM {LINKS})
""")
def disabled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Hits of which an optional field fails at some item: its error is told once, and it is left out from there on."""
    register_rule_function("only_with_e", only_with_e)
    p = t(spark, d, "pages").select("page_id", F.lit("http://h/").alias("url"), "html")
    rules = {"bookList": "@css:nav li", "name": "@css:a@text", "bookUrl": "@css:a@href", "kind": "@css:a@href@js:only_with_e(result)"}
    hits = crawl.extract_books(p, rules, keep=("page_id", "url", "html")).withColumn("item", F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal")) - 1)
    failed = crawl.failed_fields(p, rules, keep=("page_id",)).select("page_id", "item", "error")
    return hits.select("page_id", "item", "bookUrl", "kind").join(failed, ["page_id", "item"], "left").select("page_id", "bookUrl", "kind", "error")


@query(f"""
WITH p AS (SELECT page_id // 10 AS book, list({H1} ORDER BY page_id) AS h, list({TITLE} ORDER BY page_id) AS s FROM pages GROUP BY 1)
SELECT book, h[1] AS title, array_to_string([x FOR x IN h[2:] || s IF x <> ''], chr(10)) AS text FROM p
""")
def content_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chapters over ten pages that link to the next: all pages' contents, then what comes after them, without the heading."""
    p = t(spark, d, "pages")
    last = p.agg(F.max("page_id")).first()[0]
    url = lambda n: F.concat(F.lit("https://b.example/p"), n.cast("string"))
    key = F.col("page_id")
    link = F.when((key % 10 < 9) & (key < last), F.concat(F.lit('<a class="next" href="/p'), (key + 1).cast("string"), F.lit('">next</a>'))).otherwise("")
    linked = p.select(url(key).alias("url"), F.concat("html", link).alias("html"))
    start = p.where("page_id % 10 = 0").select(F.floor(key / 10).cast("string").alias("book"), url(key).alias("url"))
    rules = {"content": "@css:article > h1@html", "title": "@css:article > h1@text", "subContent": "@css:head > title@html", "nextContentUrl": "@css:a.next@href"}
    return crawl.chapter_content(start, linked, rules).select(F.col("book").cast("long").alias("book"), "title", "text")


# ---- values


@query("""
SELECT page_id, host || dir || 'p/q' AS beside, host || dir || 'r;x' AS here, host || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END || 's' AS above, host || path || '?t=1' AS query, host || path || CASE WHEN q = '' THEN '' ELSE q END || '#u' AS fragment, 'mailto:x@y' AS other,
       host || dir || 'p,{"method":"POST"}' AS options
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS dir, regexp_extract(url, '[?][^#]*', 0) AS q FROM pages)
""")
def relative_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that take a resolver: beside the page, above it, its query, its fragment."""
    links = {"beside": "p/q", "here": "./r;x", "above": "../s", "query": "?t=1", "fragment": "#u", "other": "mailto:x@y", "options": 'p,{"method":"POST"}'}
    return t(spark, d, "pages").select("page_id", *[urls.absolute_url("url", F.lit(x)).alias(n) for n, x in links.items()])


@query("SELECT event_id // 50 AS page, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def json_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    """An array that a list rule finds alone stands for its members."""
    rows = json_tree.json_rows(json_tree.shred_json(_event_documents(spark, d), "page", "j"), "$.items")
    number = F.get_json_object("value", "$.event_id").cast("bigint")
    return rows.groupBy(F.col("doc_id").alias("page")).agg(F.count("*").alias("n"), F.min(number).alias("first"), F.max(number).alias("last"))


@query("SELECT s_suppkey AS pos, s_name AS name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def scoped_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that a scope lists: those of one region."""
    nations = t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    scope = t(spark, d, "supplier").join(nations, "s_nationkey").select(F.concat(F.lit("u"), "s_suppkey").alias("bookSourceUrl"))
    return search.in_scope(_sources(spark, d), scope).select("pos", "name")


@query("""
SELECT s_suppkey AS pos, row_number() OVER (ORDER BY s_suppkey % 2 DESC, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE s_nationkey END, s_suppkey, lower(s_name)) AS place FROM supplier
""")
def changed_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for a change of source in the order in which they are shown: by score, the source's order or its place, and name."""
    key = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select((key % 2).alias("score"), F.when(key % 3 > 0, F.col("s_nationkey").cast("long")).alias("customOrder"), key.cast("long").alias("source_pos"), F.col("s_name").alias("source"))
    listed = kept(search.change_source_order(rows).withColumn("place", F.monotonically_increasing_id()), "order")
    return listed.select(F.col("source_pos").cast("int").alias("pos"), F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))


@query("SELECT c_nationkey AS nation, count(*) FILTER (c_custkey % 3 <> 0) AS n, min(c_name) FILTER (c_custkey % 3 <> 0) AS first FROM customer GROUP BY 1")
def pasted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources out of pasted arrays, one for each nation, of which a third lacks a URL."""
    c = t(spark, d, "customer")
    entry = F.struct(F.col("c_name").alias("bookSourceName"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("u"), "c_custkey")).alias("bookSourceUrl"))
    pasted = c.groupBy("c_nationkey").agg(F.to_json(F.collect_list(entry)).alias("j")).select("c_nationkey", backup.parse_sources(F.col("j")).alias("s"))
    rows = pasted.select(F.col("c_nationkey").alias("nation"), F.explode_outer("s").alias("s"))
    return rows.groupBy("nation").agg(F.count("s").alias("n"), F.min(F.get_json_object("s", "$.bookSourceName")).alias("first"))


_PADS = [bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]


@query(f"SELECT doc_id, sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(coalesce(text, ''))))) AS code FROM documents")
def keyed_digests(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", text.hmac(F.coalesce("text", F.lit("")), "key", "sha256").alias("code"))


@query("SELECT c_nationkey AS nation, count(*) AS n, count(DISTINCT id) = count(*) AS different FROM (SELECT c_nationkey, c_custkey AS id FROM customer) GROUP BY 1")
def random_ids(spark: SparkSession, d: str) -> DataFrame:
    """A random identifier for each row: all have the form of one, and no two are the same."""
    rows = t(spark, d, "customer").select("c_nationkey", F.uuid().alias("id"))
    form = F.count_if(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
    return rows.groupBy(F.col("c_nationkey").alias("nation")).agg(form.alias("n"), (F.count_distinct("id") == F.count("*")).alias("different"))


@query("""
SELECT c_custkey AS pos, CASE c_custkey % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'bmp' END AS kind FROM customer
""")
def cover_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Image formats by their first bytes, whatever follows."""
    key = F.col("c_custkey")
    heads = F.element_at(F.array(*map(F.lit, ("FFD8FF", "89504E470D0A1A0A", "474946383961", "524946460102030457454250", "424D", "00FFD8FF"))), (key % 6 + 1).cast("int"))
    rows = t(spark, d, "customer").select(key.alias("pos"), F.unhex(F.concat(heads, F.hex("c_name"))).alias("b"))
    return rows.select("pos", text.cover_kind("b").alias("kind"))


@query(f"SELECT page_id, i - 1 AS ordinal, name, link AS \"bookUrl\", '' AS \"lastChapter\" FROM (SELECT page_id, l, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS n, unnest(range(1, len(l) + 1)) AS i, l[i] AS link, {flat('n[i]')} AS name FROM {LINKS})")
def light_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the few fields that a change of source needs; other rules aren't looked at."""
    rules = {"bookList": "@css:nav li", "name": "@css:a@text", "bookUrl": "@css:a@href", "lastChapter": "@css:b@text", "cover": "@js:never()", "intro": "@js:never()"}
    rows = crawl.extract_books(t(spark, d, "pages").select("page_id", F.lit("").alias("url"), "html"), rules, light=True, keep=("page_id", "url"))
    return rows.select("page_id", "ordinal", "name", "bookUrl", "lastChapter")

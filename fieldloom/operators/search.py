"""Search over many sources: which sources, merging and ranking of hits, change of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import group_tokens, match_name, search_key, truncate_bytes_column, without_space
from .shelf import find_shelf

#: Limits of the search (fixed values): merged hits, hits of a source, pages.
MOST_RESULTS, MOST_PER_SOURCE, MOST_PAGES = 300, 100, 10
#: Limits of a change of source (fixed values): candidates overall and per source.
MOST_CANDIDATES, CANDIDATES_PER_SOURCE = 240, 5
#: Candidates whose details and lists are looked at (fixed value).
MOST_PROBES = 24


def eligible(sources: DataFrame) -> DataFrame:
    """Text sources that aren't disabled and can be searched."""
    return sources.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("bookSourceType", F.lit(0)) == 0) & (F.trim(F.coalesce("searchUrl", F.lit(""))) != ""))


def in_groups(sources: DataFrame, groups: list[str], col: str = "bookSourceGroup") -> DataFrame:
    """Sources with one of the groups; no groups mean all."""
    return sources.where(F.arrays_overlap(group_tokens(col), F.array(*map(F.lit, groups)))) if groups else sources


def in_scope(sources: DataFrame, scope: DataFrame | None, key: str = "bookSourceUrl") -> DataFrame:
    """Sources that the scope lists; an empty scope or none means all."""
    if scope is None or not scope.limit(1).count():
        return sources
    return sources.join(scope.select(key), key, "left_semi")


def group_vocabulary(sources: DataFrame, col: str = "bookSourceGroup") -> DataFrame:
    """Each group name and how many sources have it."""
    return sources.select(F.explode(F.array_distinct(group_tokens(col))).alias("group")).groupBy("group").agg(F.count("*").alias("n"))


def cap_per_source(hits: DataFrame, most: int = MOST_PER_SOURCE, by: str = "source", order: str = "pos") -> DataFrame:
    """The first hits of each source. The cap is before any merge, so that a source can't flood it."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def merge_search(hits: DataFrame, keyword: str, most: int | None = MOST_RESULTS, candidates: bool = True) -> DataFrame:
    """Hits (source, arrival, name, author, url, kind, intro, lastChapter) as one row for each book: the first values that
    aren't blank, source names, number of candidates, rank and order of arrival; with `candidates` these themselves too;
    best first.

    Ranks: 0 the name is the keyword, 1 the author is, 2 the name contains it, 3 otherwise; then more candidates, then
    earlier arrival. A row's candidates are as many as sources offer the book. `most` limits the new rows by arrival, before
    anything is gathered. A book's hits are first reduced to one row for each source and URL, so many equal hits of one
    book aren't gathered in one place."""
    rows = hits.withColumn("_key", search_key("name", "author", "url")).where(F.col("_key") != "")
    if most is not None:  # the first keys to arrive
        first_keys = rows.groupBy("_key").agg(F.min("arrival").alias("_a")).orderBy("_a").limit(most).select("_key")
        rows = rows.join(F.broadcast(first_keys), "_key", "left_semi")
    fields, blanks = ("name", "author"), ("kind", "intro", "lastChapter")
    first = lambda c: F.min(F.struct(F.col("arrival").alias("at"), F.col(c).alias("value")))
    filled = lambda c: F.min(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct(F.col("arrival").alias("at"), F.col(c).alias("value"))))
    offers = rows.groupBy("_key", "source", "url").agg(*[first(c).alias(c) for c in fields], *[filled(c).alias(c) for c in blanks], F.min("arrival").alias("arrival"))
    gathered = [F.array_sort(F.collect_list(F.struct("source", "url"))).alias("candidates")] if candidates else []
    out = offers.groupBy("_key").agg(
        *[F.min(c)["value"].alias(c) for c in (*fields, *blanks)], *gathered, F.array_sort(F.collect_set("source")).alias("source_names"), F.count("*").cast("int").alias("n_candidates"), F.min("arrival").alias("arrival")
    )
    return out.withColumn("rank", search_rank("name", "author", keyword)).orderBy("rank", F.desc("n_candidates"), "arrival").drop("_key")


def search_rank(name: str, author: str, keyword: str) -> Column:
    wanted = F.regexp_replace(F.lower(F.lit(keyword)), r"\s+", "")
    some = wanted != ""
    return F.when(some & (without_space(name) == wanted), 0).when(some & (without_space(author) == wanted), 1).when(some & without_space(name).contains(wanted), 2).otherwise(3)


def match_sources(hits: DataFrame, target_name: str, target_author: str = "", check_author: bool = False) -> DataFrame:
    """Hits that are the wanted book, with score: 2 for the name, 3 if the author fits too. check_author leaves out those whose doesn't."""
    name, author = match_name(F.lit(target_name)), match_name(F.lit(target_author))
    fits = (author != "") & match_name("author").contains(author)
    rows = hits.where((F.trim(F.coalesce("url", F.lit(""))) != "") & (name != "") & (match_name("name") == name)).withColumn("score", F.when(fits, 3).otherwise(2))
    return rows.where(fits | (author == "")) if check_author else rows


def join_candidates(hits: DataFrame, books: DataFrame) -> DataFrame:
    """The same for many wanted books (book, name, author): an equi-join on the name as matched, with the author as score.

    It gives a row for each hit of each book; where many books share a name, candidate_summary() gives what is needed to
    choose without them."""
    wanted = books.select("book", match_name("name").alias("_name"), match_name("author").alias("_author")).where("_name <> ''")
    rows = hits.withColumns({"_hit": match_name("name"), "_hit_author": match_name("author")}).where(F.trim(F.coalesce("url", F.lit(""))) != "")
    joined = rows.join(wanted, F.col("_hit") == F.col("_name"))
    return joined.withColumn("score", F.when((F.col("_author") != "") & F.col("_hit_author").contains(F.col("_author")), 3).otherwise(2)).drop("_hit", "_name", "_hit_author", "_author")


def candidate_summary(hits: DataFrame, books: DataFrame) -> DataFrame:
    """(book, score, n, source, url, arrival) for each wanted book (book, name, author) that any hit fits: its best score, how
    many hits have it, and the first of them to arrive.

    That a hit's author contains the wanted one is an equality of one of its substrings: distinct (name, author) of the
    hits are taken apart into the substrings as long as some wanted author of that name, and what these hold is added up for
    each before it meets the books. So a name that very many hits and books share is no product of the two."""
    first = F.struct("arrival", "source", "url")
    offers = hits.where(F.trim(F.coalesce(F.col("url"), F.lit(""))) != "").groupBy(match_name("name").alias("_name"), match_name("author").alias("_hit_author")).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    wanted = books.select("book", match_name("name").alias("_name"), match_name("author").alias("_author")).where("_name <> ''")
    distinct = wanted.select("_name", "_author").distinct()
    any_author = offers.groupBy("_name").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("score", F.lit(2))
    named = distinct.where("_author <> ''")
    lengths = named.groupBy("_name").agg(F.collect_set(F.char_length("_author")).alias("_lengths"))  # as many as the longest author is long, at most
    size = F.char_length("_hit_author")
    starts = lambda n: F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    parts = F.array_distinct(F.flatten(F.transform(F.filter("_lengths", lambda n: n <= size), lambda n: F.transform(starts(n), lambda at: F.substring(F.col("_hit_author"), at, n)))))
    held = offers.where(size > 0).join(lengths, "_name").select("_name", F.explode(parts).alias("_author"), "n", "first")
    containing = held.join(named, ["_name", "_author"], "left_semi").groupBy("_name", "_author").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("score", F.lit(3))
    best = wanted.join(any_author.select("_name", F.struct("score", "n", "first").alias("any")), "_name").join(containing.select("_name", "_author", F.struct("score", "n", "first").alias("own")), ["_name", "_author"], "left")
    return best.select("book", F.coalesce("own", "any").alias("b")).select("book", "b.score", "b.n", "b.first.source", "b.first.url", "b.first.arrival")


def mark_on_shelf(results: DataFrame, shelf: DataFrame, id_col: str = "book") -> DataFrame:
    """Results with in_shelf: whether the shelf has the book already, by any of the ways in which books are told."""
    found = find_shelf(results, shelf, id_col).select(F.col("book").alias(id_col), F.lit(True).alias("in_shelf"))
    return results.join(found, id_col, "left").withColumn("in_shelf", F.coalesce("in_shelf", F.lit(False)))


#: What a copy of a search result keeps, and the bytes of its intro (fixed values).
COPIED_FIELDS = (
    "name", "author", "bookUrl", "tocUrl", "coverUrl", "intro", "kind",
    "lastChapter", "updateTime", "wordCount", "sourceName", "sourceUrl",
    "sourceVariable", "variable", "origin", "originName", "bookSourceUrl",
)
INTRO_BYTES = 4096


def search_copy(results: DataFrame) -> DataFrame:
    """Results with the COPIED_FIELDS alone, null where they lack one; an intro of more than INTRO_BYTES is cut, at a whole
    character, so that it has no more with the ellipsis behind it."""
    columns = [(F.col(c) if c in results.columns else F.lit(None).cast("string")).alias(c) for c in COPIED_FIELDS]
    cut = F.concat(truncate_bytes_column("intro", INTRO_BYTES - len("…".encode())), F.lit("…"))
    return results.select(*columns).withColumn("intro", F.when(F.octet_length("intro") > INTRO_BYTES, cut).otherwise(F.col("intro")))


def probed(candidates: DataFrame, details: DataFrame, chapters: DataFrame, most: int = MOST_PROBES) -> DataFrame:
    """Candidates (source, url, score, pos) with what probes of the first `most` of them found: the latest chapter and word
    count from details (url, lastChapter, wordCount), the number of chapters from chapters (url, index, name); valid says
    whether there is a list at all. Candidates beyond the probes have nulls."""
    order = F.row_number().over(Window.orderBy(F.desc("score"), "source", "pos"))
    asked = candidates.orderBy(F.desc("score"), "source", "pos").limit(most).select("source", "url", order.alias("probe"))
    listed = chapters.groupBy("url").agg(F.count("*").alias("chapters"), F.max_by("name", "index").alias("last_listed"))
    found = asked.join(details.select("url", "lastChapter", "wordCount"), "url", "left").join(listed, "url", "left")
    found = found.select("source", "url", "probe", F.coalesce("lastChapter", "last_listed").alias("lastChapter"), "wordCount", F.coalesce("chapters", F.lit(0)).alias("chapters"))
    return candidates.join(found, ["source", "url"], "left").withColumn("valid", F.when(F.col("probe").isNotNull(), F.col("chapters") > 0))


def change_source_candidates(matched: DataFrame, per_source: int = CANDIDATES_PER_SOURCE, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """Candidates (source, url, score, pos): each URL of a source once, the best of each source, so many in all."""
    once = matched.withColumn("_n", F.row_number().over(Window.partitionBy("source", "url").orderBy(F.desc("score"), "pos"))).where("_n = 1")
    best = once.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "pos"))).where(F.col("_n") <= per_source).drop("_n")
    return best if most is None else best.orderBy(F.desc("score"), "source", "pos").limit(most)


def change_source_order(candidates: DataFrame) -> DataFrame:
    """Score, then the source's order (else its place), place and name."""
    return candidates.orderBy(F.desc("score"), F.coalesce("customOrder", "source_pos"), "source_pos", F.lower("source"))


def visible(results: DataFrame, group: str | None = None, text: str = "") -> DataFrame:
    """Results of a group whose source or title contains the text."""
    rows = results if group is None else results.where(F.array_contains(group_tokens("bookSourceGroup"), group))
    text = text.strip().lower()
    return rows.where(F.lower(F.coalesce("source", F.lit(""))).contains(text) | F.lower(F.coalesce("name", F.lit(""))).contains(text)) if text else rows


#: What begins a line that is a link without a title (fixed values).
BARE_LINK = r"^(https?://|/|data:|@js:|<js>)"
#: The names by which an entry's fields go, the first that is there (fixed values).
ENTRY_NAMES = {"title": ("title", "name", "text", "label"), "url": ("url", "exploreUrl"), "type": ("type", "inputType"), "action": ("action", "onClick", "callback"), "key": ("key", "paramKey", "infoKey"), "chars": ("chars", "options", "values")}


def explore_entries(sources: DataFrame, id_col: str, col: str = "exploreUrl") -> DataFrame:
    """(id_col, index, title, url, type, action, key, chars, default, value, viewName, style): the discovery entries of sources,
    a row each, numbered from 1 in each source.

    A definition is an array of entries, an object that is one entry, an object whose members are entries titled by their
    keys (in the order of keys), or lines, && counting as a line end. An entry is text (title::url, a bare link, or a title
    alone) or an object with its fields under any of ENTRY_NAMES. Entries without title and url are left out, and so are
    truth values and nulls. key is the title if blank; type is in lower case, by default "button" with an action and no
    url, else "url"; chars is an array, of a text the parts between commas, bars and line ends; style is compact JSON of its
    plain members. Definitions that are blank or null have no rows. Nothing has a schema: what is there decides."""
    spark = sources.sparkSession
    given = sources.select(F.col(id_col).alias("_id"), F.trim(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"^\s+|\s+$", "")).alias("_t"))
    given = given.where("_t <> ''").withColumn("_v", F.when(F.col("_t").rlike(r"^[\[{]"), F.try_parse_json("_t")))
    shape = F.schema_of_variant("_v")
    known = F.coalesce(*[F.try_variant_get("_v", f"$.{k}", "variant") for k in ("title", "name", "url", "action", "type")])
    single = given.where(shape.startswith("OBJECT") & known.isNotNull() & (F.schema_of_variant(known) != "VOID")).select("_id", F.lit(0).alias("_pos"), F.lit(None).cast("string").alias("_key"), F.col("_v").alias("_e"))
    several = given.where(F.col("_v").isNotNull() & ~(shape.startswith("OBJECT") & known.isNotNull() & (F.schema_of_variant(known) != "VOID"))).select("_id", "_v")
    members = several.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("_id", F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_e"))
    lines = given.where(F.col("_v").isNull()).select("_id", F.posexplode(F.split(F.regexp_replace("_t", r"\s*&&\s*", "\n"), r"\r\n?|\n")).alias("_pos", "_line"))
    rows = single.unionByName(members).withColumn("_line", F.lit(None).cast("string")).unionByName(lines, allowMissingColumns=True)

    kind = F.coalesce(F.schema_of_variant("_e"), F.lit(""))
    scalar = ~kind.rlike("^(OBJECT|ARRAY|VOID|BOOLEAN)") & (kind != "")
    text = F.trim(F.regexp_replace(F.coalesce("_line", F.when(scalar, F.col("_e").cast("string")), F.lit("")), r"^\s+|\s+$", ""))
    composite = kind.rlike("^(OBJECT|ARRAY)")
    member = lambda name: F.try_variant_get("_e", f"$.{name}", "variant")
    plain = lambda v: F.when(~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY|VOID)"), v.cast("string"))
    field = lambda name: F.coalesce(*[plain(member(n)) for n in ENTRY_NAMES[name]])
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    parted = F.instr(text, "::") > 0
    title = F.when(composite, trimmed(F.coalesce(field("title"), F.col("_key"), plain(member("viewName"))))).when(parted, trimmed(F.substring_index(text, "::", 1))).otherwise(text)
    url = F.when(composite, trimmed(field("url"))).when(parted, trimmed(F.regexp_replace(text, r"(?s)^.*?::", ""))).when(text.rlike(BARE_LINK), text).otherwise("")
    listed = F.coalesce(*[F.when(F.schema_of_variant(member(n)).startswith("ARRAY"), F.try_variant_get("_e", f"$.{n}", "array<string>")) for n in ENTRY_NAMES["chars"]], F.split(field("chars"), r"[,|\n]"))
    chars = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: trimmed(x)), lambda x: x != "")
    style = F.when(F.schema_of_variant(member("style")).startswith("OBJECT"), F.map_filter(F.try_variant_get("_e", "$.style", "map<string,variant>"), lambda k, v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)")))
    own = rows.select(
        "_id", "_pos", title.alias("title"), url.alias("url"), F.lower(trimmed(F.when(composite, field("type")))).alias("_type"), F.coalesce(F.when(composite, field("action")), F.lit("")).alias("action"), F.when(composite, field("key")).alias("_key"),
        F.when(composite, chars).alias("chars"), F.when(composite, plain(member("default"))).alias("default"), F.when(composite, plain(member("value"))).alias("value"), F.when(composite, plain(member("viewName"))).alias("viewName"), F.to_json(style).alias("style"),
    ).where("title <> '' OR url <> ''")
    button = (F.trim("action") != "") & (F.col("url") == "")
    return own.select(
        F.col("_id").alias(id_col), F.row_number().over(Window.partitionBy("_id").orderBy("_pos")).alias("index"), "title", "url", F.when(F.col("_type") != "", F.col("_type")).when(button, "button").otherwise("url").alias("type"), "action",
        F.when(trimmed(F.col("_key")) != "", F.col("_key")).otherwise(F.col("title")).alias("key"), F.coalesce("chars", F.array().cast("array<string>")).alias("chars"), "default", "value", "viewName", "style",
    )

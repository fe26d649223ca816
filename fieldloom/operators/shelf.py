"""The shelf: reading history, progress and status, identity of books, upserts, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MODULUS, SEED, canonical_title, epoch_seconds, factor_power, folded, history_key
from .staging import kept

#: What a replaced shelf entry keeps of the old one (fixed values).
KEPT_FIELDS = ("durChapterIndex", "durChapterTitle", "durChapterPos", "totalChapterNum", "group", "sort")
BLANK = ""


def _text(c: str | Column) -> Column:
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(BLANK)))


def first_nonblank(c: str | Column, order: str | Column) -> Column:
    """The first value that isn't blank, by order."""
    value = F.col(c) if isinstance(c, str) else c
    return F.min_by(F.when(_text(value) != BLANK, value), F.when(_text(value) != BLANK, F.col(order) if isinstance(order, str) else order))


def reading_history(records: DataFrame, details: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row per (name, author), compared trimmed and in lower case: last_read, read_time, read_words and the counts and sums by kind.

    records has bookName, bookAuthor, lastRead, readTime; details bookName, bookAuthor, lastReadTime, readTime, readWords;
    sessions bookName, bookAuthor, startTime, endTime, words. Times are seconds or milliseconds. Records without a name
    are left out. The three tables are one grouping, with partial sums before the shuffle."""

    def part(df: DataFrame, kind: str, times: list[str], time: str | None, words: str | None) -> DataFrame:
        number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)) if c else F.lit(0)
        stamp = F.coalesce(*[F.col(c) for c in times]) if times else F.lit(None)
        return df.where(_text("bookName") != BLANK).select("bookName", "bookAuthor", F.lit(kind).alias("kind"), epoch_seconds(stamp).alias("stamp"), number(time).cast("long").alias("time"), number(words).cast("long").alias("words"))

    rows = part(records, "record", ["lastRead"], "readTime", None)
    rows = rows.unionByName(part(details, "detail", ["lastReadTime"], "readTime", "readWords")).unionByName(part(sessions, "session", ["endTime", "startTime"], None, "words"))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(history_key("bookName", "bookAuthor").alias("history_key")).agg(
        F.min("bookName").alias("name"), F.coalesce(F.min("bookAuthor"), F.lit("")).alias("author"), F.max("stamp").alias("last_read"),
        zero(F.max(of("record", "time"))).alias("read_time"), zero(F.max(of("record", "words"))).alias("read_words"),
        F.count_if(F.col("kind") == "session").alias("session_count"), F.count_if(F.col("kind") == "detail").alias("detail_count"),
        zero(F.sum(of("detail", "time"))).alias("read_time_detail"), zero(F.sum(of("detail", "words"))).alias("read_words_detail"), zero(F.sum(of("session", "words"))).alias("read_words_session"),
    )


def book_key() -> Column:
    """What progress is stored under: id, else book URL, else source URL, else name."""
    return F.coalesce(*[F.nullif(_text(c), F.lit(BLANK)) for c in ("id", "bookUrl", "bookSourceUrl", "name")])


def reading_status(shelf: DataFrame, progress: DataFrame, history: DataFrame, key: str = "book_key") -> DataFrame:
    """shelf with status (read, reading or unread) and read_at, from progress (key, index from 1, position, updated_at) and history.

    Both joins are left outer; Spark broadcasts a side that is small."""
    saved = progress.select(key, F.col("index").alias("_index"), F.coalesce("position", F.lit(0)).alias("_pos"), F.coalesce("updated_at", F.lit(0)).alias("_at"))
    known = history.select(F.col("history_key").alias("_h"), F.col("last_read").alias("_last"))
    named = F.when(_text("name") != BLANK, history_key("name", "author"))
    rows = shelf.withColumn("_key", named).join(saved, key, "left").join(known, F.col("_key") == F.col("_h"), "left")
    has = F.col("_index").isNotNull()
    index = F.when(has, F.col("_index") - 1).otherwise(F.col("durChapterIndex"))
    position = F.when(has, F.greatest(F.lit(0), F.col("_pos"))).otherwise(F.greatest(F.lit(0), F.coalesce("durChapterPos", F.lit(0))))
    total = F.coalesce("totalChapterNum", F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(yes((total > 0) & (index >= total - 1)), "read").when(yes(index > 0) | (position > 0) | yes(F.col("_index") > 1) | yes(F.col("_pos") > 0) | F.col("_h").isNotNull(), "reading").otherwise("unread")
    read_at = F.greatest(F.coalesce("_at", F.lit(0)), F.coalesce("_last", F.lit(0)))
    return rows.withColumns({"status": status, "read_at": read_at}).drop("_key", "_index", "_pos", "_at", "_h", "_last")


def category_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def shelf_order(statuses: DataFrame) -> DataFrame:
    """By last reading, latest first, then as the shelf stands."""
    return statuses.orderBy(F.desc("read_at"), F.asc("pos"))


def import_progress(shelf: DataFrame, history: DataFrame, progress: DataFrame, key: str = "book_key") -> DataFrame:
    """Progress after importing a shelf: an entry is written if there is none, or the old one was imported or isn't newer.

    A shelf entry counts if it has a chapter or a position beyond the start, or a history."""
    known = history.select(F.col("history_key").alias("_h"), F.col("last_read").alias("_last"))
    rows = shelf.join(known, history_key("name", "author") == F.col("_h"), "left")
    index, position = F.col("durChapterIndex"), F.greatest(F.lit(0), F.coalesce("durChapterPos", F.lit(0)))
    rows = rows.where((index >= 0) & ((index > 0) | (position > 0) | F.col("_h").isNotNull()) & F.col(key).isNotNull())
    stamp = F.greatest(epoch_seconds("durChapterTime"), F.coalesce("_last", F.lit(0)))
    new = rows.select(key, F.struct((index + 1).alias("index"), F.coalesce("durChapterTitle", F.lit("")).alias("title"), position.alias("position"), stamp.alias("updated_at"), F.lit(True).alias("imported")).alias("new"))
    old = progress.select(key, F.struct("index", "title", "position", "updated_at", "imported").alias("old"))
    joined = old.join(new, key, "full_outer")
    write = F.col("old").isNull() | F.col("old.imported") | (F.coalesce(F.col("old.updated_at"), F.lit(0)) <= F.col("new.updated_at"))
    return joined.select(key, F.when(F.col("new").isNotNull() & write, F.col("new")).otherwise(F.col("old")).alias("e")).select(key, "e.*")


def find_shelf(books: DataFrame, shelf: DataFrame, id_col: str = "book") -> DataFrame:
    """(book, pos, tier, ambiguous) for books that are on the shelf: 1 by id, 2 by URL, 3 by name, author and origin, 4 by name and author.

    books and shelf have id, bookUrl, name, author, origin; shelf has pos. The first tier with a match wins, and in it the
    first entry; in the last one several matches are ambiguous and pos is null. Blank authors agree with any; a book
    without origin accepts any in tier 3. No tier compares entries with books: the entries that agree with an author are
    those with the same one and those with none, two groups apart, so each is an equi-join with one row for each group,
    and first places and counts come from both."""
    b = books.select(F.col(id_col).alias("book"), *[_text(c).alias(f"b_{c}") for c in ("id", "bookUrl", "name", "author", "origin")])
    s = shelf.select("pos", *[_text(c).alias(f"s_{c}") for c in ("id", "bookUrl", "name", "author", "origin")])

    def met(wanted: DataFrame, on: tuple[str, ...], blank: bool = False) -> DataFrame:
        """book, pos and n for the entries that agree in all of `on`; blank: and have no author."""
        entries = s.where(F.col(f"s_{on[0]}") != BLANK).where((F.col("s_author") == BLANK) if blank else F.lit(True))
        groups = entries.groupBy(*[F.col(f"s_{c}").alias(f"b_{c}") for c in on]).agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
        return wanted.join(groups, [f"b_{c}" for c in on]).select("book", "pos", "n")

    def tier(n: int, parts: list[DataFrame]) -> DataFrame:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found.groupBy("book").agg(F.min("pos").alias("pos"), F.sum("n").alias("n")).withColumn("tier", F.lit(n))

    named, anonymous = b.where(F.col("b_author") != BLANK), b.where(F.col("b_author") == BLANK)
    by_name = lambda some, *more: [met(some(named), ("name", "author", *more)), met(some(named), ("name", *more), blank=True), met(some(anonymous), ("name", *more))]
    placed, free = (lambda x: x.where(F.col("b_origin") != BLANK)), (lambda x: x.where(F.col("b_origin") == BLANK))
    found = tier(1, [met(b, ("id",))]).unionByName(tier(2, [met(b, ("bookUrl",))])).unionByName(tier(3, by_name(placed, "origin") + by_name(free))).unionByName(tier(4, by_name(lambda x: x)))
    best = found.groupBy("book").agg(F.min(F.struct("tier", "pos", "n")).alias("m"))
    ambiguous = (F.col("m.tier") == 4) & (F.col("m.n") > 1)
    return best.select("book", F.when(~ambiguous, F.col("m.pos")).alias("pos"), F.col("m.tier").alias("tier"), ambiguous.alias("ambiguous"))


def source_of_book(books: DataFrame, sources: DataFrame, id_col: str = "book") -> DataFrame:
    """(book, source_pos): the first text source with the book's origin as URL, else the first with its origin's name."""
    text = sources.where(F.coalesce("bookSourceType", F.lit(0)) == 0)
    by_url = text.groupBy(F.col("bookSourceUrl").alias("origin")).agg(F.min("pos").alias("_url"))
    by_name = text.where(_text("bookSourceName") != BLANK).groupBy(F.col("bookSourceName").alias("originName")).agg(F.min("pos").alias("_name"))
    return books.join(by_url, "origin", "left").join(by_name, "originName", "left").select(F.col(id_col).alias("book"), F.coalesce("_url", "_name").alias("source_pos"))


def upsert_sources(existing: DataFrame, incoming: DataFrame, key: str = "bookSourceUrl") -> DataFrame:
    """existing after an import, with change (kept, replaced or added): the first existing row of a key is replaced, others stay.

    Of several incoming rows with one key the last wins. Both have pos; added rows come after all others."""
    value = [c for c in existing.columns if c not in (key, "pos")]
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*value), "pos").alias("_new"), F.min("pos").alias("_at"))
    first = existing.groupBy(key).agg(F.min("pos").alias("_first"))
    rows = existing.join(first, key).join(last, key, "left")
    hit = F.col("_new").isNotNull() & (F.col("pos") == F.col("_first"))
    rows = rows.select(key, "pos", *[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in value], F.when(hit, "replaced").otherwise("kept").alias("change"))
    end = existing.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_end"))  # one row
    added = last.join(first, key, "left_anti").join(F.broadcast(end)).select(key, (F.col("_end") + F.col("_at")).alias("pos"), *[F.col(f"_new.{c}").alias(c) for c in value], F.lit("added").alias("change"))
    return rows.unionByName(added)


def add_books(shelf: DataFrame, books: DataFrame, id_col: str = "book") -> DataFrame:
    """(book, status, pos and fields) of each book to add: already, replaced (keeps KEPT_FIELDS that it lacks), added or ambiguous."""
    found = find_shelf(books, shelf, id_col)
    old = shelf.select(F.col("pos").alias("pos"), F.col("bookUrl").alias("_url"), *[F.col(c).alias(f"_{c}") for c in KEPT_FIELDS if c in shelf.columns])
    rows = books.withColumnRenamed(id_col, "book").join(found, "book", "left").join(old, "pos", "left")
    status = F.when(F.col("ambiguous"), "ambiguous").when(F.col("pos").isNull(), "added").when((_text("bookUrl") != BLANK) & (F.col("bookUrl") == F.col("_url")), "already").otherwise("replaced")
    kept = {c: F.coalesce(F.col(c) if c in books.columns else F.lit(None), F.col(f"_{c}")) for c in KEPT_FIELDS if c in shelf.columns}
    return rows.withColumns(kept | {"status": status}).drop("_url", "tier", "ambiguous", *[f"_{c}" for c in KEPT_FIELDS])


def merge_info(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old with each field replaced where the new value isn't blank."""
    fresh = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return old.join(fresh, key, "left").withColumns({f: F.coalesce(F.when(_text(f"_{f}") != BLANK, F.col(f"_{f}")), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def match_chapters(progress: DataFrame, chapters: DataFrame, key: str = "book") -> DataFrame:
    """(book, index): where a reading place is in another source's list: the first chapter with the same canonical title, else the
    same number, kept within the list. progress has book, title, index; chapters has book, index (both from 1), name."""
    wanted = progress.select(key, canonical_title("title").alias("_title"), F.col("index").alias("_index"))
    named = chapters.select(F.col(key).alias("_b"), canonical_title("name").alias("_name"), F.col("index").alias("_at"))
    hit = wanted.where(F.col("_title") != BLANK).join(named, (F.col(key) == F.col("_b")) & (F.col("_title") == F.col("_name"))).groupBy(key).agg(F.min("_at").alias("_hit"))
    size = chapters.groupBy(key).agg(F.count("*").alias("_n"))
    clamped = F.when(F.col("_index") >= 1, F.least(F.col("_index"), F.col("_n")))
    return wanted.join(size, key).join(hit, key, "left").select(key, F.coalesce("_hit", clamped).cast("long").alias("index"))


def compact_variables(variables: Column, base: Column) -> Column:
    """What differs from the base map."""
    return F.map_filter(variables, lambda k, v: ~v.eqNullSafe(F.element_at(base, k)))


def move_source(sources: DataFrame, key: str, where: str) -> DataFrame:
    """customOrder of one source set before ("top") or after ("bottom") all others."""
    order = F.coalesce("customOrder", F.lit(0))
    edge = sources.agg((F.min(order) - 1 if where == "top" else F.max(order) + 1).alias("_edge"))  # one row
    return sources.join(F.broadcast(edge)).withColumn("customOrder", F.when(F.col("bookSourceUrl") == key, F.col("_edge")).otherwise(F.col("customOrder"))).drop("_edge")


def prefetch(chapters: DataFrame, cached: DataFrame, book_at: DataFrame, n: int = 5) -> DataFrame:
    """The next n chapters (5 to 10) of each book after its place that aren't cached. book_at has book and index."""
    n = min(max(n, 5), 10)
    ahead = chapters.join(book_at.select("book", F.col("index").alias("_at")), "book").where((F.col("index") > F.col("_at")) & (F.col("index") <= F.col("_at") + n)).drop("_at")
    return ahead.join(cached.select("book", "index"), ["book", "index"], "left_anti")


def running_size_cap(sections: DataFrame, most: int, by: str = "book") -> DataFrame:
    """Sections up to the one with which a book's bytes pass the cap, by running sum.

    Only sizes are ordered: ranges of (book, index) are summed, and a section's sum is that of the ranges before its own
    and of the sections before it in its range. So no task holds a whole book, and texts are joined with what stays."""
    sizes = sections.select(by, "index", F.octet_length("content").cast("long").alias("_size")).repartitionByRange(by, "index").withColumn("_range", F.spark_partition_id())
    sizes = kept(sizes, "sizes")
    sums = sizes.groupBy(by, "_range").agg(F.sum("_size").alias("_n"))
    before = sums.select(by, "_range", (F.sum("_n").over(Window.partitionBy(by).orderBy("_range")) - F.col("_n")).alias("_before"))
    run = F.sum("_size").over(Window.partitionBy(by, "_range").orderBy("index")) + F.col("_before")
    staying = sizes.join(before, [by, "_range"]).withColumn("_run", run).where(F.col("_run") <= most).select(by, "index").distinct()
    return sections.join(staying, [by, "index"], "left_semi")


#: What a change of source takes from the new hit, and what it resets (fixed values).
REPLACED_FIELDS = ("bookUrl", "tocUrl", "origin", "originName", "coverUrl", "intro", "kind", "lastChapter")
RESET_FIELDS = ("durChapterIndex", "durChapterTitle", "durChapterPos", "durChapterTime", "totalChapterNum")


def replace_source(shelf: DataFrame, hits: DataFrame, key: str = "book") -> DataFrame:
    """shelf with the fields of the chosen hit of each book in hits, and its progress reset; other books stay."""
    fresh = hits.select(key, *[F.col(c).alias(f"_{c}") for c in REPLACED_FIELDS if c in hits.columns], F.lit(True).alias("_hit"))
    rows = shelf.join(fresh, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in REPLACED_FIELDS if c in hits.columns and c in shelf.columns}
    reset = {c: F.when(~hit, F.col(c)) for c in RESET_FIELDS if c in shelf.columns}
    return rows.withColumns(new | reset).select(*shelf.columns)


def place_after_change(shelf: DataFrame, progress: DataFrame, chapters: DataFrame, key: str = "book") -> DataFrame:
    """(book, index, valid): each book's place in its new list of chapters; an empty list isn't valid."""
    found = match_chapters(progress, chapters, key)
    listed = chapters.select(key).distinct().withColumn("valid", F.lit(True))
    return shelf.select(key).join(listed, key, "left").join(found, key, "left").select(key, "index", F.coalesce("valid", F.lit(False)).alias("valid"))


def commit_source(shelf: DataFrame, hits: DataFrame, progress: DataFrame, chapters: DataFrame, key: str = "book") -> DataFrame:
    """shelf after a change of source that is made only where it is safe: a book takes its hit's fields if the hit's list of
    chapters (book, index, name) isn't empty, and its place is mapped into that list; other books stay as they are.

    A column `changed` says which. progress has book, title and index (from 1) of where each book is read."""
    places = place_after_change(shelf, progress, chapters, key).where("valid").select(key, F.col("index").alias("_place"))
    listed = chapters.groupBy(key).agg(F.count("*").alias("_chapters"), F.map_from_entries(F.collect_list(F.struct("index", "name"))).alias("_names"))
    chosen = hits.join(places.select(key), key, "left_semi")
    rows = replace_source(shelf, chosen, key).join(chosen.select(key, F.lit(True).alias("changed")), key, "left").join(places, key, "left").join(listed, key, "left")
    changed = F.coalesce("changed", F.lit(False))
    new = {"durChapterIndex": F.col("_place") - 1, "durChapterTitle": F.element_at("_names", F.col("_place").cast(dict(chapters.dtypes)["index"])), "totalChapterNum": F.col("_chapters")}
    rows = rows.withColumns({c: F.when(changed, v.cast(shelf.schema[c].dataType)).otherwise(F.col(c)) for c, v in new.items() if c in shelf.columns} | {"changed": changed})
    return rows.drop("_place", "_chapters", "_names")


#: Chapters that are hashed together.
RANGE = 1000


def session_ids(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, session): a number that changes when a book's list does. books has book, key, sourceUrl and sourceName; chapters
    has book, index (a whole number, mostly from 0 or 1), name, url and vip.

    Each row is a map of the hash so far (see folded()), and maps are put together as sums: a row's share is its own part
    times FACTOR to the number of values behind it. That number is counted within ranges of RANGE chapters, whose maps are
    then put together in the same way, so neither a list nor a book's rows are ever gathered. A null text counts as empty."""
    rows = chapters.select("book", "index", F.floor((F.col("index") - 1) / RANGE).alias("part"), *[c.alias(n) for c, n in zip(folded([F.col("index").cast("string"), F.col("name"), F.col("url"), F.when(F.col("vip"), "1").otherwise("0")]), "cn")])
    sizes = chapters.groupBy("book").agg(F.count("*").alias("chapters"))
    heads = books.join(sizes, "book", "left").select("book", F.lit(None).cast("long").alias("part"), *[c.alias(n) for c, n in zip(folded([F.col("key"), F.col("sourceUrl"), F.col("sourceName"), F.coalesce("chapters", F.lit(0)).cast("string")]), "cn")])

    def behind(frame: DataFrame, by: list[str], order: str) -> DataFrame:
        """c of each row as it counts in the end of its group; a head, whose order is null, comes before all parts."""
        later = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return frame.withColumn("c", F.col("c") * factor_power(later) % MODULUS)

    parts = behind(rows, ["book", "part"], "index").groupBy("book", "part").agg((F.sum("c") % MODULUS).alias("c"), F.sum("n").alias("n"))
    every = parts.join(books.select("book"), "book", "left_semi").unionByName(heads)
    total = behind(every, ["book"], "part").groupBy("book").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    return total.select("book", ((F.col("c") + F.lit(SEED) * factor_power(F.col("n"))) % MODULUS).alias("session"))

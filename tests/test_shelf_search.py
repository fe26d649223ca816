from pyspark.sql import functions as F

from fieldloom.operators import crawl, search, shelf

import pytest
from fieldloom.plans.errors import RuleError


def test_history_of_nothing(spark):
    r = spark.createDataFrame([], "bookName string, bookAuthor string, lastRead long, readTime long")
    d = spark.createDataFrame([(None, "a", 1, 2, 3), ("", "a", 1, 2, 3)], "bookName string, bookAuthor string, lastReadTime long, readTime long, readWords long")
    s = spark.createDataFrame([(" N ", None, 5, None, 4), ("n", "", 9, 7, 1)], "bookName string, bookAuthor string, startTime long, endTime long, words long")
    rows = shelf.reading_history(r, d, s).collect()
    assert [(x.history_key, x.last_read, x.session_count, x.read_words_session) for x in rows] == [("n\t", 7, 2, 5)]


def test_add_books(spark):
    s = spark.createDataFrame([(0, "", "u0", "a", "x", "o", 5), (1, "", "u1", "b", "y", "o", 6)], "pos long, id string, bookUrl string, name string, author string, origin string, durChapterIndex int")
    b = spark.createDataFrame([(1, "", "u0", "a", "x", "o"), (2, "", "new", "b", "y", "o"), (3, "", "z", "c", "", "")], "book long, id string, bookUrl string, name string, author string, origin string")
    out = {r.book: (r.status, r.durChapterIndex) for r in shelf.add_books(s, b).collect()}
    assert out == {1: ("already", 5), 2: ("replaced", 6), 3: ("added", None)}


def test_small_operators(spark):
    old = spark.createDataFrame([(1, "a", "x")], "k int, name string, intro string")
    new = spark.createDataFrame([(1, " ", "y")], "k int, name string, intro string")
    assert tuple(shelf.merge_info(old, new, "k", ["name", "intro"]).first()) == (1, "a", "y")
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1"})], "v map<string,string>, b map<string,string>")
    assert df.select(shelf.compact_variables(F.col("v"), F.col("b")).alias("x")).first().x == {"b": "2"}
    src = spark.createDataFrame([("u", 3), ("v", 7)], "bookSourceUrl string, customOrder int")
    assert {r.bookSourceUrl: r.customOrder for r in shelf.move_source(src, "u", "bottom").collect()} == {"u": 8, "v": 7}


def test_eligibility(spark):
    rows = [("a", True, 0, "s", "g1,g2"), ("b", False, 0, "s", ""), ("c", None, None, "s", "g2"), ("d", True, 1, "s", ""), ("e", True, 0, " ", "")]
    src = spark.createDataFrame(rows, "bookSourceUrl string, enabled boolean, bookSourceType int, searchUrl string, bookSourceGroup string")
    assert [r.bookSourceUrl for r in search.eligible(src).collect()] == ["a", "c"]
    assert [r.bookSourceUrl for r in search.in_groups(src, ["g1"]).collect()] == ["a"]
    assert search.in_scope(src, src.limit(0)).count() == 5
    assert search.in_scope(src, src.where("bookSourceUrl = 'a'")).count() == 1


def test_search_end_to_end(spark):
    sources = [{"bookSourceName": f"s{i}", "searchUrl": f"http://s{i}/q?k={{{{key}}}}&p={{{{page}}}}", "ruleSearch": {"bookList": "@css:li", "name": "a@text", "bookUrl": "a@href", "author": "i@text"}} for i in (1, 2)]
    pages = spark.createDataFrame([("http://s1/q?k=x%20y&p=1", "<li><a href='/1'>X y</a><i>A</i></li><li><a href='/2'>Z</a></li><li>none</li>"), ("http://s2/q?k=x%20y&p=1", "<li><a href='/9'>x Y</a><i>a</i></li>")], "url string, html string")
    hits = crawl.search_sources(spark, sources, pages, "x y")
    assert hits.count() == 3
    full = hits.withColumnRenamed("url", "page").withColumnRenamed("bookUrl", "url")
    merged = search.merge_search(full, "x y").collect()
    assert [(m.name, m.rank, m.n_candidates) for m in merged] == [("X y", 0, 2), ("Z", 3, 1)]


def test_pagination(spark):
    pages = spark.createDataFrame([
        ("http://h/1", "<li><a href=/c1>1</a></li><a class=n href=/2>"), ("http://h/2", "<li><a href=/c2>2</a></li><a class=n href=/1>"),
        ("http://h/m", "<li><a href=/m1>m</a></li><a class=n href=/x><a class=n href=/y>"), ("http://h/x", "<li><a href=/x1>x</a></li><a class=n href=/z>"), ("http://h/y", "<li><a href=/y1>y</a></li>"), ("http://h/z", "<li>z</li>"),
    ], "url string, html string")
    start = spark.createDataFrame([("chain", "http://h/1"), ("several", "http://h/m")], "book string, url string")
    rules = {"chapterList": "@css:li", "chapterName": "a@text", "chapterUrl": "a@href", "nextTocUrl": "@css:a.n@href"}
    out = sorted((r.book, r["index"], r.name) for r in crawl.chapter_list(start, pages, rules).collect())
    assert out == [("chain", 1, "1"), ("chain", 2, "2"), ("several", 1, "m"), ("several", 2, "x"), ("several", 3, "y")]
    with pytest.raises(RuleError):
        crawl.chapter_list(start, pages, rules, most=1)


def test_content_pages(spark):
    pages = spark.createDataFrame([("http://h/1", "<h1>T</h1><div id=c><p>T</p><p>ad one</p></div><a class=n href=/2>"), ("http://h/2", "<div id=c><p>two</p></div>")], "url string, html string")
    start = spark.createDataFrame([("c1", "http://h/1")], "book string, url string")
    rules = {"content": "@css:#c@html", "title": "@css:h1@text", "nextContentUrl": "@css:a.n@href", "replaceRegex": "##ad ##"}
    r = crawl.chapter_content(start, pages, rules).first()
    assert (r.title, r.text) == ("T", "one\ntwo")


def test_book_info(spark):
    pages = spark.createDataFrame([("http://h/b", "<div id=x><h1>N</h1></div><h1>no</h1>")], "url string, html string")
    r = crawl.book_info(pages, {"init": "@css:#x", "name": "@css:h1@text"}).first()
    assert (r.name, r.tocUrl) == ("N", "http://h/b")

"""A search of many sources in which some fail, and books that change their source."""

import pytest

from fieldloom.operators import crawl
from fieldloom.operators.evaluate import register_rule_function
from fieldloom.plans.columns import rule_text
from fieldloom.plans.errors import RuleError

RULES = '{"bookList":"@css:li","name":"@css:a@text","bookUrl":"@css:a@href"}'


def test_failures_are_rows(spark):
    sources = spark.createDataFrame(
        [(0, "good", "http://a/s?k={{key}}&p={{page}}", RULES), (1, "absent", "http://b/{{key}}", RULES), (2, "broken", "http://c/{{key}}", '{"bookList":"@js:x","name":"a"}'), (3, "script", "{{java.get()}}", RULES), (4, "empty", "http://d/{{key}}", RULES)],
        "pos int, bookSourceName string, searchUrl string, rules string",
    )
    hits = "".join(f"<li><a href='/b{i}'>Book {i}</a></li>" for i in range(130))
    pages = spark.createDataFrame([("http://a/s?k=x%20y&p=2", hits), ("http://c/x%20y", "<p>"), ("http://d/x%20y", "<p>")], "url string, html string")
    found = crawl.search_all(sources, pages, "x y", page=2).collect()
    good = [r for r in found if r.error is None]
    assert {r.source for r in good} == {"good"} and len(good) == 100 and good[0].bookUrl == "http://a/b0" and {r.page for r in good} == {2}
    assert {r.source for r in found if r.error is not None} == {"absent", "broken", "script"}
    with pytest.raises(RuleError):
        crawl.search_all(sources, pages, "x", page=11)


def test_frontier_caps(spark):
    """Many next pages on one level count as well as a chain does."""
    start = spark.createDataFrame([("a", "u0"), ("b", "v0")], "book string, url string")
    links = spark.createDataFrame([("u0", ["u1", "u2", "u3"]), ("u1", ["u9"]), ("v0", ["v1"]), ("v1", ["v0"])], "url string, targets array<string>")
    found = sorted((r.book, r.url) for r in crawl.frontier(start, links, 5).collect())
    assert found == [("a", "u0"), ("a", "u1"), ("a", "u2"), ("a", "u3"), ("b", "v0"), ("b", "v1")]
    with pytest.raises(RuleError, match="over 3"):
        crawl.frontier(start, links, 3)


def test_formatted_titles(spark):
    register_rule_function("tidy", lambda title: title.strip("* "))
    start = spark.createDataFrame([("a", "u")], "book string, url string")
    pages = spark.createDataFrame([("u", "<li><a href='/1'>* one *</a></li><li><a href='/2'>two</a></li>")], "url string, html string")
    rules = {"chapterList": "@css:li > a", "chapterName": "text", "chapterUrl": "href", "formatJs": "tidy(result)"}
    assert [(r["index"], r.name) for r in crawl.chapter_list(start, pages, rules).orderBy("index").collect()] == [(1, "one"), (2, "two")]


def test_functions_reach_the_executors(spark):
    register_rule_function("louder", lambda text: text + "!")
    rows = spark.createDataFrame([("<p>a</p>",)], "html string").repartition(2)
    assert rows.select(rule_text("html", "@css:p@text@js:louder(result)").alias("v")).first().v == "a!"
    entries = spark.createDataFrame([("t", "louder", "x"), ("u", "", "y"), ("w", None, None)], "title string, action string, value string")
    found = {r.title: (r.actionResult, r.infoMap) for r in crawl.explore_actions(entries).collect()}
    assert found == {"t": ("x!", {"t": "x"}), "u": ("y", {"u": "y"}), "w": ("", None)}

"""Joins by identity, discovery entries, chapter hashes and pagination against plain loops."""

import functools
import itertools
import json
import random

from pyspark.sql import functions as F

from fieldloom import catalog_io
from fieldloom.functions.text import match_name
from fieldloom.operators import crawl, search, shelf
from fieldloom.operators.evaluate import register_rule_function
from fieldloom.plans.errors import RuleError

ENTRY = "id string, bookUrl string, name string, author string, origin string"


def find_by_hand(book, entries):
    """(pos, tier, ambiguous) by comparing a book with every entry."""
    clean = lambda x: (x or "").strip()
    i, url, name, author, origin = map(clean, book)
    entries = [(p, *map(clean, e)) for p, *e in entries]
    for tier, test in ((1, lambda e: i and e[1] == i), (2, lambda e: url and e[2] == url)):
        if found := [e[0] for e in entries if test(e)]:
            return min(found), tier, False
    same = [e for e in entries if name and e[3] == name and (not author or not e[4] or e[4] == author)]
    if found := [e[0] for e in same if not origin or e[5] == origin]:
        return min(found), 3, False
    return (same[0][0], 4, False) if len(same) == 1 else (None, 4, True) if same else None


def test_identity_against_every_pair(spark):
    rng = random.Random(6)
    some = lambda n, *blank: rng.choice([f"{n}{k}" for k in range(4)] + list(blank))
    entries = [(p, some("i", "", None, None), some("u", "", " ", None, None, "x"), some("n", ""), some("a", "", None), some("o", "", "")) for p in range(60)]
    books = [(b, some("j", "", "", "i1"), some("v", "", None, "u1"), some("n", "", "n9"), some("a", "", None, "a9"), some("o", "", "o9")) for b in range(300)]
    found = shelf.find_shelf(spark.createDataFrame(books, "book int, " + ENTRY), spark.createDataFrame(entries, "pos int, " + ENTRY))
    expected = {b: hit for b, *book in books if (hit := find_by_hand(book, entries))}
    assert {r.book: (r.pos, r.tier, r.ambiguous) for r in found.collect()} == expected
    assert {t for _, t, _ in expected.values()} == {1, 2, 3, 4} and {a for _, _, a in expected.values()} == {True, False}


def test_many_authors_of_one_name(spark):
    """100000 authors under one name on both sides: rows stay as many as the groups, in time."""
    rows = spark.range(100_000)
    entry = lambda kind: [F.lit("").alias("id"), F.lit(None).cast("string").alias("bookUrl"), F.lit("same").alias("name"), F.concat(F.lit("author "), "id").alias("author"), F.lit("").alias("origin")]
    books = rows.select(F.col("id").alias("book"), *entry("b"))
    entries = rows.select((F.col("id") * 2).alias("pos"), *entry("s"))
    found = shelf.find_shelf(books, entries).agg(F.count("*").alias("n"), F.sum("pos").alias("p")).first()
    assert (found.n, found.p) == (100_000, 2 * sum(range(100_000)))
    hits = rows.select(F.lit("same").alias("name"), F.concat(F.lit("Author-"), "id").alias("author"), F.lit("u").alias("url"), F.lit("s").alias("source"), F.col("id").alias("arrival"))
    wanted = rows.select(F.col("id").alias("book"), F.lit("same").alias("name"), F.concat(F.lit("author"), "id").alias("author"))
    best = search.candidate_summary(hits, wanted).agg(F.count("*").alias("n"), F.sum((F.col("score") == 3).cast("int")).alias("s"), F.sum("n").alias("hits")).first()
    assert best.n == best.s == 100_000 and best.hits == sum(len(str(x)) for x in range(100_000))  # a number holds each of its beginnings


def test_candidates_against_every_pair(spark):
    rng = random.Random(9)
    authors = ["", "a", "ab", "abc", "b c", "A.B", "xyz", "zabz", "aaaa", None, "é中", "中"]
    hits = [(rng.choice(["s1", "s2"]), rng.choice(["u1", "u2", "", None]), rng.choice(["N", "n ", "m", ""]), rng.choice(authors), k) for k in range(200)]
    books = [(b, rng.choice(["N", "-n-", "m", "none", ""]), rng.choice(authors)) for b in range(80)]
    h = spark.createDataFrame(hits, "source string, url string, name string, author string, arrival int")
    w = spark.createDataFrame(books, "book int, name string, author string")
    clean = {r.x: r.y for r in spark.createDataFrame([(x,) for x in {*authors, "N", "n ", "m", "", "-n-", "none"}], "x string").select("x", match_name("x").alias("y")).collect()}
    expected = []
    for b, name, author in books:
        fits = [(3 if clean[author] and clean[author] in (clean[a] or "") else 2, k, s, u) for s, u, n, a, k in hits if (u or "").strip() and clean[name] and clean[n] == clean[name]]
        if fits:
            score = max(f[0] for f in fits)
            own = [f for f in fits if f[0] == score]
            expected.append((b, score, len(own), *min(f[1:] for f in own)))
    found = [(r.book, r.score, r.n, r.arrival, r.source, r.url) for r in search.candidate_summary(h, w).collect()]
    assert sorted(found) == sorted(expected)


def test_entries_of_every_shape(spark):
    long = {"title": " T ", "exploreUrl": " /u ", "inputType": "SELECT", "onClick": "go()", "paramKey": "p", "options": ["a", " ", 2, " b "], "default": 5, "value": True, "viewName": "v", "style": {"w": 1, "deep": {"x": 1}, "on": False}}
    cases = {
        "lines": (" A::/a \r\nB && C::http://c::d \n\nhttps://x/y\n@js:go()\n::", [("A", "/a"), ("B", ""), ("C", "http://c::d"), ("https://x/y", "https://x/y"), ("@js:go()", "@js:go()")]),
        "array": (json.dumps([{"title": "a", "url": "/1"}, {"name": "b", "exploreUrl": "/2"}, {"text": "c"}, {"label": "d", "url": None}, {"viewName": "e"}, "F::/f", "/bare", 7, None, True, {}, {"url": "/only"}, []]), [("a", "/1"), ("b", "/2"), ("c", ""), ("d", ""), ("e", ""), ("F", "/f"), ("/bare", "/bare"), ("7", ""), ("", "/only")]),
        "map": ('{"z": "/sort/2", "a": {"url": "/1"}, "m": "x::/3", "k": {"title": "own", "url": "/4"}, "n": null}', [("a", "/1"), ("own", "/4"), ("x", "/3"), ("/sort/2", "/sort/2")]),
        "single": ('{"name": "one", "url": "/1", "x": "/y"}', [("one", "/1")]),
        "full": (json.dumps([long]), [("T", "/u")]),
        "broken": ("[not json::/x", [("[not json", "/x")]),
        "none": ("[]", []), "blank": ("  ", []), "null": (None, []), "object": ("{}", []),
    }
    rows = search.explore_entries(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "pos string, exploreUrl string"), "pos").orderBy("pos", "index").collect()
    for name, (_, wanted) in cases.items():
        own = [r for r in rows if r.pos == name]
        assert [(r.title, r.url) for r in own] == wanted, name
        assert [r["index"] for r in own] == list(range(1, len(own) + 1))
    (full,) = [r for r in rows if r.pos == "full"]
    assert (full.type, full.action, full.key, full.chars, full.default, full.value, full.viewName, json.loads(full.style)) == ("select", "go()", "p", ["a", "2", "b"], "5", "true", "v", {"w": 1, "on": False})
    plain = [r for r in rows if r.pos == "lines"][0]
    assert (plain.type, plain.action, plain.key, plain.chars, plain.default, plain.style) == ("url", "", "A", [], None, None)
    buttons = [{"title": "b", "action": "x"}, {"title": "u", "action": "x", "url": "/"}, {"title": "c", "chars": "x, y|z\n"}]
    made = search.explore_entries(spark.createDataFrame([(1, json.dumps(buttons))], "pos int, exploreUrl string"), "pos").orderBy("index").collect()
    assert [r.type for r in made] == ["button", "url", "url"] and made[2].chars == ["x", "y", "z"]


def test_session_numbers(spark, monkeypatch):
    """The hash of each list by a fold over all its values in order, with ranges that lists reach over."""
    monkeypatch.setattr(shelf, "RANGE", 7)
    rng = random.Random(3)
    books = [(b, f"key{b}", "http://s/é" if b % 2 else None, f"n{b}") for b in range(6)]
    chapters = [(b, i, None if i % 11 == 0 else f"Ch {i} 中" * (i % 3), f"/c/{rng.random()}", i % 4 == 0) for b in range(5) for i in range(1, [1, 7, 8, 40, 0][b] + 1)]

    def fold(texts):
        h = 5381
        for t in texts:
            for v in (len((t or "").encode()), *(t or "").encode(), 0):
                h = (h * 33 + v) % (2**31 - 1)
        return h

    expected = {}
    for b, key, url, name in books:
        own = [c for c in chapters if c[0] == b]
        expected[b] = fold([key, url, name, str(len(own)), *itertools.chain.from_iterable((str(i), n, u, "1" if vip else "0") for _, i, n, u, vip in own)])
    found = shelf.session_ids(spark.createDataFrame(books, "book int, key string, sourceUrl string, sourceName string"), spark.createDataFrame(chapters, "book int, index int, name string, url string, vip boolean").repartition(3))
    assert {r.book: r.session for r in found.collect()} == expected


def test_a_list_from_zero_stands_behind_its_head(spark):
    """The head comes before all chapters. Those up to 0 were in one range with it, in any order, and earlier ones in front of it."""
    books = spark.createDataFrame([(b, f"k{b}") for b in range(300)], "book int, key string").selectExpr("book", "key", "'u' AS sourceUrl", "CAST(NULL AS string) AS sourceName")
    chapters = spark.range(900).selectExpr("CAST(id % 300 AS int) AS book", "CAST(id div 300 * 1000 - 1500 AS int) AS index", "concat('c', id) AS name", "'x' AS url", "false AS vip")
    fold = lambda texts: functools.reduce(lambda h, t: functools.reduce(lambda a, x: (a * 33 + x) % (2**31 - 1), [len(t), *t.encode(), 0], h), texts, 5381)
    expected = {b: fold([f"k{b}", "u", "", "3", *(x for i in range(3) for x in (str(i * 1000 - 1500), f"c{b + 300 * i}", "x", "0"))]) for b in range(300)}
    found = shelf.session_ids(books, chapters)
    assert {r.book: r.session for r in found.collect()} == expected


def test_sessions_tell_texts_apart_that_begin_alike(spark, tmp_path):
    """The query used to take the first sixty characters of a text."""
    rows = [(i, 0, "user", "é" * 60 + end) for i, end in enumerate(["", "a", "b", "b" * 5000])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    fold = lambda texts: functools.reduce(lambda h, t: functools.reduce(lambda a, x: (a * 33 + x) % (2**31 - 1), [len(t.encode()), *t.encode(), 0], h), texts, 5381)
    found = catalog_io.list_sessions(spark, str(tmp_path)).collect()
    assert {r.book: r.session for r in found} == {i: fold([f"k{i}", "u", "", "1", "0", "user", text, "1"]) for i, _, _, text in rows}


def test_a_failing_field_is_left_out_from_there(spark):
    """Each optional field is tried up to the item where it fails first, once for each page; name and address go on."""
    tried = spark.sparkContext.accumulator(0)

    def picky(text):
        tried.add(1)
        if text == "bad":
            raise RuleError("no kind")
        return text.upper()

    register_rule_function("picky", picky)
    page = lambda kinds: "".join(f"<li><a href='/{i}'>b{i}</a><i>{k}</i></li>" for i, k in enumerate(kinds))
    pages = spark.createDataFrame([("http://h/1", page(["x", "y", "bad", "z", "bad"])), ("http://h/2", page(["p", "q"])), ("http://h/3", page(["bad", "r"])), ("http://h/4", "")], "url string, html string").coalesce(1)
    rules = {"bookList": "@css:li", "name": "@css:a@text", "bookUrl": "@css:a@href", "kind": "@css:i@text@js:picky(result)", "intro": "@css:i@text"}
    rows = sorted(crawl.extract_books(pages, rules).collect(), key=lambda r: (r.url, r.bookUrl))
    assert [(r.url[-1], r.name, r.kind, r.intro) for r in rows] == [("1", "b0", "X", "x"), ("1", "b1", "Y", "y"), ("1", "b2", None, "bad"), ("1", "b3", None, "z"), ("1", "b4", None, "bad"), ("2", "b0", "P", "p"), ("2", "b1", "Q", "q"), ("3", "b0", None, "bad"), ("3", "b1", None, "r")]
    assert tried.value == 3 + 2 + 1
    assert sorted((r.url[-1], r.field, r.item, r.error) for r in crawl.failed_fields(pages, rules).collect()) == [("1", "kind", 2, "no kind"), ("3", "kind", 0, "no kind")]


def test_pages_are_parsed_once(spark):
    """Ten levels of 20 books that share their later pages: each page that is reached is parsed once, others never."""
    parsed = spark.sparkContext.accumulator(0)

    def count(text):
        parsed.add(1)
        return text

    register_rule_function("counted", count)
    html = lambda n: f"<li><a href='/c{n}'>c{n}</a></li>" + (f"<a class=n href='/{n + 1 if n < 100 or n % 10 < 9 else 0}'>" if n % 10 < 9 or n >= 100 else "")
    pages = spark.createDataFrame([(f"http://h/{n}", html(n)) for n in range(300)], "url string, html string").repartition(3)
    start = spark.createDataFrame([(f"b{b}", f"http://h/{10 * b % 50}") for b in range(20)], "book string, url string")
    rules = {"chapterList": "@css:li", "chapterName": "a@text", "chapterUrl": "a@href", "nextTocUrl": "@css:a.n@href@js:counted(result)"}
    rows = crawl.chapter_list(start, pages, rules).collect()
    assert len(rows) == 200 and {r["index"] for r in rows} == set(range(1, 11))
    assert parsed.value == 50

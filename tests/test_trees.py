"""Node tables and JSON trees: rules as joins and windows against the evaluator and against plain loops."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import chains, css, indexes, json_tree, jsonpath, many, nodes, trees, xpath_joins
from fieldloom.operators.evaluate import Evaluator
from fieldloom.operators.staging import kept
from fieldloom.plans.errors import RuleError, UnsupportedRule

E = Evaluator("full")


def random_page(rng):
    def element(depth):
        tag = rng.choice(["div", "div", "ul", "li", "li", "p", "p", "a", "b", "svg:g"])
        attrs = "".join(f' {k}="{rng.choice(values)}"' for k, values in (("class", ["x", "x y", "z"]), ("id", ["one", "two"]), ("href", ["/p/1", "/q/2?x=1"]), ("n", ["1", "2", "10", "02", "k"])) if rng.random() < 0.4)
        inner = "".join(rng.choice([lambda: element(depth + 1), lambda: rng.choice(["t", " two  words ", "", "10", "x"])])() for _ in range(rng.randint(0, 6 if depth < 4 else 0)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return "".join(element(0) for _ in range(rng.randint(0, 3)))


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    return {i: random_page(rng) for i in range(60)} | {100: "", 101: None, 102: "text only", 103: "<ul>" + "<li class=x><a href=/p/1>t</a></li>" * 50 + "</ul>"}


@pytest.fixture(scope="module")
def table(spark, pages):
    made = spark.createDataFrame(list(pages.items()), "page long, html string").repartition(4)
    return kept(nodes.shred_html(made, "page", "html"), "nodes")


def test_blocks_cover_exactly(spark):
    """Every number is in one block of a range's cover if it lies in the range, else in none; no cover is long."""
    rng = random.Random(2)
    ranges = [(a, b) for a in range(0, 9) for b in range(a - 1, 12)] + [(a, a + rng.randint(0, 10**6)) for a in (rng.randint(0, 10**6) for _ in range(200))] + [(1, 2**29), (0, 2**29 - 1), (5, 5)]
    df = spark.createDataFrame(ranges, "a long, b long").select("a", "b", trees.covering_blocks(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        parts = sorted((x.block << x.level, (x.block + 1 << x.level) - 1) for x in r.c)
        assert [p[0] for p in parts] == [r.a, *[p[1] + 1 for p in parts[:-1]]] and parts[-1][1] == r.b if r.b >= r.a else not parts
        assert len(parts) <= 2 * max(1, (r.b - r.a + 1).bit_length())


def test_pairs_below(spark, table):
    """Each context with all that is below it, as a comparison of every number with every range finds them."""
    rows = [(r.doc_id, r.node_id, r.last_id) for r in table.collect()]
    by_doc = [list(g) for _, g in itertools.groupby(sorted(rows), key=lambda r: r[0])]
    for own in (False, True):
        expected = sorted((d, a, b) for own_rows in by_doc for (d, a, end), (_, b, _) in itertools.product(own_rows, own_rows) if (a <= b if own else a < b) and b <= end)
        found = trees.pairs_below(table.withColumn("up", F.col("node_id")), table, ["up"], own)
        assert sorted((r.doc_id, r.up, r.node_id) for r in found.collect()) == expected
    inner = table.where("tag = 'li'")
    li = {(r.doc_id, r.node_id) for r in inner.collect()}
    assert sorted((r.doc_id, r.node_id) for r in trees.has_below(table, inner).collect()) == sorted((d, a) for d, a, end in rows if any((d, b) in li for b in range(a + 1, end + 1)))
    assert sorted((r.doc_id, r.node_id) for r in trees.below_any(table, inner).collect()) == sorted({(d, b) for d, a, end in rows if (d, a) in li for b in range(a + 1, end + 1)})
    own_ranges = {g[0][0]: [(c, e) for _, c, e in g] for g in by_doc}
    top = {(r.doc_id, r.node_id) for r in trees.outermost(inner.select("doc_id", "node_id", "last_id")).collect()}
    assert top == {(d, a) for d, a, end in rows if (d, a) in li and not any((d, c) in li and c < a <= e for c, e in own_ranges[d])}


def test_picks_exhaustively(spark):
    """Index suffixes as columns against Indexes.pick."""
    rng = random.Random(4)
    ends = [None, *range(-6, 7)]
    some = [indexes.Indexes(tuple(indexes.Span(rng.choice(ends), rng.choice(ends), rng.choice([1, 1, 2, 3, -1, -2, 0, -9])) for _ in range(rng.randint(1, 3))), rng.random() < 0.3) for _ in range(120)]
    lists = spark.createDataFrame([(n, k) for n in range(6) for k in range(n)], "n int, k int")
    got = lists.select("n", "k", *[trees.pick_order(x, F.col("k"), F.col("n")).alias(f"p{i}") for i, x in enumerate(some)]).collect()
    for i, x in enumerate(some):
        for n in range(6):
            mine = sorted((r[f"p{i}"], r.k) for r in got if r.n == n and r[f"p{i}"] is not None)
            assert [k for _, k in mine] == x.pick(list(range(n))), (x, n)


RULES = [
    "tag.li.0@text", "tag.li.-1@href", "li[0:2]@class", "tag.a!0@href", "div@li@text", "div@tag.li.0@text", "div@li@a[0,-1]@href", "ul@children@n", "class.x@class.y@text", "id.one@text", "text.two@ownText", "div.0@b[::2]@text", "div@p[-1:0]@text",
    "li!0:1@n", "div@div@div@text", "div div@li.1@text", "-@css:li@n", "@css:li:eq(1)@text", "@css:div a:last@href", "@css:li, b@text", "@css:div > li ~ p@text", "@css:div:has(b)@class", "@css:li:not(.x) + li@n",
    "//li[1]/text()", "//li[last()]/@n", "//div/li[position()<3]", "//a[@href]/@href", "//a[contains(@href,'q')]/..", "//div//li", "//div//b/text()", "/div/li", "//*[@n>1]/@n", "//*[@n=2]/@n", "//*[@n!='1' and @class]/@class", "//div[li]/@class", "//div[count(li)>1]/@n",
    "//div[.//b]/@id", "//li[a/@href='/p/1']/@class", "//li | //b", "//li/@n | //p", "//p[not(@class) or @id='one']/text()", "//div[normalize-space(.)='t']/@class", "//*[string-length(text())=1]", "//li[2][@class]/@class", "//g/text()", "//div[//b]/@n", "//@href", "//p[starts-with(text(),'two')]",
    "//div[last()-1]/@class", "//ul/node()/@n", "//li/string()", "//div/.././/b", "//*[10]/@n", "//div[li[2]]/@class", "//li[ends-with(@href,'1')]/a",
]


@pytest.mark.parametrize("part", range(4))
def test_rules_against_the_evaluator(table, pages, part):
    rules, idle = RULES[part::4], 0
    found = {r.doc_id: r for r in chains.rules_values(table, {f"r{i}": rule for i, rule in enumerate(rules)}).collect()}
    for i, rule in enumerate(rules):
        some = 0
        for page, html in pages.items():
            expected = E.parse_list(html or "", rule)
            mine = (found[page][f"r{i}"] if page in found else None) or []
            assert mine == expected, (rule, page, html)
            some += bool(expected)
        idle += not some
    assert idle <= 1  # nearly every rule finds something somewhere


def test_no_product_in_a_large_document(spark):
    """A page of 20000 nodes, half of them within each other's reach: pairs are as many as the lists are long."""
    html = "<div>" + "<p><b>x</b><i>y</i></p>" * 5000 + "</div>"
    table = kept(nodes.shred_html(spark.createDataFrame([(1, html)], "page long, html string"), "page", "html"), "nodes")
    assert chains.chain(table, ["div", "p", "b"]).count() == 5000
    plan = chains.chain(table, ["div", "p", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert xpath_joins.xpath_nodes(table, "//div//b").count() == 5000 and nodes.select_nodes(table, "div p:has(i) b").count() == 5000
    for rule in ("@css:p@html", "##a##b", "$.x"):
        with pytest.raises(UnsupportedRule):
            chains.rule_values(table, rule)
    with pytest.raises(RuleError):
        xpath_joins.xpath_nodes(table, "//p/@k")


def random_json(rng, depth=0):
    kinds = [lambda: rng.choice(["x", "y", "", "10", "2.5", "é\"\n"]), lambda: rng.choice([0, 1, 2, 10, -3, 2.5, 1.0, 12345678901]), lambda: rng.choice([True, False, None])]
    if depth < 4:
        kinds += [lambda: [random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))], lambda: {k: random_json(rng, depth + 1) for k in rng.sample(["a", "b", "c", "items", "Z", "é"], rng.randint(0, 4))}] * 2
    return rng.choice(kinds)()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    made = {i: {"items": [random_json(rng, 1) for _ in range(rng.randint(0, 6))], "a": random_json(rng), "b": {"items": [{"a": rng.choice([1, 2, "1", None, True, "x"]), "b": rng.randint(0, 3), "c": ["x", "y", 1][: rng.randint(0, 3)]} for _ in range(5)]}} for i in range(50)}
    plain = {i: json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in made.items()}
    return plain | {100: "[]", 101: '"s"', 102: "7", 103: '[[1,2],[3,[4]]]'}


@pytest.fixture(scope="module")
def tree(spark, texts):
    rows = [*texts.items(), (200, None), (201, "not json"), (202, "")]
    return json_tree.shred_json(spark.createDataFrame(rows, "page long, j string").repartition(4), "page", "j")


def sorted_keys(value):
    return {k: sorted_keys(value[k]) for k in sorted(value)} if isinstance(value, dict) else [sorted_keys(v) for v in value] if isinstance(value, list) else value


def test_json_tree(tree, texts):
    """Numbers, ranges, parents and values against a walk through the parsed documents."""
    expected = []

    def walk(doc, value, parent, key, pos, of, depth):
        at = len([r for r in expected if r[0] == doc])
        expected.append(None)
        members = list(enumerate(value)) if isinstance(value, list) else sorted(value.items()) if isinstance(value, dict) else []
        row = len(expected) - 1
        expected[row] = (doc, at)
        for i, (k, v) in enumerate(members):
            walk(doc, v, at, k if isinstance(value, dict) else None, i, len(members), depth + 1)
        last = len([r for r in expected if r[0] == doc]) - 1
        kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "null" if value is None else "number"
        expected[row] = (doc, at, last, parent, depth, key, pos, of, kind, jsonpath.text_of(sorted_keys(value)) if kind not in ("array", "object") else None)

    for doc, text in texts.items():
        walk(doc, json.loads(text), -1, None, None, 1, 0)
    found = [(r.doc_id, r.node_id, r.last_id, r.parent_id, r.depth, r.key, r.pos, r.of, r.kind, r.value if r.kind not in ("array", "object") else None) for r in tree.collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert {r.doc_id: r.doc_last for r in tree.collect()} == {d: max(x[1] for x in expected if x[0] == d) for d in texts}


PATHS = [
    "$.a", "$.items[0]", "$.items[-1]", "$.items[1:2]", "$.items[-2:]", "$.items[::-1]", "$.items[0:9:2]", "$.items[9:20]", "$.items[-1:-3:-1]", "$.items[0,-1,0]", "$.items[*]", "$.b.items[*].a", "$.b.*", "$..a", "$..items[0]", "$..*", "$.none.at", "$.b['items'][0]['c']", "$[0]", "$[1][1][0]", "$..b..a", "$.items[0:2,0]",
    "$.b.items[?(@.b > 1)].a", "$.b.items[?(@.a == 1)].b", "$.b.items[?(@.a == '1')].b", "$.b.items[?(@.a != 1 && @.b >= 2)].b", "$.b.items[?(@.c)].b", "$.b.items[?(!@.c[1])].b", "$.b.items[?(contains(@.c, 'x'))].b", "$.b.items[?(contains(@.a, 'x') || @.b == 0)].b", "$.b.items[?(@.b < @.a)].b",
    "$.items[?(@ == 'x')]", "$.items[?(@ > 1)]", "$.items[?(@ >= 'x')]", "$..[?(@.b)].b", "$.b.items[?(@.c[0] == 'x' && (@.b == 1 || @.b == 2))].b", "$.b.items[?(@.a == null)].b", "$.b.items[?(@.a == true)].b", "$.items[0][0]", "$.items[*][0]", "$.items[*].*",
]


@pytest.mark.parametrize("part", range(3))
def test_json_paths_against_the_evaluator(tree, texts, part):
    paths = PATHS[part::3]
    found = {r.doc_id: r for r in json_tree.json_values(tree, {f"r{i}": p for i, p in enumerate(paths)}).collect()}
    for i, path in enumerate(paths):
        for doc, text in texts.items():
            expected = [v for v in (jsonpath.text_of(sorted_keys(x)) for x in jsonpath.find(sorted_keys(json.loads(text)), path)) if v != ""]
            mine = (found[doc][f"r{i}"] if doc in found else None) or []
            assert list(map(loose, mine)) == list(map(loose, expected)), (path, doc, text)


def loose(value):
    """Containers as values: 1.0 within them is written as 1."""
    return json.loads(value) if value[:1] in ("[", "{") else value


def test_json_rows(tree, texts):
    found = {}
    for r in json_tree.json_rows(tree, "$.items").orderBy("doc_id", "place").collect():
        found.setdefault(r.doc_id, []).append(r.value)
    for doc, text in texts.items():
        value = json.loads(text)
        expected = [jsonpath.text_of(sorted_keys(v)) for v in (value["items"] if isinstance(value, dict) else [])]
        assert list(map(loose, found.get(doc, []))) == list(map(loose, expected))


def test_json_plans_hold_no_python(tree):
    for path in PATHS:
        plan = json_tree.json_values(tree, {"x": path})._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


SELECTORS = [
    "li", "li.x", "div li", "div > li", "div li.x", "div li.x a", "ul > li > a", "div div", "div div div", "#one", "div#one li", "[href]", "a[href^='/p']", "*[n='2']", ".x.y", ".y.x", "li + li", "li ~ p", "div li + p", "li, b", "div > p, #two b", "*", "div *", "p[n!='1']", "a[href$='1'][n]", "[href~=p|q]", "none", "ul li.none",
    "div > li.x > a", "b[class|=x]", "div > * > b",
]


@pytest.fixture(scope="module")
def selectors(spark):
    return spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(SELECTORS)], "rule string, selector string").repartition(3)


def test_many_selectors_at_once(spark, table, selectors):
    """All together find what each finds alone."""
    found = {}
    for r in many.match_selectors(table, selectors).collect():
        found.setdefault(r.rule, []).append((r.doc_id, r.node_id))
    for i, selector in enumerate(SELECTORS):
        alone = sorted((r.doc_id, r.node_id) for r in nodes.select_nodes(table, selector).collect())
        assert sorted(found.get(f"r{i}", [])) == alone, selector
    scope = spark.createDataFrame([(d, f"r{(d * 7 + k) % 40}") for d in range(110) for k in range(3)], "doc_id long, rule string")
    wanted = {(r.doc_id, r.rule) for r in scope.collect()}
    scoped = sorted((r.rule, r.doc_id, r.node_id) for r in many.match_selectors(table, selectors, scope).collect())
    assert scoped == sorted((rule, d, n) for rule, places in found.items() for d, n in places if (d, rule) in wanted)


def test_shared_steps_are_one_state(spark, selectors):
    a = many.Automaton(selectors)
    rows = a.transitions.collect()
    assert a.length == 3 and len({(r.before, r.combinator, r.key) for r in rows}) == len(rows)
    assert len([r for r in rows if r.n == 0 and r.key == "div"]) == 1 and len([r for r in a.compounds.collect() if r.key == "*.x.y"]) == 1
    with pytest.raises(Exception, match="among many"):
        many.match_selectors(spark.createDataFrame([], "doc_id int"), spark.createDataFrame([("r", "li:first")], "rule string, selector string"))


def test_items_and_fields_of_many_rules(spark, table, pages):
    rules = [("s1", "", "li", "text"), ("s1", "link", "a", "href"), ("s1", "all", "b, a", "text"), ("s2", "", "div > p", "text"), ("s2", "n", "[n]", "n"), ("s2", "own", "b", "ownText"), ("s3", "", "none", "text"), ("s3", "x", "a", "text")]
    found = {(r.rule, r.doc_id, r["item"], r.field): r.value for r in many.extract_many(table, spark.createDataFrame(rules, "rule string, field string, selector string, mode string")).collect()}
    expected = {}
    for page, html in pages.items():
        for rule in ("s1", "s2", "s3"):
            (listed,) = [s for r, f, s, _ in rules if r == rule and not f]
            for item, node in enumerate(E.elements(html or "", f"@css:{listed}")):
                for r, field, selector, mode in rules:
                    if r == rule and field:
                        values = [node.document.value(n, mode) for n in css.select(node.document, node.number, selector)]
                        if any(values):
                            expected[rule, page, item, field] = "\n".join(v for v in values if v)
    assert found == expected and len({k[3] for k in found}) == 4


def test_trees_are_not_put_together_in_the_driver(spark, capsys):
    """Joins with a written tree deal both sides, whatever the size of its files says."""
    docs = spark.createDataFrame([(1, '{"items": [{"a": 1}, {"a": 2, "b": {"a": 3}}]}')], "id int, j string")
    found = json_tree.json_values(json_tree.shred_json(docs, "id", "j"), {"deep": "$..a", "all": "$.items[*].*", "some": "$.items[?(@.a > 1)].a"})
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert found.select("deep", "some").collect()[0] == (["1", "2", "3"], ["2"])

import pytest

from fieldloom.operators.evaluate import Evaluator
from fieldloom.operators.nodes import pick_position, select_nodes, shred_html
from fieldloom.plans.columns import apply_text_rule, extract, rule_elements, rule_list, rule_text

H = "<ul><li class='a b'>1<b>x</b></li><li>2</li><li id='z'>3</li></ul><p>t<br>u"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, H), (2, ""), (3, None), (4, "a1 b22")], "id int, c string")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lowered_rules_need_no_python(df):
    for rule in (r"@regex:[a-z](\d+)", "@text:x && @text:y", r"@regex:\d##\d##[$&]", r"@regex:x || @regex:\d+", r"@regex:[a-z] %% @regex:\d", "-@regex:\\d", "$.a.b"):
        frame = df.where("id = 4").select(rule_list("c", rule).alias("v"))
        assert "ArrowEvalPython" not in plan(frame), rule
        text = df.where("id = 4").first().c
        if not rule.startswith("$"):
            assert frame.first().v == Evaluator("full").parse_list(text, rule), rule


def test_first_only_replacement(df):
    out = df.where("id = 4").select(apply_text_rule("c", r"##(\d+)##<$1>##").alias("a"), apply_text_rule("c", r"##(\d+)##<$1>").alias("b"), apply_text_rule("c", "##zz##y##").alias("c"))
    assert tuple(out.first()) == ("a<1> b22", "a<1> b<22>", "")
    assert "ArrowEvalPython" not in plan(out)


def test_documents_of_all_kinds(df):
    out = {r.id: r.v for r in df.select("id", rule_text("c", "@css:li@ownText").alias("v")).collect()}
    assert out == {1: "1\n2\n3", 2: "", 3: "", 4: ""}


def test_extract_and_errors(df):
    rows = extract(df.where("id = 1"), "c", {"t": "text", "cls": "class", "bad": "$.x"}, "@css:li", keep=["id"], on_error="column").collect()
    assert [(r.ordinal, r.t, r.cls, r.bad, len(r.errors)) for r in rows] == [(0, "1x", "a b", None, 1), (1, "2", "", None, 1), (2, "3", "", None, 1)]
    put = extract(df.where("id = 1"), "c", {"a": "@put:{k:@css:#z@text}@css:li.a@text", "b": "@get:{k}"}, keep=["id"]).first()
    assert (put.a, put.b) == ("1x", "3")


def test_elements(spark, df):
    rows = rule_elements(df.where("id = 1"), "c", "@css:li").collect()
    assert [r.element for r in rows] == ['<li class="a b">1<b>x</b></li>', "<li>2</li>", '<li id="z">3</li>']


@pytest.mark.parametrize("selector", ["li", "ul > li", "li + li", "li ~ li", ".a", "#z", "li[class]", "li:not(.a)", "li:has(b)", "li:nth-child(2n+1)", "ul b, p", "li:last-child", "li:only-child", "b:only-child"])
def test_joins_agree_with_documents(spark, df, selector):
    nodes = shred_html(df, "id", "c")
    found = sorted((r.doc_id, r.node_id) for r in select_nodes(nodes, selector).collect())
    assert found == [(1, n.number) for n in Evaluator("full").elements(H, "@css:" + selector)]


def test_positions(df):
    nodes = shred_html(df, "id", "c")
    assert [r.own_text for r in pick_position(select_nodes(nodes, "li"), "eq", -1).collect()] == ["3"]
    assert nodes.where("tag = 'p'").first().text == "tu"

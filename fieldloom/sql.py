"""Rules and functions for use from SQL: register(spark), then SELECT rule_list(html, '@css:a@href') FROM pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .functions.content import clean_lines, html_to_text
from .functions.text import chinese_number
from .functions.urls import _join
from .operators.dom import Document
from .operators.evaluate import Evaluator, Node
from .plans.columns import _row_json


def register(spark: SparkSession) -> None:
    """Registers rule_list, rule_text, text_rule, html_text, absolute_url and chinese_number, and the table functions rule_elements and html_nodes.

    Functions and the script engine that rules may call are those that are registered by now."""
    e = Evaluator("full")

    @F.pandas_udf("array<string>")
    def rule_list(texts: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([e.parse_list(t or "", r or "") for t, r in zip(texts, rules)])

    @F.pandas_udf("string")
    def rule_text(texts: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([e.parse_text(t or "", r or "") for t, r in zip(texts, rules)])

    @F.pandas_udf("string")
    def text_rule(texts: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([e.apply_text_rule(t or "", r or "") for t, r in zip(texts, rules)])

    @F.pandas_udf("string")
    def html_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean_lines(html_to_text(t)))

    @F.pandas_udf("string")
    def absolute_url(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([_join(b or "", x) for b, x in zip(bases, links)])

    @F.pandas_udf("long")
    def numeral(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chinese_number(t or "")).astype("Int64")

    for name, f in (("rule_list", rule_list), ("rule_text", rule_text), ("text_rule", text_rule), ("html_text", html_text), ("absolute_url", absolute_url), ("chinese_number", numeral)):
        spark.udf.register(name, f)

    @udtf(returnType="ordinal int, element string")
    class Elements:
        def eval(self, text: str, rule: str):
            for i, row in enumerate(e.elements(text or "", rule)):
                yield i, _row_json(row)

    @udtf(returnType="node_id int, last_id int, parent_id int, tag string, text string, html string")
    class Nodes:
        def eval(self, html: str):
            d = Document(html or "")
            for n in range(1, len(d.tags)):
                node = Node(d, n)
                yield n, d.last[n], d.parents[n], node.tag, node.text(), node.get("all")

    spark.udtf.register("rule_elements", Elements)
    spark.udtf.register("html_nodes", Nodes)


def views(members: DataFrame) -> None:
    """Temporary views sources and bookshelf over the members of a backup."""
    from .sources.backup import shelf_table, source_table

    source_table(members).createOrReplaceTempView("sources")
    shelf_table(members).createOrReplaceTempView("bookshelf")

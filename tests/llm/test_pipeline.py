"""The stages over planted cases, each held against what it should do, and the registered SQL."""

from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import queries, simhash
from fieldloom.llm.shared import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copy = docs.where("doc_id = 3").selectExpr("100000L AS doc_id", "upper(text) AS text", "lang", "source", "n_chars")
    bad = docs.where("doc_id < 2").selectExpr("doc_id + 200000 AS doc_id", "'12 34 !' AS text", "lang", "source", "n_chars")
    now = stage(docs.unionByName(copy).unionByName(bad), "test")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(step(spark, now, SF), "test")
        after = now.collect()
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {200000, 200001}
        if name == "exact_dedup":
            texts = [r.text.encode().lower() for r in after]
            assert len(texts) == len(set(texts)) == len({r.text.encode().lower() for r in before})
        if name == "simhash_dedup":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "mixing":
            words = lambda rows: sum(len(r.text.split()) for r in rows)
            assert abs(words(after) - 1.5 * words(before)) < 0.1 * words(before)
            mixed = after
        if name == "byte_bpe":
            assert sorted((r.doc_id, r.text) for r in mixed) == sorted((r.doc_id, bytes(r.decoded).decode()) for r in after)
        else:
            assert now.columns == columns


def alike(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").encode().lower().split() for t in (a, b))]
    return not sets[0] | sets[1] or len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8


def test_stages_over_edges(spark, edge):
    """Each stage over null and repeated ids, nulls in any column, repeated rows and clashing columns, against brute force."""
    text = lambda r: (r.text or "").encode().lower()
    key = lambda r: str((r.doc_id, r.text, r.source))
    now = edge
    for name, step in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(step(spark, now, SF), "test")
        after = now.collect()
        left = Counter(map(key, after)) if name != "byte_bpe" else None
        if name == "language_id":
            assert left == Counter(key(r) for r in before if any(map(str.isalpha, r.text or "")))
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[text(r)].append(r)
            assert sorted(map(text, after)) == sorted(groups)
            assert all(r.doc_id == max((x.doc_id for x in groups[text(r)] if x.doc_id is not None), default=None) for r in after)
        if name == "simhash_dedup":
            label = list(range(len(before)))
            for _ in before:
                for i, a in enumerate(before):
                    for j, b in enumerate(before[:i]):
                        if alike(a.text, b.text) or bin(simhash.fingerprint(a.text) ^ simhash.fingerprint(b.text)).count("1") <= 2:
                            label[i] = label[j] = min(label[i], label[j])
            first = {}
            for k, r in zip(label, before):
                first[k] = min(first.get(k, r), r, key=lambda r: (r.doc_id is None, r.doc_id or 0))
            assert len(after) == len(first) and not left - Counter(map(key, before))
            assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in first.values())
        if name == "mixing":
            assert set(left) <= set(map(key, before)) and max(left.values()) <= 2 * max(Counter(map(key, before)).values())
        if name == "byte_bpe":
            assert len(after) == len(before)
        else:
            assert now.columns == edge.columns


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_and_unlabelled(spark, edge, none, labelled):
    now, rows = none, edge if labelled else edge.withColumn("lang", F.lit(None).cast("string"))
    for name, step in corpus_pipeline.STAGES:
        now = step(spark, now, SF)
        assert now.count() == 0
        if name != "byte_bpe":
            rows = step(spark, rows, SF)
            assert rows.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    rows = lambda columns, values: sorted(tuple(str(round(v[i], 6) if isinstance(v[i], float) else v[i]) for i in sorted(range(len(columns)), key=lambda k: columns[k])) for v in values)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size string, shard string, name string, pos string, row string, hash string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with the names that operators use."""
    long = " ".join(f"word{i % 977} Lorem" for i in range(20_000))
    passage = "This very passage of more than fifty bytes stands in several documents, with nothing changed."
    texts = [
        (5, "Hello World. A second sentence.\nAnd a line"), (3, "hello world. a second sentence.\nand a line"), (9, "HELLO WORLD. A second sentence.\nAnd a line"), (1, None), (2, ""), (4, "   \n\t"), (6, long), (7, long), (8, long + "!"),
        (10, "x " + passage + " y"), (11, passage), (12, "pre " + passage), (13, passage[:60]), (14, "Ünïcödé ß 中文 don't 😀 we'll İstanbul <|endoftext|> ΑΣ"), (15, "123 456!!! ..."), (None, passage), (None, None), (16, "ab"), (16, "ab"), (17, "ab"), (18, "a" * 5000), (19, "é" * 3000),
    ]
    rows = [(i, t, None if k % 5 == 0 else ["en", "fr"][k % 2], None if k % 7 == 0 else f"s{k % 3}", None, "1", "2", "3", "4", "5", "6", "7") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

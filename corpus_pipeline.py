"""From raw documents to token sequences: language, exact copies, near copies, the mix of sources, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the
last one returns tokens. run() writes what a stage returns to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from fieldloom.llm.queries import vocabulary
from fieldloom.llm.shared import stage, table

#: The least probability of a text's language among the learned ones. Of 6000 documents none was below it, while of texts in
#: other languages some are; a confident error about a language that isn't known can't be told by its score.
MIN_SCORE = 0.4
#: The languages that are wanted; None: all that the labels name.
LANGUAGES: tuple[str, ...] | None = None
#: The least likeness of near copies: common 5-word shingles among all of both texts.
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES, by the network; those without letters, or of some length without a language of at
    least MIN_SCORE, go. A document without a language gets the predicted one."""
    return language_id.keep_identified(docs, MIN_SCORE, LANGUAGES)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest doc_id, of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies: texts that share SIMILARITY of their
    5-word shingles, or whose fingerprints differ in at most 2 bits."""
    return simhash.drop_near_copies(docs, similarity=SIMILARITY, at_rest=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs, at_rest=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, byte offsets of the tokens, and the decoded text."""
    return byte_bpe.encode(docs, vocabulary("byte_bpe_50k.tiktoken"), keep="ids")


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("simhash_dedup", near_copies), ("mixing", mix), ("byte_bpe", tokens)]
#: Language, fingerprints and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

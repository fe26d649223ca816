"""Members of zip archives and folders of text as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .containers import zip_members


def archive_members(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(archive, name, part, content): each file in each zip under path, or those whose name matches the pattern, which are all
    that is read; a long file comes as several parts."""
    return zip_members(spark, path, **({"pattern": pattern} if pattern else {})).drop("size")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each text file whole, line ends unified."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def decoded_members(members: DataFrame, charset: str = "utf-8") -> DataFrame:
    from ..functions.text import decode_charset

    return members.withColumn("text", decode_charset("content", charset))

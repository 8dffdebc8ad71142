"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, odd names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, score double, _score string, "
          "shard int")
LONG = "Once upon a time there was a very long text that went on. " * 4000
UNBROKEN = "xyz" * 20000


def rows() -> list[tuple]:
    texts = [(1, "Plain words make a plain text.", "en", "a"), (2, "Plain words make a plain text.", "en", "a"),
             (2, "Plain words make a plain text.", "en", "a"), (3, None, "en", "b"), (4, "", None, "b"),
             (5, " \t\n", "en", None), (None, "No key but a text.", "en", "a"), (None, None, None, None),
             (6, LONG, "en", "c"), (7, UNBROKEN, "de", "c"), (8, "▁ odd ▁▁ marks  and   blanks ", "fr", "c"),
             (9, "日本語のテキスト 😀 é é \u0000", None, "d"), (10, "12345 67890 !!! ???", "en", "d"),
             (-11, "Licensed under the Apache License, Version 2.0.", "en", "d"), (12, "a", "en", "d")]
    return [(i, t, lang, src, None if t is None else len(t), 7, 0.5, "row", 3) for i, t, lang, src in texts]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as bytes; bytes split at ASCII blanks only."""
    return (text or "").encode().lower().split()

"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark, extra: str = ""):
    """extra: a clashing column name to add."""
    long = "lorem ipsum dolor " * 3000
    rows = [
        (1, "one two  three", "en", "a", 14), (2, "one two\nthree", None, None, None), (3, "", "en", "a", 0), (4, None, "en", "a", None), (5, long, "en", "a", 1), (6, "   \n ", "en", "b", 5),
        (7, "one two three", "en", "a", 13), (7, "one two three", "en", "a", 13), (None, "one two three", "en", "a", 13), (8, "unique text of its own", "en", "a", 1), (9, "ünïcödé 漢字 🙂 <|endoftext|>", "de", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn(extra, df.n_chars) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)

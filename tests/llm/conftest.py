from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AZ = str.maketrans(UPPER, LOWER)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 700}x{i // 9}" for i in range(20_000))
    rows = [
        (1, "alpha beta gamma " * 30, "en", "a", 1), (2, "alpha beta gamma " * 30, "en", "b", 1), (2, "alpha beta gamma " * 30, "en", "b", 1),
        (None, "alpha beta gamma " * 30, None, None, None), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \n\t ", "en", "a", 4), (6, "x", "en", "a", 1),
        (7, long, "en", "b", len(long)), (8, "naïve ▁ 日本 🎈", "fr", "c", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("score", "bin", "rep", "label", "bucket", "size", "w", "key", "number", "value", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 1), (8, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> dict:
    return {r.doc_id: r.text for r in documents.collect()}

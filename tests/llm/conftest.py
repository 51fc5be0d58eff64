from __future__ import annotations

import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, score double, n_words string, signature string, key string"
    rows = [
        (1, None, "en", "a", 0.5, "x", "s", "k"), (2, "", None, None, None, None, None, None), (3, "the cat sat on the mat today", "en", "a", 1.0, "y", "s", "k"),
        (3, "the cat sat on the mat today", "en", "a", 1.0, "y", "s", "k"), (4, "the cat sat on the mat today", "de", "b", 1.0, "y", "s", "k"), (None, "no id here at all my friend", "en", "a", 1.0, "y", "s", "k"),
        (5, LONG, "en", "a", 1.0, "y", "s", "k"), (6, " \t\n ", "en", "a", 1.0, "y", "s", "k"), (7, "é 日本 🙂 ÀÉ\n\n# *** 123", "fr", "a", 1.0, "y", "s", "k"),
    ]
    return spark.createDataFrame(rows, schema).repartition(2, "source").cache()


@pytest.fixture(scope="session")
def docs(spark):
    from ..conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet").cache()

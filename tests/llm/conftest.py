from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, node string, found string, score string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, blanks, very long texts, repeated rows, ties, clashing names."""
    long_text = " ".join(f"word{i % 997} of{i}" for i in range(30_000))
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: "x", 5: "one two three", 6: long_text, 7: long_text, 8: "a" * 200_000,
        9: "Straße ÄÖ\U0001f600 été 漢字", 10: "12345 !!", 11: "\x00 nul \x1f",
    }
    rows = [(i, t, "en" if i % 2 else None, None, len(t or ""), 7, "n", "f", "s") for i, t in texts.items()]
    rows += [rows[4], rows[4], (None, "null id", None, None, None, None, None, None, None), (5, "another text of five", "en", "s", 1, 1, "", "", "")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")

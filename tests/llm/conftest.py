import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark, sf):
    from cantiere.llm.common import table

    return table(spark, sf, "documents")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, blank, tied, repeated and very long texts, and columns with clashing names."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, None), (4, "one two", "en", "a", 7),
        (5, "one two", "en", "a", 7), (5, "one two", "en", "a", 7), (None, "null id with a few words in it", "en", "a", 1),
        (None, "null id with a few words in it", "de", "a", 1), (7, long_text, "fr", "b", len(long_text)), (8, long_text + " tail", "fr", "b", 9),
        (9, "Ünïcödé 中文 😀 don't they'll say  12 34", "es", "b", 3), (9, "another text of the same id", "es", "b", 3),
        (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en", "c", 5),
        (11, "A B c d e f g h i j k l m n o p q r s t u v w x y z", "en", "c", 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in ("row", "cid", "score", "kept", "n_words", "part", "label", "rank"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty, blank and very long texts, ties and repeated rows.
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (2, "One TWO three four five six seven eight nine ten", None, "a", None),
    (2, "One TWO three four five six seven eight nine ten", None, "a", None),
    (3, None, "en", None, 0),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (None, "a text without an id of its own", "en", "b", 31),
    (None, None, None, None, None),
    (6, "lorem " * 60_000, "la", "c", 360_000),
    (7, "x" * 200_000, "la", "c", 200_000),
    (8, "\u00c9t\u00e9 \u00e0 la plage, \U0001f600 two words", "fr", "c", 26),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names operators use themselves."""
    docs = spark.createDataFrame(ODD, DOCS)
    return docs.withColumns({c: F.lit("theirs") for c in ("key", "shard", "slot", "score", "size", "count", "class", "n", "pivot", "spans", "mix_position", "item_id", "toxic", "rank")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

import pytest
from pyspark.sql import functions as F

from shelfwatch.llm.ship import ship

PASSAGE = "the quick brown fox jumps over the lazy dog while eleven old men watch the harbour lights go out "
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60000))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "Hello brave new world, how are you today my friend?", "en", "b", 51),
    (5, "Hello brave new world, how are you today my friend?", "en", "b", 51),
    (5, "Hello brave new world, how are you today my friend?", "en", "b", 51),
    (6, "First. " + PASSAGE + "Éßü zum Schluss 日本語 <|endoftext|>", "de", "c", 120),
    (7, "Second! " + PASSAGE + "and then 'tis done; it's we've 12345", "en", "a", 120),
    (None, "Third? " + PASSAGE, "en", None, 100),
    (9, LONG, "en", "d", len(LONG)),
    (10, "x" * 500, "en", "d", 500),
    (11, "one", "en", "e", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns named like the operators' own."""
    ship(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = {c: F.lit(c) for c in ("size", "taken", "rest", "_block", "_key", "_n", "_id", "media", "features", "kept")}
    return df.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.filter("false")

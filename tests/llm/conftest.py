import pytest
from pyspark.sql import types as T

#: Names that the operators use inside, as columns that must not disturb them.
CLASHES = ("id", "key", "token", "spans", "score", "label", "digest", "rules", "base", "ids", "lines", "words", "removed_lines")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with extra columns of clashing names."""
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])

    def make(rows, partitions=3):
        return spark.createDataFrame([(i, t, *(c for c in CLASHES)) for i, t in rows], kind).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and white-space texts, a very long text, ties and repeated rows, and odd characters."""
    long = " ".join(f"word{k % 701} tail{k}" for k in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "a text without a number but with enough words in it"),
        (None, None), (6, long), (7, "Ünïcödé – “quotes” 日本語 \U0001f600 é \x00 \x1c end"), (8, "x" * 50_000),
        (9, "the quick brown fox jumps over the lazy dog and runs into the deep dark forest near the old river mill at dawn"),
        (10, "The quick brown fox jumps over the lazy dog and runs into the deep dark forest near the old river mill at dawn"),
        (11, "the quick brown fox jumps over the lazy dog and runs into the deep dark forest near the old river mill at noon"),
        (9, "the quick brown fox jumps over the lazy dog and runs into the deep dark forest near the old river mill at dawn"),
    ]

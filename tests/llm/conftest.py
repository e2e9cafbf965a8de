import pytest
from pyspark.sql import types as T

#: Every kind of odd row at once, with clashing extra columns.
COLUMNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("window", T.StringType()),
        T.StructField("rate", T.StringType()),
    ]
)


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text) if text is not None else None, "x", "y", "z", "w", "r")


@pytest.fixture(scope="session")
def make(spark):
    def build(rows):
        return spark.createDataFrame([doc(*r) for r in rows], COLUMNS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    long = "the quick brown fox jumps over the lazy dog again and again " * 4000
    return make(
        [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (None, "one two three four five"), (None, None), (4, long), (5, "   \n "), (6, "x", None), (7, "!!! ???"), (8, "ein Haus am See"), (8, "un autre texte ici")]
    )


@pytest.fixture(scope="session")
def empty(make):
    return make([])

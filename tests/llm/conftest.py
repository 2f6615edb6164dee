import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # Names that the operators use themselves.
        StructField("key", StringType()),
        StructField("n", LongType()),
        StructField("row", StringType()),
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text, lang, source) rows, with further columns of clashing names."""

    def make(rows, parts=3):
        full = [(i, t, lang, source, len(t) if t else None, "k", 1, "r") for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make


PROSE = "the quick brown fox jumps over a lazy dog while seven old men sit by the cold river and talk about rain"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, short, very long, repeated and non-ASCII texts; null names; a repeated row."""
    long = " ".join(f"word{i % 977} und{i % 31}" for i in range(20_000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n\t ", "en", "a"),
        (4, "one two three", "en", None),
        (5, PROSE, "en", "a"),
        (6, PROSE, "en", "b"),
        (6, PROSE, "en", "b"),
        (7, PROSE + " again", "en", "b"),
        (8, "Größe ÆØÅ 中文字 😀 ' 's don't", "de", "b"),
        (9, long, "en", "a"),
        (10, long + " end", "en", "a"),
        (11, "x" * 50_000, None, "c"),
        (12, "42 ,.; !!!", "fr", "c"),
        (None, "no key at all here " * 4, "fr", "c"),
        (13, "\x00zero\x00byte" + PROSE, "en", "c"),
    ]

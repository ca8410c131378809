import pytest
from pyspark.sql import types as T

#: The columns of ``documents`` and two that share names with internal or result columns.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("h", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("rank", T.StringType()),
        T.StructField("_hash", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang, source])."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) + ("x",) * 7 for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """NULL ids and texts, empty and blank texts, repeated rows, a very long text, odd white space."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    return [
        (1, "alpha beta gamma delta epsilon", "en", "b"),
        (1, "alpha beta gamma delta epsilon", "en", "b"),
        (2, "alpha  beta\tgamma\ndelta epsilon", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n ", "en", None),
        (None, "alpha beta gamma delta epsilon", None, "a"),
        (None, None, None, None),
        (6, long, "en", "a"),
        (7, long, "de", "b"),
        (8, long + " more", "de", "c"),
        (9, "naïve café 数据   word word", "fr", "c"),
        (10, "ALPHA BETA", "en", "a"),
        (11, "alpha beta", "en", "a"),
        (12, "no-letters: 123 456", "en", "a"),
    ]


@pytest.fixture(scope="session")
def edge_docs(make_docs, edge_rows):
    return make_docs(edge_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def spark_sf():
    return "/root/testdata/sf0.001"

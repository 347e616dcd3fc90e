import pytest

#: Columns that operators use inside are given as further columns of the input.
CLASHES = ("row", "w", "line", "h", "c", "n", "t", "pos", "shard", "s", "o", "b", "k", "node", "size", "dropped", "d", "r", "q", "id", "own", "gone", "new", "lines", "rid", "bits", "member", "pivot", "low", "high", "block", "bucket", "digest", "kind")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from texts or (doc_id, text[, source]) rows."""

    def make(rows):
        full = []
        for k, r in enumerate(rows):
            i, t, *rest = r if isinstance(r, tuple) else (k, r)
            full.append((i, t, "en", rest[0] if rest else "src0", len(t) if t is not None else None))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, clashing further columns."""
    from pyspark.sql import functions as F

    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(1, None), (None, "a text without an id that is long enough to count"), (2, ""), (3, "   \n\t "), (4, long), (5, "same text same text"), (5, "same text same text"), (5, "another text under the same id"), (6, "é è ß 日本 ▁ \x1f   x"), (7, "x", None), (8, "\n\n\n")]
    df = docs(rows)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs([])

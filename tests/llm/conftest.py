import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", None, 27),
            (2, "one two three four five six", "en", None, 27), (3, None, None, "b", None), (4, "", "en", "a", 0),
            (None, "one two three four five six", "en", "a", 27), (None, None, None, None, None), (None, None, None, None, None),
            (5, long, "de", "b", len(long)), (6, " \t\n\x0b\x0c\r ", "fr", "c", 7), (7, "Ünïcode ✓ text here", "fr", "c", 19)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

LONG = "".join(f"w{i * i % 9973} " for i in range(40_000))
PASSAGE = "The committee met at nine and adjourned at noon after hearing every witness in turn. " * 4

# nulls in any column, empty and white texts, repeated rows, ties, copies, near copies, a shared passage, a very long text
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\r\n", "en", "a", 4), (None, "no id here", "de", None, 10),
    (4, "a b", "en", "a", 3), (5, "a  b", "en", "a", 4), (6, "ab", "en", "b", 2), (6, "ab", "en", "b", 2), (7, "A B", "en", "a", 3),
    (8, "one", "fr", "b", 3), (9, "one two", "fr", "b", 7), (10, "äöü 漢字 🙂 é", "xx", "c", 11),
    (11, "intro one " + PASSAGE + "tail", "en", "a", 9), (12, "another start " + PASSAGE + "other end", "en", "a", 9),
    (13, "é" + PASSAGE[1:] + "é", "en", "a", 9), (14, "xyz " * 300, "en", "a", 1200), (15, "xyz " * 300, "en", "a", 1200),
    (16, LONG, "en", "a", len(LONG)), (17, LONG + "x", "en", "a", len(LONG) + 1), (18, "q" * 5000, "en", "a", 5000),
    (19, "Released under the MIT License.\nnot a licence", "en", "a", 40), (20, "<|endoftext|> in a text", "en", "a", 20),
]


@pytest.fixture(scope="session")
def frame(spark, tmp_path_factory):
    """Rows as a table that was written and read."""
    def make(rows, schema=DOCS):
        path = str(tmp_path_factory.mktemp("table") / "t")
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)
    return make


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"

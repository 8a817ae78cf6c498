import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("simhash", T.StringType())])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, special strings, and columns named like results."""
    texts = [None, "", " \n\t ", "one", "it's 'sx  a\n\n b", "日本語 テスト　é", "a<|endoftext|>b", "x" * 5_000, "word " * 30_000, "same text here", "same text here", "A b C d e f", "a B c D e F"]
    rows = [(i, t, "s", "h") for i, t in enumerate(texts)]
    return [*rows, (None, "no id", None, None), (None, None, None, None), (9, "same text here", "s", "h"), (9, "same text here", "s", "h")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)

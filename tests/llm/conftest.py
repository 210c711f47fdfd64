import pytest
from pyspark.sql import types as T

from tickloom.llm.common import prepare

#: Documents with extra columns whose names the operators use themselves.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in (
        "id", "key", "fp", "size", "shard", "_text", "_bpe_text", "block", "label", "_key", "spans", "token_ids",
    )],
])
LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = [
    (1, "The cat sat on the mat and looked at the moon over the hill."),
    (2, "the CAT sat on the mat and looked at the moon over the hill."),
    (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, LONG), (8, "Ünïcödé 漢字 😀 don't  stop\n\nnow"),
    (None, "a row without an id has a text of its own"), (9, None), (10, "one"), (10, "one"),
    (11, "The cat sat on the mat and looked at the moon over the hill."),
    (11, "The cat sat on the mat and looked at the moon over the hill."),
]


@pytest.fixture(scope="session")
def documents(spark):
    prepare(spark)

    def make(rows, lang="en"):
        full = [
            (i, t, lang, "src", len(t or ""), *["x"] * (len(SCHEMA) - 5)) for i, t in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def messy(documents):
    return documents(TEXTS)

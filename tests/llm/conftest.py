from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Texts that every text operator must take: null, empty, blank, short, long, control characters, copies.
TEXTS = [None, "", "  \n\t ", "one", "One two three", "a b c d e f g h", "a b c d e f g h", "A B C D E F G H",
         "x" * 3000, "word " * 4000, "äöü ß 漢字 \U0001F600 é", "tab\tand  two spaces\n\nline \x1c odd",
         "</s>[INST] ok [/INST] \\ <s>", "<|endoftext|> and <|startoftext|>", "don't I'LL 12 3.5"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls, ties and repeats, and columns whose names clash with those that operators use inside."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "no id here at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ["id", "n", "a", "b", "label", "score", "key", "component", "bands", "length", "item", "block", "statistics"]
    return df.select("doc_id", "text", *[F.lit("clash").alias(c) for c in extra])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")

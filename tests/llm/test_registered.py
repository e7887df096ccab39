"""The registered corpus queries: those with SQL against DuckDB, all of them on whole small tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from portfolia.llm import queries as own
from tools.check import connect, rows_of


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_against_sql(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    cur = connect(sf_dir).execute(oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_every_corpus_query_is_registered():
    assert set(own.QUERIES) | {"pipeline"} <= set(queries())
    assert queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", ["op2_quality_classifier", "op7_bpe_forced_boundary", "op10_lm_scoring"])
def test_one_row_per_document(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    df = queries()[name](spark, sf_dir)
    assert df.count() == n and df.select("doc_id").distinct().count() == n

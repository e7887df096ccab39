from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from portfolia.operators import search
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta9", "the"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(60)] + [(60, ""), (61, None)]
    queries = [(i, " ".join(rng.choices(words, k=3))) for i in range(9)] + [(9, "nowhere")]
    return (docs, queries, spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
            spark.createDataFrame(queries, "query_id long, text string"))


def _bm25(docs, query):
    toks = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ws in toks.items():
        tf, s = Counter(ws), 0.0
        for t, q in Counter(query.split()).items():
            df = sum(t in w for w in toks.values())
            if tf[t]:
                s += q * math.log(1 + (n - df + .5) / (df + .5)) * tf[t] * 2.2 / (
                    tf[t] + 1.2 * (.25 + .75 * len(ws) / avg))
        if s:
            out[i] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize(("block_docs", "seeds"), [(512, 100_000), (3, 1)])
def test_bm25_brute_force(corpus, block_docs, seeds, monkeypatch):
    monkeypatch.setattr(search, "SEED_DOCS", seeds)
    docs, queries, d, q = corpus
    got: dict[int, list] = {}
    for r in search.search_chunks(d, q, 5, block_docs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, pytest.approx(r.score, abs=1e-6)))
    for i, text in queries:
        assert got.get(i, []) == _bm25(docs, text)[:5]


def test_cosine_brute_force(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(80, 8)), rng.normal(size=(7, 8))
    x[5] = 0
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    got = search.search_vectors(d.repartition(4), qs, 3, max_queries=3).collect()
    norm = np.linalg.norm(x, axis=1)
    cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.where(norm == 0, 1, norm)
    for i in range(len(q)):
        want = sorted(range(len(x)), key=lambda j: (-round(cos[i, j], 6), j))[:3]
        assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == want


def test_k_range(corpus):
    with pytest.raises(ValueError):
        search.search_chunks(corpus[2], corpus[3], 11)
    assert search.search_chunks(corpus[2].where("false"), corpus[3]).count() == 0


def test_one_pass_whatever_the_number_of_queries(spark, sf_dir, tmp_path):
    """A thousand queries: the plan of the index scans the corpus once, that of the search not at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    some = docs.limit(40).select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("text"))
    many = spark.createDataFrame([(i, f"the {r.text}") for i in range(25) for r in some.collect()], "i long, text string")
    many = many.select(F.monotonically_increasing_id().alias("query_id"), "text")
    index = search.stored_index(docs, str(tmp_path / "index"), search.asked_terms(many))
    found = search.search_index(index, many, 3)
    plan = plan_of(found)
    assert "documents.parquet" not in plan and plan.count("Scan parquet") < 12
    assert plan_of(search.postings(docs)).count("Scan parquet") == 1
    rows = found.collect()
    assert len({r.query_id for r in rows}) == many.count() and max(r["rank"] for r in rows) == 3


def test_blocks_that_cannot_win_are_not_scored(spark):
    """One rare word decides: of 40 blocks that share the common word one is left."""
    docs = spark.createDataFrame([(i, "common word " * (1 + i % 3) + ("rare rare" if i in (7, 8) else "")) for i in range(400)],
                                 "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    assert [r.doc_id for r in search.search_chunks(docs, queries, 2, 10).orderBy("rank").collect()] == [7, 8]

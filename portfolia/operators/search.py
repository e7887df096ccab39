"""Top-k search of many queries over a corpus, as a batch job (item 108).

The corpus is never paired with the queries row by row. Words are searched through an inverted index, whose lists
are cut by blocks of documents. For vectors each task scores its batches against all queries of a block with one
matrix product and keeps k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from portfolia.session import scratch_dir

#: Most query vectors sent to the tasks at once; further ones run in further blocks.
MAX_QUERIES = 256
#: Results per query by default, and the allowed range.
DEFAULT_K, MIN_K, MAX_K = 2, 1, 10
#: BM25 parameters and the digits a score is compared on.
K1, B = 1.2, 0.75
DIGITS = 6
#: Documents in a block of the index, and postings that a query's lower bound is taken from.
BLOCK_DOCS, SEED_DOCS = 512, 100_000

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _check_k(k: int) -> None:
    if not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must lie in {MIN_K}..{MAX_K}")


def _blocks(queries: DataFrame, query_id: str, max_queries: int) -> list[DataFrame]:
    """Queries split by hash so that each block stays near ``max_queries`` rows."""
    n = math.ceil(queries.count() / max_queries)
    if n <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == i) for i in range(n)]


class _Best:
    """The k best rows per query seen so far in one task; ties go to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.score = np.empty((0, len(query_ids)))
        self.ids = np.empty((0, len(query_ids)), dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.vstack([self.score, np.round(scores, DIGITS)])
        ids = np.vstack([self.ids, np.broadcast_to(ids[:, None], (len(ids), len(self.query_ids)))])
        order = np.lexsort((ids, -scores), axis=0)[: self.k]
        self.score = np.take_along_axis(scores, order, axis=0)
        self.ids = np.take_along_axis(ids, order, axis=0)

    def frame(self) -> pd.DataFrame:
        k = len(self.score)
        return pd.DataFrame(
            {"query_id": np.tile(self.query_ids, k), "doc_id": self.ids.ravel(),
             "score": self.score.ravel()}
        )


RESULT = "query_id long, doc_id long, score double"


def _merge(candidates: DataFrame, k: int) -> DataFrame:
    """Best k per query over all tasks; Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_vectors(corpus: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
                   max_queries: int = MAX_QUERIES) -> DataFrame:
    """Cosine top-k. Corpus: ``doc_id, embedding``; queries: ``query_id, embedding``."""
    _check_k(k)
    spark = corpus.sparkSession
    parts = []
    for block in _blocks(queries, "query_id", max_queries):
        rows = block.select("query_id", "embedding").orderBy("query_id").collect()
        ids = np.array([r.query_id for r in rows], dtype=np.int64)
        q = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), -1)
        if not len(ids):
            continue
        sent = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best = _Best(ids, k)
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    cos = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) @ q.T
                    best.add(batch["doc_id"].to_numpy(np.int64), cos)
            yield best.frame()

        parts.append(corpus.select("doc_id", "embedding").mapInPandas(score, RESULT))
    if not parts:
        return spark.createDataFrame([], RESULT + ", rank int")
    return _merge(reduce(DataFrame.unionByName, parts), k)


def label_centroids(embeddings: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mean vector per label, from per-position averages combined on the map side."""
    return (
        embeddings.select(label, F.posexplode(vector).alias("pos", "x"))
        .groupBy(label, "pos").agg(F.avg("x").alias("x"))
        .groupBy(F.col(label).cast("long").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
             .alias("embedding"))
    )


def _words(texts: pa.Array) -> pa.ListArray:
    """Lower-case runs of letters and digits, cut by Arrow for a whole batch."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pc.split_pattern_regex(pc.utf8_lower(texts), pattern=TOKEN_SPLIT)


def _block_postings(ids: pa.Array, texts: pa.Array, block: int) -> pa.RecordBatch:
    """One row per term of a block of documents, with its documents, counts and their lengths; one row for the block."""
    words = _words(texts)
    row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    flat = words.flatten()
    some = pc.not_equal(flat, "")
    row = row[some.to_numpy(zero_copy_only=False)]
    terms = flat.filter(some).dictionary_encode()
    lengths = np.bincount(row, minlength=len(words))
    cell, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(words) + row, return_counts=True)
    term, doc = np.divmod(cell, max(len(words), 1))
    ends = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    # The last row, without a term, tells how many documents and words the block has.
    offsets = pa.array(np.append(ends, len(term)).astype(np.int32))

    def lists(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(offsets, values)

    n = len(ends) - 1
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([terms.dictionary.take(pa.array(term[ends[:-1]])), pa.array([None], pa.string())]),
         pa.array(np.full(n + 1, block)), lists(ids.take(pa.array(doc))), lists(pa.array(tf.astype(np.int32))),
         lists(pa.array(lengths[doc].astype(np.int32))),
         pa.array([None] * n + [len(words)], pa.int64()), pa.array([None] * n + [int(lengths.sum())], pa.int64())],
        names=["term", "block", "docs", "tfs", "lengths", "n_docs", "n_words"])


def postings(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The inverted index of ``doc_id, text``, not stored: per block of documents and term the list of its postings.

    Blocks are runs of at most ``block_docs`` documents of one input partition, so the list of a term that is in
    every document is as many rows as there are blocks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, block_docs):
                part = batch.slice(start, block_docs)
                yield _block_postings(part.column(0), part.column(1), block)
                block += 1

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"term string, block long, docs array<{kind}>, tfs array<int>, lengths array<int>, "
             "n_docs long, n_words long")


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of ``query_id, text``; the same words as in the index."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(batch.column(1))
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))))
            yield pa.RecordBatch.from_arrays([owner, words.flatten()], names=["query_id", "term"])

    return queries.select("query_id", "text").mapInArrow(cut, f"query_id {kind}, term string").where(
        "term != ''").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def stored_index(docs: DataFrame, path: str, terms: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Write the index of ``docs`` in one pass over the corpus, for all terms or for the listed ones; read it back."""
    index = postings(docs, block_docs)
    if terms is not None:
        index = index.join(terms.select("term").distinct().withColumn("_asked", F.lit(True)), "term", "left").where(
            "_asked OR term IS NULL").drop("_asked")
    index.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


def search_index(index: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """BM25 top-k of every query from a stored index; results are exact.

    1. Size and mean length of the corpus, and every term's document count, are sums over the index.
    2. A query's rarest terms, up to ``SEED_DOCS`` postings in all but at least one term, give scores of which the
       k-th best bounds the query's results from below.
    3. In every block the best postings of a query's terms bound the block's scores from above. Only blocks that
       reach the lower bound are scored; a query and a block meet through the terms they share, never by pairing.
    """
    _check_k(k)
    spark = index.sparkSession
    size = index.where("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w")).first()
    if not size.w:
        return spark.createDataFrame([], RESULT + ", rank int")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("x.lengths") / F.lit(size.w / size.n))
    gain = F.col("x.tfs") * F.lit(K1 + 1) / (F.col("x.tfs") + norm)

    def best(tf: Column, length: Column) -> Column:
        return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(size.w / size.n)))

    lists = index.where("term IS NOT NULL").drop("n_docs", "n_words")
    asked = asked_terms(queries)
    bounds = lists.select("term", "block", F.size("docs").alias("df"), F.array_max(F.zip_with(
        "tfs", "lengths", best)).alias("top")).join(asked.select("term").distinct(), "term", "left_semi")
    df = bounds.groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(size.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(df, "term").select("query_id", "term", "df", (F.col("qtf") * idf).alias("w"))
    run = Window.partitionBy("query_id").orderBy("df", "term")
    seeds = asked.withColumn("before", F.sum("df").over(run) - F.col("df")).where(
        (F.col("before") == 0) | (F.col("before") + F.col("df") <= SEED_DOCS))

    def scored(wanted: DataFrame, on: list[str]) -> DataFrame:
        met = wanted.join(lists, on).select(
            "query_id", "w", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("x"))
        return met.groupBy("query_id", F.col("x.docs").alias("doc_id")).agg(
            F.round(F.sum(F.col("w") * gain), DIGITS).alias("score"))

    floor = _merge(scored(seeds, ["term"]), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    reach = asked.join(bounds, "term").groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("most"))
    # A score is rounded: a block within one unit of the last digit stays in.
    blocks = reach.join(floor, "query_id", "left").where(
        F.col("most") >= F.coalesce(F.col("least"), F.lit(0.0)) - 10.0**-DIGITS).select("query_id", "block")
    wanted = asked.join(bounds.select("term", "block"), "term").join(blocks, ["query_id", "block"])
    return _merge(scored(wanted, ["term", "block"]).where("score > 0").select(
        F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "score"), k)


def search_chunks(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """BM25 top-k. Docs: ``doc_id, text`` and metadata; queries: ``query_id, text``.

    One pass over the corpus, whatever the number of queries: it stores the postings of the terms that are asked for.
    """
    _check_k(k)
    path = scratch_dir(docs.sparkSession, "postings")
    return search_index(stored_index(docs, path, asked_terms(queries), block_docs), queries, k)


def with_metadata(results: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Attach source and other metadata to the results, of which there are few.

    Catalyst picks the join; the result side has at most k rows per query.
    """
    return results.join(docs.select("doc_id", *columns), "doc_id")

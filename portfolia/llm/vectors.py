"""Near-duplicate vectors and nearest neighbours by cross-polytope hashing with multiprobe buckets.

Both operators turn a vector to unit length, rotate it by fast Hadamard pseudo-rotations and file it in one home
bucket per table, that of its nearest signed axes; it also visits the buckets of its next axes. Vectors meet in
buckets, where they are compared in double precision as matrix blocks. A bucket of any size is cut into blocks by
a hash of the id, and every pair of blocks is a group, so neither a task nor its memory grows with a hot bucket,
and no pair of vectors is ever a row: a block yields counts, a spanning forest of links, or each query's best.

Vectors that are null, empty or zero, or hold null or non-finite components, take part in nothing; vectors of
different widths never meet. A repeated id counts once, with its smallest label and vector; a null id is left
out of meetings. Other columns are unread. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portfolia.llm import crosspolytope
from portfolia.llm.common import mix, stored
from portfolia.llm.components import components

BLOCK, ROWS_AT_ONCE = 8192, 512
PROBES, MISS = 4, 1e-4
TABLES, SEARCH_PROBES, AXES = 12, 8, 64
SEARCH_BLOCK, QUERY_BLOCK = 8192, 1024


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy()
    for width in np.unique(sizes).tolist():
        yield width, np.flatnonzero(sizes == width)


def _wide(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, crosspolytope.padded(x.shape[1]) - x.shape[1])))


def code_length(rows: int, dim: int) -> int:
    """How many hashes are concatenated: so many that vectors spread at random give buckets of at most ``BLOCK``."""
    length = 1
    while rows > BLOCK * (2 * crosspolytope.padded(dim)) ** length:
        length += 1
    return length


def tables_for(dim: int, cosine: float, width: int, probes: int = PROBES, miss: float = MISS) -> int:
    """Tables needed so that a pair at the threshold is missed with a chance of at most ``miss``."""
    chance = min(max(crosspolytope.meeting_chance(dim, width, probes, cosine), 0.01), 1 - 1e-9)
    return max(1, math.ceil(math.log(miss) / math.log(1 - chance)))


def one_per_id(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


# --- near-duplicates -------------------------------------------------------------------------------


def _visits(reps: DataFrame, cosine: float, rows: int, with_vector: bool) -> DataFrame:
    """One row per vector and bucket that it lives in (home) or visits, with its buckets of all tables.

    ``rows`` is the number of vectors of the most frequent label, from which the length of the codes follows.
    """
    vector = reps.schema["v"].dataType.simpleString()
    schema = "bucket long, tab int, home boolean, id long" + (
        f", copies long, v {vector}, buckets array<long>" if with_vector else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            for width, at in _by_width(v):
                x = _wide(unit(matrix(v.take(pa.array(at)))))
                label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)[at]
                space = mix(label.astype(np.int64).view(np.uint64) * np.uint64(1 << 20) + np.uint64(width))
                length = code_length(rows, width)
                tables = tables_for(width, cosine, length)
                keys = np.stack([
                    mix(crosspolytope.codes(x, t, length, PROBES).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        + space[:, None] + np.uint64(t)) for t in range(tables)], axis=1).view(np.int64)
                n, probes = len(at), keys.shape[2]
                per = tables * probes
                take = pa.array(np.repeat(at, per))
                out = [pa.array(keys.reshape(-1)), pa.array(np.tile(np.repeat(np.arange(tables), probes), n).astype(np.int32)),
                       pa.array(np.tile(np.arange(probes) == 0, n * tables)),
                       batch.column(batch.schema.get_field_index("id")).take(take)]
                names = ["bucket", "tab", "home", "id"]
                if with_vector:
                    every = pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1, dtype=np.int32) * per), pa.array(keys.reshape(-1)))
                    out += [batch.column(batch.schema.get_field_index("copies")).take(take), v.take(take),
                            every.take(pa.array(np.repeat(np.arange(n), per)))]
                    names += ["copies", "v", "buckets"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return reps.select("id", "label", "v", "copies").mapInArrow(run, schema)


def _first_meeting(a: np.ndarray, b: np.ndarray, a_low: np.ndarray) -> np.ndarray:
    """The bucket in which each pair counts: in the first table where one's home is among the other's buckets.

    ``a`` and ``b`` are (pairs, tables, probes) with the home first; if both homes serve, the smaller id's does.
    """
    a_home, b_home = a[:, :, 0], b[:, :, 0]
    at_a, at_b = (b == a_home[:, :, None]).any(axis=2), (a == b_home[:, :, None]).any(axis=2)
    table = (at_a | at_b).argmax(axis=1)
    i = np.arange(len(a))
    low = np.where(a_low, at_a[i, table], at_b[i, table])
    use_a = low == a_low
    return np.where(use_a, a_home[i, table], b_home[i, table])


def near_duplicates(df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """Per vector: id, n_links, component_id and kept. Vectors are compared within equal labels only."""
    # Labels of any type are compared by their digests.
    label = F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col)))
    every = stored(one_per_id(df, id_col, vec_col, label), "vectors")
    fit = every.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    # Equal vectors are one vector with copies.
    reps = stored(fit.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")
    same = stored(fit.join(reps.withColumnsRenamed({"label": "l", "v": "w"}), (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")))
                  .select("id", "rep", "copies"), "same")
    reps = reps.select(F.col("rep").alias("id"), "label", "v", "copies")
    rows = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hot = stored(_visits(reps, cosine, rows, False).groupBy("bucket").agg(F.count("*").alias("n")).where(f"n > {BLOCK}")
                 .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    visits = _visits(reps, cosine, rows, True).join(hot, "bucket", "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = visits.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "tab", "home", "id",
        "copies", "v", "buckets")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        own, ids = table.column("own").to_numpy(), table.column("id").to_numpy()
        home, copies = table.column("home").to_numpy(), table.column("copies").to_numpy()
        x = unit(matrix(table.column("v")))
        tables = tables_for(x.shape[1], cosine, code_length(rows, x.shape[1]))
        buckets = table.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(ids), tables, -1)
        left, right = (np.flatnonzero(own == key[k].as_py()) for k in (1, 2))
        links, forest, root = np.zeros(len(ids), np.int64), [], {}

        def find(k: int) -> int:
            while root.get(k, k) != k:
                k = root[k] = root.get(root[k], root[k])
            return k

        for begin in range(0, len(left), ROWS_AT_ONCE):
            some = left[begin : begin + ROWS_AT_ONCE]
            near = (x[some] @ x[right].T >= cosine) & (home[some][:, None] | home[right][None, :])
            near &= ids[some][:, None] < ids[right][None, :] if key[1] == key[2] else (
                ids[some][:, None] != ids[right][None, :])
            a, b = np.nonzero(near)
            a, b = some[a], right[b]
            for at in range(0, len(a), 100_000):
                p, q = a[at : at + 100_000], b[at : at + 100_000]
                here = _first_meeting(buckets[p], buckets[q], ids[p] < ids[q]) == key[0].as_py()
                p, q = p[here], q[here]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                for s, t in zip(ids[p].tolist(), ids[q].tolist(), strict=True):
                    f, g = find(s), find(t)
                    if f != g:
                        root[f] = g
                        forest.append((s, t))
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], [e[0] for e in forest]]).astype(np.int64)),
            "b": pa.array([None] * len(some) + [e[1] for e in forest], pa.int64()),
            "n": pa.array(np.concatenate([links[some], [0] * len(forest)]).astype(np.int64))})

    met = spread.groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long, n long")
    # Summed where they are made, before they travel: one row per vector, and one per link of a forest.
    met = stored(met.groupBy("a", "b").agg(F.sum("n").alias("n")), "met")
    counts = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = components(met.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "rep", "component": "c"})
    linked = same.join(counts, "rep", "left").join(found, "rep", "left").select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "rep").alias("c"))
    component = F.coalesce("c", "id")
    return every.select("id").join(linked, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        (component == F.col("id")).alias("kept"))


# --- nearest neighbours ----------------------------------------------------------------------------


def _best(table: pa.Table, k: int) -> pa.Table:
    """Each query's k best rows of a block by inner product, ties to smaller ids; its own row is no candidate."""
    is_query = table.column("is_query").to_numpy()
    ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
    q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    if not len(q) or not len(c):
        rows, cols, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    else:
        c = c[np.argsort(ids[c], kind="stable")]
        close = x[q] @ x[c].T
        close[ids[q][:, None] == ids[c][None, :]] = -np.inf
        take = min(k, len(c))
        least = np.partition(close, len(c) - take, axis=1)[:, len(c) - take]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        near = (close >= (least - slack)[:, None]) & np.isfinite(close)
        a, b = np.nonzero(near)
        rows, cols = q[a], c[b]
        scores = np.concatenate([np.einsum("ij,ij->i", x[rows[i : i + 50_000]], x[cols[i : i + 50_000]])
                                 for i in range(0, len(rows), 50_000)]) if len(rows) else np.zeros(0)
        order = np.lexsort((ids[cols], -scores, ids[rows]))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.searchsorted(ids[rows], ids[rows], "left")
        keep = np.arange(len(rows)) - first < k
        rows, cols, scores = rows[keep], cols[keep], scores[keep]
    return pa.table({"query_id": pa.array(ids[rows], pa.int64()), "vec_id": pa.array(ids[cols], pa.int64()),
                     "score": pa.array(scores, pa.float64())})


_PAIRS = "query_id long, vec_id long, score double"


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, probes: int = SEARCH_PROBES, length: int = 1) -> DataFrame:
    """The k nearest rows found for each row that ``queries`` marks: query_id, rank, vec_id and score.

    Nearness is the inner product. Lengths are made equal first by one more component (none is added where all
    lengths agree to one part in a thousand), so the nearest direction is the largest product. ``probes`` buckets
    of each table are searched per ``AXES`` axes. ``length`` hashes are concatenated to a code: longer codes make
    more and smaller buckets, for more rows than this setting is meant for. A query that meets fewer than k rows is compared with all rows.
    """
    every = stored(one_per_id(df, id_col, vec_col, F.lit(0).cast("long")).where(
        F.col("id").isNotNull() & usable(F.col("v"))).select(
            "id", "v", F.coalesce(queries, F.lit(False)).alias("asks")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    lengths = {r["w"]: (r["least"], r["most"]) for r in every.groupBy(F.size("v").alias("w")).agg(
        F.min(norm).alias("least"), F.max(norm).alias("most")).collect()}  # one row per vector width
    kind = every.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, asks = (batch.column(c) for c in range(3))
            for width, rows in _by_width(v):
                x = matrix(v.take(pa.array(rows)))
                least, most = lengths[width]
                as_base = x / most
                as_query = unit(x)
                if least < 0.999 * most:
                    rest = np.sqrt(np.maximum(0, 1 - (as_base**2).sum(axis=1, keepdims=True)))
                    as_base = np.concatenate([as_base, rest], axis=1)
                    as_query = np.concatenate([as_query, 0 * rest], axis=1)
                as_base, as_query = _wide(as_base), _wide(as_query)
                asking = np.flatnonzero(asks.to_numpy(zero_copy_only=False)[rows])
                m = min((2 * as_base.shape[1]) ** length, max(1, round(probes * as_base.shape[1] / AXES)))
                for t in range(tables):
                    space = (t * 4096 + width % 4096) << 40
                    home = crosspolytope.codes(as_base, t, length, 1)
                    visit = crosspolytope.codes(as_query[asking], t, length, m)
                    take = pa.array(np.concatenate([rows, np.repeat(rows[asking], m)]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([home.ravel(), visit.ravel()]) + space),
                         pa.array(np.arange(len(take)) >= len(rows)), ids.take(take), v.take(take)],
                        names=["bucket", "is_query", "id", "v"])

    rows = every.mapInArrow(run, f"bucket long, is_query boolean, id long, v {kind}")
    size = stored(rows.groupBy("bucket").agg(
        F.ceil(F.count_if(~F.col("is_query")) / SEARCH_BLOCK).cast("int").alias("b"),
        F.ceil(F.count_if("is_query") / QUERY_BLOCK).cast("int").alias("q")).where("b > 0 and q > 0"), "sizes")
    met = _in_blocks(rows.join(size, "bucket"), "bucket", k)
    best = stored(_ranked(met, k), "nearest")
    asks = every.where("asks")
    short = stored(asks.join(best.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(
        F.coalesce("count", F.lit(0)) < k).select("id", "v"), "short")
    n = short.count()
    if n:  # all rows, in blocks
        blocks = math.ceil(every.count() / SEARCH_BLOCK)
        both = every.select(F.lit(False).alias("is_query"), "id", "v").unionByName(
            short.select(F.lit(True).alias("is_query"), "id", "v")).withColumn("bucket", F.size("v").cast("long"))
        both = both.withColumn("b", F.lit(blocks)).withColumn("q", F.lit(math.ceil(n / QUERY_BLOCK)))
        again = _ranked(_in_blocks(both, "bucket", k), k)
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return best


def _in_blocks(rows: DataFrame, bucket: str, k: int) -> DataFrame:
    """Best rows per query and block; a candidate goes to one block of its bucket per block of queries and back."""
    side = F.pmod(F.xxhash64("id"), F.when(F.col("is_query"), F.col("q")).otherwise(F.col("b"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("b")).otherwise(F.col("q")) - 1)
    spread = rows.withColumn("side", side).withColumn("other", F.explode(other)).select(
        bucket, F.when(F.col("is_query"), F.col("other")).otherwise(F.col("side")).alias("b"),
        F.when(F.col("is_query"), F.col("side")).otherwise(F.col("other")).alias("q"), "is_query", "id", "v")
    return spread.groupBy(bucket, "b", "q").applyInArrow(lambda table: _best(table, k), _PAIRS)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star edges.

1. A text's words give the set of its shingles as 64-bit hashes. The set is hashed once into ``BINS`` bins, each
   keeping its least value; an empty bin copies a full one found by the bin's own sequence of probes (optimal
   densification). Equal sets are collapsed to their smallest id.
2. ``BANDS`` bands of bins make buckets. In every bucket the smallest id is the centre, and only the star of edges
   from the centre is a candidate, so n members give n - 1 pairs.
3. Candidates are confirmed on the full shingle sets; confirmed links are joined to components.
4. What a star cannot see: a bucket whose members still lie in several components is searched for pairs across
   components, in blocks of about ``BLOCK`` members. Members whose bins agree in ``AGREE`` places or more with one
   of another component (at the threshold of 0.8 that bound is over five standard deviations off) meet again with
   their texts, are compared on the full sets, and what links is joined at once, so a block yields at most a
   spanning forest of links and no pair inside a component is ever compared.

Links are never capped: hot buckets are cut into blocks and centres with many members into parts. Rows: null
or empty texts have an empty set and link with nothing; fewer words than a shingle make one shingle; repeated
ids form one document whose sets are all linked; a null id gets a row of its own with a null component. Other
columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portfolia.llm.common import give_back, mix, slices, stored, word_hashes
from portfolia.llm.components import components

BINS, BANDS = 128, 32
BLOCK, AGREE, TINY = 1500, 78, 10
SPREAD = 64
PART_SHINGLES, BLOCK_SHINGLES = 400_000, 1_500_000
_PROBES = 64
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, and the n + 1 offsets of the sets."""
    words, ends = word_hashes(texts)
    n_words = np.diff(ends)
    mixed = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        mixed[: len(words) - j] += words[j:] * _SEEDS[j]
    sets, sizes = [], np.zeros(len(n_words), np.int64)
    mixed = mix(mixed)
    for i in np.flatnonzero(n_words):
        a, b = ends[i], ends[i + 1]
        if n_words[i] < k:
            h = words[a:b] * _SEEDS[: b - a]
            own = mix(np.append(h, _SEEDS[31 + int(b - a)]).sum(dtype=np.uint64, keepdims=True))
        else:
            own = np.unique(mixed[a : b - k + 1])
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


_TABLE = None


def _probe_table() -> np.ndarray:
    """For each bin the sequence of bins that it tries when it is empty."""
    global _TABLE
    if _TABLE is None:
        at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(_PROBES) + np.arange(_PROBES, dtype=np.uint64)
        _TABLE = (mix(at * np.uint64(0xD6E8FEB86659FD93) + np.uint64(17)) % np.uint64(BINS)).astype(np.int64)
    return _TABLE


def densified(own: np.ndarray) -> np.ndarray:
    """The least value per bin of one non-empty set; empty bins copy the first full bin of their probes."""
    bins = (own >> np.uint64(57)).astype(np.int64)  # sorted values: bins come in order
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    value, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[bins[first]], full[bins[first]] = own[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        tries = _probe_table()[empty]
        hit = full[tries]
        found = hit.any(axis=1)
        source = tries[np.arange(len(empty)), hit.argmax(axis=1)]
        nearest = bins[first][np.searchsorted(bins[first], empty) % len(first)]  # when no probe hit
        source = np.where(found, source, nearest)
        # a copied value is mixed with the probe's source only, so equal sources agree
        value[empty] = value[source]
    return value


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, a 128-bit digest of the set, band keys and one byte per bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = BINS // BANDS
        weights = _SEEDS[:rows]
        band_no = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in (rows for whole in batches for rows in slices(whole, 1)):
            sets, ends = shingle_sets(batch.column(1), k)
            n = batch.num_rows
            d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
            bands, bins = [None] * n, [None] * n
            for i in np.flatnonzero(np.diff(ends)):
                own = sets[ends[i] : ends[i + 1]]
                d1[i] = own.sum(dtype=np.uint64).view(np.int64)
                d2[i] = np.bitwise_xor.reduce(mix(own * np.uint64(3) + np.uint64(1))).view(np.int64)
                value = mix(densified(own))
                key = mix((value.reshape(BANDS, rows) * weights).sum(axis=1, dtype=np.uint64) + band_no)
                bands[i] = key.view(np.int64)
                bins[i] = (value & np.uint64(255)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends)), pa.array(d1), pa.array(d2),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(bins, pa.binary())],
                names=["id", "n", "d1", "d2", "bands", "bins"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(
        run, "id long, n long, d1 long, d2 long, bands array<long>, bins binary")


def similar(first: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(first), len(other)) < percent * max(len(first), len(other)) or not len(first):
        return False
    place = np.minimum(np.searchsorted(first, other), len(first) - 1)
    both = int((first[place] == other).sum())
    return 100 * both >= percent * (len(first) + len(other) - both)


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; ``n`` is the size of b's set.

    A group holds one a and members b of at most about ``PART_SHINGLES`` shingles in all, so that an a with very
    many partners is spread; each text of b travels once per pair and that of a once per part.
    """
    load = stored(pairs.groupBy("a").agg((F.floor(F.sum("n") / PART_SHINGLES) + 1).alias("parts")), "parts")
    dealt = stored(pairs.join(load, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
    wanted = dealt.select("a", "part", F.col("b").alias("id")).unionByName(
        dealt.select("a", "part", F.col("a").alias("id")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = wanted.join(texts, "id").select("a", "part", "id", "text")

    def check(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sets, ends = shingle_sets(table.column("text"), k)
        centre = key[0].as_py()
        own = {}
        for i in np.flatnonzero(ids == centre):
            own[sets[ends[i] : ends[i + 1]].tobytes()] = sets[ends[i] : ends[i + 1]]
        found = set()
        for first in own.values():
            for i in np.flatnonzero(ids != centre):
                if similar(first, sets[ends[i] : ends[i + 1]], percent):
                    found.add(int(ids[i]))
        b = sorted(found)
        return pa.table({"a": pa.array([centre] * len(b), pa.int64()), "b": pa.array(b, pa.int64())})

    return whole.groupBy("a", "part").applyInArrow(check, "a long, b long").distinct()


def near_size(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _agreeing(t: pd.DataFrame, key: int, percent: int, once: bool):
    """For each left row that has any: its place and those of right rows of another component that agree.

    Two members that share several buckets meet in the one with the smallest key only.
    """
    sides = [t[t["side"] != 1], t[t["side"] != 0]]  # side 2 stands on both, in a block that meets itself
    bins = [np.frombuffer(b"".join(x["bins"]), np.uint8).reshape(len(x), BINS) for x in sides]
    bands = [np.concatenate([*x["bands"]]).reshape(len(x), BANDS) if len(x) else [] for x in sides]
    n, comp, at = ([x[c].to_numpy() for x in sides] for c in ("n", "component", "at"))
    for r in range(len(sides[0])):
        ok = ((comp[1] != comp[0][r]) & (at[1] != at[0][r])
              & (np.minimum(n[1], n[0][r]) * 100 >= np.maximum(n[1], n[0][r]) * percent))
        if once:
            ok &= (at[1] > at[0][r]) | (sides[1]["side"].to_numpy() != 2)
        other = np.flatnonzero(ok)
        if len(other):
            agree = (bins[1][other] == bins[0][r]).sum(axis=1)
            order = np.argsort(-agree, kind="stable")
            other = other[order[agree[order] >= AGREE]]
            if len(other):
                shared = np.where(bands[1][other] == bands[0][r], bands[0][r], _LAST).min(axis=1)
                other = other[shared == key]
            if len(other):
                yield at[0][r], at[1][other]


_LAST = np.iinfo(np.int64).max
_PLACE = "key long, i int, j int, side int, id long, n long, component long, bins binary, bands array<long>"


def across(rows: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between members of a bucket that lie in different components.

    ``rows``: key, id, n, bins, bands and component of the members of such buckets. A bucket is cut into blocks by a hash
    of the id, and every pair of blocks is a group.
    """
    load = stored(rows.groupBy("key").agg((F.floor(F.greatest(
        F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)) + 1).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = (rows.join(load, "key").withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    spread = spread.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "id", "n", "component", "bins", "bands")

    def narrow(key: tuple, table: pa.Table) -> pa.Table:
        t = table.to_pandas().sort_values("id").reset_index(drop=True).assign(at=lambda x: x.index)
        keep = np.zeros(len(t), bool)
        for left, right in _agreeing(t, key[0].as_py(), percent, once=False):
            keep[left] = True
            keep[right] = True
        return table.schema.empty_table() if not keep.any() else pa.Table.from_pandas(
            t[keep].drop(columns="at"), schema=table.schema, preserve_index=False)

    left = stored(spread.groupBy("key", "i", "j").applyInArrow(narrow, _PLACE), "agreeing")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        t = table.drop_columns(["text"]).to_pandas().assign(at=range(table.num_rows))
        sets, ends = shingle_sets(table.column("text"), k)
        ids, root = t["id"].to_numpy(), {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c] = root.get(root[c], root[c])
            return c

        comp, links = t["component"].tolist(), []
        for a, others in _agreeing(t, key[0].as_py(), percent, once=True):
            mine = sets[ends[a] : ends[a + 1]]
            for b in others.tolist():
                x, y = find(comp[a]), find(comp[b])
                if x != y and similar(mine, sets[ends[b] : ends[b + 1]], percent):
                    links.append((int(ids[a]), int(ids[b])))
                    root[x] = y
        return pa.table({c: pa.array([p[i] for p in links], pa.int64()) for i, c in enumerate("ab")})

    return left.join(texts, "id").select(*left.columns, "text").groupBy("key", "i", "j").applyInArrow(
        search, "a long, b long").distinct()


def representatives(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (id, rep) from equal sets to the smallest id that has them, and one row per different set.

    Copies of one set are first dealt by their id to ``SPREAD`` parts, each with a smallest id of its own, and
    those meet in a second step, so that no task gets all copies of a set.
    """
    key = ["d1", "d2", "n"]
    part = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
    first = stored(sets.select("id", *key).withColumn(
        "rep", F.min("id").over(Window.partitionBy(*key, part))), "equal")
    best = stored(first.where("id = rep").select("id", *key).distinct().withColumn(
        "rep", F.min("id").over(Window.partitionBy(*key))), "best")
    reps = sets.join(best.where("id = rep").select("id", "d1", "d2"), ["id", "d1", "d2"], "left_semi")
    return (first.where("id != rep").select("id", "rep").unionByName(best.select("id", "rep")),
            reps.dropDuplicates(["id", "d1", "d2"]))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document: its id, n_shingles, component_id and kept (the smallest id of its component)."""
    all_sets = stored(sketch(docs, k, id_col, text_col), "sketch")
    sets = all_sets.where("n > 0 and id is not null")
    same, reps = representatives(sets)
    keyed = reps.select("id", "n", F.explode("bands").alias("key"))
    centre = (keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("size"))
              .where("size > 1").select("key", F.col("c.id").alias("c"), F.col("c.n").alias("c_n")))
    members = stored(keyed.join(stored(centre, "centres"), "key"), "members")
    star = (members.where((F.col("id") != F.col("c")) & near_size("n", "c_n", percent))
            .select(F.col("c").alias("a"), F.col("id").alias("b"), "n").distinct())
    first = stored(confirm(stored(star, "star"), docs, k, percent, id_col, text_col), "links")
    known = components(first)
    placed = members.join(known.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("component"))
    placed = stored(placed, "placed")
    # Two members were each other's star; and buckets of several bands with the same members need one search.
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark")).where("x != y and size > 2")
    mixed = mixed.groupBy("size", "mark").agg(F.min("key").alias("key"))
    left = placed.join(mixed.select("key"), "key", "left_semi").select("key", "id", "n", "component").join(
        reps.select("id", "n", "bins", "bands"), ["id", "n"])
    more = stored(across(stored(left, "mixed"), docs, k, percent, id_col, text_col), "more")
    links = same.select(F.col("id").alias("a"), F.col("rep").alias("b")).unionByName(
        known.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(more)
    found = components(links)
    out = all_sets.select("id", "n").groupBy("id").agg(F.max("n").alias("n")).join(
        found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (component == F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are the smallest of their component.

    Of rows that repeat an id one stays, the smallest in the order of all columns; rows without an id stay.
    """
    found = near_duplicates(docs, k, percent, id_col, text_col)
    gone = found.where("not kept").select(id_col)
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    sole = docs.join(gone.unionByName(again), id_col, "left_anti")
    first = docs.join(again.join(gone, id_col, "left_anti"), id_col, "left_semi").groupBy(id_col).agg(
        F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return sole.select(docs.columns).unionByName(first)

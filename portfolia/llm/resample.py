"""Importance resampling towards a target distribution, by hashed n-gram features.

1. Words are runs of letters and digits of ASCII (A-Z lowered) and of all other characters; features are the runs
   of 1 to ``order`` neighbouring words, joined by one space. A feature's bucket is the crc32 of its bytes.
2. A task takes a piece of a batch's texts and interns all its n-grams at once in an open-addressed table of NumPy
   arrays: keys are xxhash64, an equal key counts only if the bytes are equal, and a slot stores the n-gram's bucket
   and how often it occurs. Source and target counts per bucket are sums over tasks.
3. A bucket's gain is the scaled logarithm of how much likelier the target makes it than the source. In a second
   pass the occurrences' slots gather the gains, and a document's weight is their floored mean.
4. Weights get a Gumbel number that depends on the id alone, and the highest scores are drawn: a sample without
   replacement in proportion to exp(weight / 1000). The cut is read from a table of counts per (integer) score, and
   only what lies above is sorted, by ranges, so no task sees all rows.

Rows: null and empty texts have no features and weight 0; a null id counts as empty text in its Gumbel number and
comes before all ids in a tie; repeated rows are counted, scored and drawn as often as they occur, each at a rank
of its own; an empty table gives no rows, an empty target makes all gains depend on the source alone. Other columns
are unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portfolia.llm import common

BUCKETS, SCALE = 10_000, 1000
PIECE_BYTES = 1 << 20
LONG = 256  # bytes; longer n-grams are hashed and compared one by one

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# Fixed values of xxhash64.
P1, P2, P3, P4, P5 = map(np.uint64, (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


class Spans(NamedTuple):
    """The n-grams of a piece: bytes ``start`` to ``start + size`` of ``data``, by text (``ends`` has n + 1 places)."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    ends: np.ndarray
    n_words: np.ndarray


def spans_of(texts: pa.Array, order: int) -> Spans:
    """All runs of 1 to ``order`` neighbouring words of every text, in buffers that end with eight spare bytes."""
    raw, bounds = common._text_buffers(texts)
    low = common._LOWER[raw]
    word = _WORD[low]
    at = bounds[:-1][bounds[:-1] < len(raw)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[at] = word[at]  # a text begins a word of its own
    index = np.flatnonzero(word)
    begin = np.flatnonzero(first)
    number = np.cumsum(first[index]) - 1
    # Words are laid one space apart, so that a run of neighbours is one span of bytes.
    place = np.arange(len(index)) + number
    data = np.full(len(index) + len(begin) + 8, 0x20, np.uint8)
    data[place] = low[index]
    starts = place[np.searchsorted(index, begin)] if len(begin) else np.zeros(0, np.int64)
    stops = np.append(starts[1:] - 1, len(index) + len(begin) - 1) if len(begin) else starts
    ends = np.searchsorted(begin, bounds)
    n_words = np.diff(ends)
    if order == 1:
        return Spans(data, starts, stops - starts, ends, n_words)
    last = np.repeat(ends[1:], n_words) - 1  # the last word of each word's text
    own = [np.flatnonzero(np.arange(len(starts)) + n <= last) for n in range(order)]
    text = np.repeat(np.arange(len(n_words)), n_words)
    owner = np.concatenate([text[i] for i in own])
    by_text = np.argsort(owner, kind="stable")
    start = np.concatenate([starts[i] for i in own])[by_text]
    stop = np.concatenate([stops[i + n] for n, i in enumerate(own)])[by_text]
    counts = np.bincount(owner, minlength=len(n_words))
    return Spans(data, start, stop - start, np.concatenate([[0], np.cumsum(counts)]), n_words)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lanes(data: np.ndarray, width: int) -> np.ndarray:
    """The little-endian number at every byte of the buffer."""
    return np.ndarray((len(data) - width + 1,), f"<u{width}", data, strides=(1,))


def xxhash64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of many spans, all at once; those over ``LONG`` bytes one by one."""
    eight, four = _lanes(data, 8), _lanes(data, 4)
    total = size.astype(np.uint64)
    h = P5 + total
    large = np.flatnonzero((size >= 32) & (size <= LONG))
    if len(large):
        zero = np.zeros(len(large), np.uint64)
        lane = [zero + P1 + P2, zero + P2, zero, zero - P1]
        for k in range(0, int(size[large].max()) // 32):
            on = np.flatnonzero(size[large] >= 32 * (k + 1))
            for j in range(4):
                got = eight[start[large[on]] + 32 * k + 8 * j]
                lane[j][on] = _rotate(lane[j][on] + got * P2, 31) * P1
        mixed = sum(_rotate(x, r) for x, r in zip(lane, (1, 7, 12, 18), strict=True))
        for x in lane:
            mixed = (mixed ^ (_rotate(x * P2, 31) * P1)) * P1 + P4
        h[large] = mixed + total[large]
    done = np.where(size >= 32, size // 32 * 32, 0)
    short = np.where(size <= LONG, size, 0)
    for _ in range(3):
        on = np.flatnonzero(short >= done + 8)
        if len(on):
            got = _rotate(eight[start[on] + done[on]] * P2, 31) * P1
            h[on] = _rotate(h[on] ^ got, 27) * P1 + P4
            done[on] += 8
    on = np.flatnonzero(short >= done + 4)
    h[on] = _rotate(h[on] ^ (four[start[on] + done[on]].astype(np.uint64) * P1), 23) * P2 + P3
    done[on] += 4
    for _ in range(3):
        on = np.flatnonzero(short >= done + 1)
        h[on] = _rotate(h[on] ^ (data[start[on] + done[on]].astype(np.uint64) * P5), 11) * P1
        done[on] += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return h


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of each pair of spans of one size are the same."""
    same = np.ones(len(a), bool)
    eight = _lanes(data, 8)
    for k in range(0, min(LONG, int(size.max(initial=0))), 8):
        on = np.flatnonzero((size > k) & (size <= LONG) & same)
        left = np.minimum(size[on] - k, 8).astype(np.uint64)
        keep = ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left)
        same[on] = ((eight[a[on] + k] ^ eight[b[on] + k]) & keep) == 0
    for i in np.flatnonzero(size > LONG):
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return same


class Table:
    """Open-addressed table of a piece's n-grams: ``slots`` holds the slot of every occurrence.

    ``owner`` is the occurrence that took a slot first (-1: free), ``bucket`` and ``count`` what the slot stores.
    Occurrences of one n-gram walk the same slots in step, so they meet in one.
    """

    def __init__(self, spans: Spans, buckets: int):
        data, start, size = spans.data, spans.start, spans.size
        n = len(start)
        width = 1 << max(4, int(2 * n).bit_length())
        key = xxhash64(data, start, size)
        self.owner = np.full(width, -1, np.int64)
        self.slots = np.zeros(n, np.int64)
        at = (key & np.uint64(width - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            here = at[left]
            free = self.owner[here] < 0
            self.owner[here[free]] = left[free]  # of several, the last one written stays
            owner = self.owner[here]
            same = (key[owner] == key[left]) & (size[owner] == size[left])
            some = np.flatnonzero(same & (owner != left))
            same[some] = _equal(data, start[owner[some]], start[left[some]], size[left[some]])
            self.slots[left[same]] = here[same]
            left = left[~same]
            at[left] = (at[left] + 1) & (width - 1)
        used = np.flatnonzero(self.owner >= 0)
        raw, first = data.tobytes(), self.owner[used]
        self.bucket = np.zeros(width, np.int64)
        self.bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(
            start[first].tolist(), (start[first] + size[first]).tolist(), strict=True)]
        self.count = np.bincount(self.slots, minlength=width)


def bucket_counts(df: DataFrame, order: int, buckets: int, text_col: str) -> DataFrame:
    """bucket, n: how many n-grams of all texts fall in each bucket; a task gives one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in common.slices(batch, 0, PIECE_BYTES):
                table = Table(spans_of(rows.column(0), order), buckets)
                total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)
        common.give_back()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return df.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, text_col: str = "text",
          target_col: str = "text") -> np.ndarray:
    """The gain of every bucket: ``buckets`` numbers, the one thing that the driver sees and sends."""
    both = bucket_counts(docs, order, buckets, text_col).withColumn("side", F.lit("source")).unionByName(
        bucket_counts(target, order, buckets, target_col).withColumn("side", F.lit("target")))
    table = common.stored(both.groupBy("bucket").pivot("side", ["source", "target"]).agg(F.sum("n")), "buckets")
    all_s, all_t = (n or 0 for n in table.agg(F.sum("source"), F.sum("target")).first())
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("source", "target"))
    ratio = ((t + 1) * F.lit(float(all_s + buckets))) / ((s + 1) * F.lit(float(all_t + buckets)))
    numbers = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    rows = numbers.join(table, "bucket", "left").select(
        "bucket", F.floor(F.lit(float(SCALE)) * F.log(ratio)).alias("gain")).collect()
    gain = np.zeros(buckets, np.int64)
    for r in rows:
        gain[r["bucket"]] = r["gain"]
    return gain


def weights(docs: DataFrame, gain: np.ndarray, order: int = 1, id_col: str = "doc_id", text_col: str = "text",
            ) -> DataFrame:
    """id, n_words, n_features and weight of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for rows in common.slices(batch, 1, PIECE_BYTES):
                spans = spans_of(rows.column(1), order)
                table = Table(spans, len(gain))
                n = np.diff(spans.ends)
                total = np.concatenate([[0], np.cumsum(gain[table.bucket[table.slots]])])[spans.ends]
                weight = np.diff(total) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(spans.n_words), pa.array(n), pa.array(weight)],
                    names=[id_col, "n_words", "n_features", "weight"])
        common.give_back()

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int):
    """A scaled Gumbel number from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-F.lit(float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(scored: DataFrame, eligible, percent: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of a stored table with ``rank``: the place among the drawn, null elsewhere.

    Scores are integers within a hundred thousand or so of 0 (logarithms of counts, and of 32 bits, times 1000), so a
    table of counts per score is small whatever the number of rows.
    """
    counts = common.stored(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    wanted = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = F.sum("n").over(Window.orderBy(F.desc("score")))
    cut = counts.withColumn("above", above).where(F.col("above") >= wanted).agg(F.max("score")).first()[0]
    if not wanted or cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = F.coalesce(eligible & (F.col("score") >= cut), F.lit(False))
    top = common.numbered(scored.where(high), [F.desc("score"), F.asc(id_col)], "rank")
    top = top.withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
    return scored.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(top)


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, percent: int = 10,
             least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """Per document: id, n_features, weight, score and rank (null if not drawn)."""
    gain = gains(docs, target, order, buckets, text_col, target_col)
    scored = weights(docs, gain, order, id_col, text_col).withColumn("score", F.col("weight") + gumbel(id_col, seed))
    scored = common.stored(scored, "scored")
    return draw(scored, F.col("n_words") >= least_words, percent, id_col).select(
        id_col, "n_features", "weight", "score", "rank")

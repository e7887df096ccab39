"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portfolia.session import scratch_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, read by Spark from wherever the folder lies."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back, so that later jobs do not compute it again."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows of a stored table with column ``name``: their place, from 0, in the given order over all rows.

    Rows are sorted by ranges and written once with their place in their task; a table of one row per task holds
    what comes before it. Rows that are equal in the order are dealt by their place in the input, so that many of
    them do not fall to one task; a task that runs again gives the same places.
    """
    tie, part = F.monotonically_increasing_id(), F.shiftright(F.col(name), 33)
    clash = [c for c in df.columns if c == "_tie"]
    rows = stored(df.drop(*clash).withColumn("_tie", tie).orderBy(*order, "_tie").withColumn(name, tie).drop("_tie"), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(parts), "_part").withColumn(
        name, here + F.col("_before")).drop("_part", "_before")


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def tokenizer_json(path: str) -> bytes:
    """A tokenizer file's bytes on the driver; they are broadcast (files of one or two MB)."""
    with open(os.fspath(path), "rb") as f:
        return f.read()


# --- words and their hashes, a whole Arrow batch at a time -----------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240521).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(4096, dtype=np.uint64)
for _i in range(1, len(_POWERS)):
    _POWERS[_i] = (int(_POWERS[_i - 1]) * _BASE) & (2**64 - 1)


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, at: int, piece_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch as runs of rows of about ``piece_bytes`` in text column ``at``; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = np.concatenate([[0], np.cumsum(size)]), 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + piece_bytes, "right")) - 1)
        yield batch.slice(row, last - row)
        row = last


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None


def give_back() -> None:
    """Return memory that a task has freed to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def word_hashes(texts: pa.Array, piece_bytes: int = 256 << 10) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text, A-Z lowered, and the n + 1 offsets of the texts' words.

    Words are maximal runs of bytes other than space and 0x09-0x0D. Work goes in pieces of about
    ``piece_bytes`` cut between texts, so memory follows the batch and its longest text.
    """
    raw, ends = _text_buffers(texts)
    n = len(ends) - 1
    hashes, counts = [], np.zeros(n, np.int64)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + piece_bytes, "right")) - 1)
        last = min(last, n)
        part = raw[ends[row] : ends[last]]
        if len(part):
            word = ~_SPACE[part]
            first = word.copy()
            first[1:] &= ~word[:-1]
            starts = ends[row : last] - ends[row]
            at = starts[(starts < len(part))]
            first[at] = word[at]
            at = np.flatnonzero(first)
            if len(at):
                low = _LOWER[part]
                index = np.flatnonzero(word)
                which = np.cumsum(first[index]) - 1
                place = index - at[which]
                value = _BYTE[low[index]] * _POWERS[place & 4095]
                if len(place) and place.max() > 4095:
                    value = value * (np.uint64(2) * (place >> 12).astype(np.uint64) + np.uint64(1))
                begin = np.searchsorted(index, at)
                h = np.add.reduceat(value, begin)
                length = np.diff(np.append(begin, len(index))).astype(np.uint64)
                hashes.append(mix(h ^ (length << np.uint64(56))))
                counts[row:last] = np.diff(np.searchsorted(at, ends[row : last + 1] - ends[row]))
        row = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def rows_where(df: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows, with all their columns, whose text ``keep`` accepts.

    ``keep`` is called once per task and returns a function from the texts of a batch to a mask; null text
    counts as empty.
    """
    at = df.columns.index(text_col)

    def run(batches):
        accepts = keep()
        for batch in batches:
            for rows in slices(batch, at):
                yield rows.filter(pa.array(accepts([t.as_py() or "" for t in rows.column(at)]), pa.bool_()))
        del accepts
        give_back()

    return df.mapInArrow(run, df.schema)

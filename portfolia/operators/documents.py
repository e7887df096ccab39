"""Document parsing, field extraction, chunking (items 33, 84, 104-107)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Elements whose content is not part of the text.
DROPPED_ELEMENTS = ("head", "script", "style", "nav", "footer", "noscript")
#: Named entities; the ampersand comes last so that nothing is decoded twice.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
DROPPED = rf"(?is)<!--.*?-->|<({'|'.join(DROPPED_ELEMENTS)})\b.*?</\1\s*>"
HEADING = r"(?i)<h([1-6])\b[^>]*>"
BLOCKS = r"(?i)</?(p|div|article|section|main|header|ul|ol|table|tr|blockquote|h[1-6]|body|html)\b[^>]*>"
BREAKS = r"(?i)<(br|li)\b[^>]*>"
TAGS = r"(?s)<[^>]*>"
#: Marks a heading level between two steps; not a character of any page's text.
MARK = "\x01"


def parse_documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """Item 104: adds ``title`` and ``content`` to rows that hold raw HTML.

    Headings become ``#`` lines, blocks are set apart by a blank line, list items and
    breaks start a line. All steps are JVM string functions over the whole page, row by
    row, so the job needs no shuffle and no Python.
    """
    def sub(text: Column, pattern: str, new: str) -> Column:
        return F.regexp_replace(text, F.lit(pattern), F.lit(new))

    text = sub(F.col(html), DROPPED, "")
    text = sub(text, HEADING, f"\n\n{MARK}$1")
    text = sub(sub(sub(text, BLOCKS, "\n\n"), BREAKS, "\n"), TAGS, "")
    for level in range(1, 7):
        text = F.replace(text, F.lit(f"{MARK}{level}"), F.lit("#" * level + " "))
    title = F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title", 1)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
        title = F.replace(title, F.lit(entity), F.lit(char))
    # Lone spaces, by far the most, are left alone.
    text = sub(text, r"[ \t\r]{2,}|[\t\r]", " ")
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    text = sub(text, r"\n{3,}", "\n\n")
    return pages.withColumns({"title": F.trim(title), "content": F.btrim(text, F.lit(" \n"))})


# Field extraction ------------------------------------------------------------------------

COMPANY_PATTERN = r"(?i)(?:insurer|insured by|underwritten by):?[ ]+([^\n.;,]+)"
ISO_DATE_PATTERN = r"(?i)effective[^\n]{0,40}?([0-9]{4}-[0-9]{2})"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]
WORD_DATE_PATTERN = rf"(?i)effective[^\n]{{0,40}}?({'|'.join(MONTHS)})[ ]+([0-9]{{4}})"


def company_of(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, COMPANY_PATTERN, 1)), F.lit(""))


def effective_month_of(text: Column) -> Column:
    """``yyyy-MM`` of the effective date, written as digits or with a month name."""
    name = F.initcap(F.regexp_extract(text, WORD_DATE_PATTERN, 1))
    number = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("string"), 2, "0")
    worded = F.concat(F.regexp_extract(text, WORD_DATE_PATTERN, 2), F.lit("-"), number)
    iso = F.regexp_extract(text, ISO_DATE_PATTERN, 1)
    return F.when(iso != "", iso).when(name != "", worded)


EXTRACTORS = {"company": company_of, "date": effective_month_of}


def extract_fields(
    docs: DataFrame,
    key: str = "relative_path",
    text: str = "raw_text",
    extractors: dict = EXTRACTORS,
    head_chars: int | None = None,
) -> DataFrame:
    """Item 105: one row per document with its extracted fields.

    An extractor maps a text column to a value column. The whole text is searched;
    ``head_chars=3000`` gives the reference's bounded prompt.
    """
    source = F.col(text) if head_chars is None else F.left(F.col(text), F.lit(head_chars))
    return docs.select(key, *[fn(source).alias(name) for name, fn in extractors.items()])


def extract_fields_with(docs: DataFrame, extract_batch, schema: str, key: str = "relative_path",
                        text: str = "raw_text") -> DataFrame:
    """Item 105 with a batch function (pandas frame in, frame out) as the extractor."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extract_batch(batch)

    return docs.select(key, text).mapInPandas(run, schema)


def join_doc_fields(docs: DataFrame, fields: DataFrame, key: str = "relative_path") -> DataFrame:
    """Item 33: documents with their extracted fields."""
    return docs.join(fields, key)


# Chunking --------------------------------------------------------------------------------

#: Chunk size, overlap and separators.
CHUNK_SIZE, CHUNK_OVERLAP, SEPARATORS = 4000, 400, ("\n\n", " ")


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: Sequence[str] = SEPARATORS) -> list[str]:
    """The chunks of one text."""
    spans = _spans(pa.array([text]), size, overlap, separators)
    return _texts_at(pa.array([text]), spans).to_pylist()


class _Chars:
    """The characters of all texts of a batch in one row: their bytes, where each begins, and where texts begin."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        begins = (self.raw & 0xC0) != 0x80
        self.byte = np.append(np.flatnonzero(begins), len(self.raw))
        self.start = np.searchsorted(self.byte, offsets - offsets[0])

    def places(self, separator: str) -> np.ndarray:
        """Every character at which the separator stands whole in one text."""
        sign = np.frombuffer(separator.encode(), np.uint8)
        hit = np.ones(max(len(self.raw) - len(sign) + 1, 0), bool)
        for j, c in enumerate(sign):
            hit &= self.raw[j : j + len(hit)] == c
        at = np.searchsorted(self.byte, np.flatnonzero(hit))
        text = np.searchsorted(self.start, at, "right")
        return at[at + len(separator) <= self.start[np.minimum(text, len(self.start) - 1)]]


def _spans(texts: pa.Array, size: int, overlap: int, separators: Sequence[str]) -> tuple[np.ndarray, ...]:
    """text, number, start and stop (characters of the batch) of all chunks; one step cuts the next chunk of every text.

    A chunk ends after the last occurrence of the first separator that occurs in its
    window, or at the window's end if none does. The next chunk starts inside the
    last ``overlap`` characters, at the first separator boundary there.
    """
    chars = _Chars(texts)
    found = [(chars.places(s), len(s)) for s in separators]
    text = np.flatnonzero(np.diff(chars.start))
    start, end = chars.start[text], chars.start[text + 1]
    out, no = [], 0

    def at(places: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The place of an index, or -1 outside."""
        inside = (index >= 0) & (index < len(places))
        return np.where(inside, places[np.where(inside, index, 0)] if len(places) else -1, -1)

    while len(text):
        stop = np.minimum(start + size, end)
        open_ = stop < end
        for places, n in found:
            last = at(places, np.searchsorted(places, stop - n, "right") - 1)
            here = open_ & (last > start + overlap)
            stop = np.where(here, last + n, stop)
            open_ &= ~here
        out.append((text, np.full(len(text), no), start, stop))
        on = stop < end
        text, start, stop, end = text[on], start[on], stop[on], end[on]
        back = np.maximum(stop - overlap, start + 1)
        begin, open_, any_ = stop.copy(), np.ones(len(text), bool), np.zeros(len(text), bool)
        for places, n in found:
            first = at(places, np.searchsorted(places, back, "left"))
            seen = (first >= 0) & (first + n <= stop)
            any_ |= seen
            here = open_ & seen & (first + n < stop)
            begin = np.where(here, first + n, begin)
            open_ &= ~here
        start, no = np.where(open_ & ~any_, back, begin), no + 1
    text, number, start, stop = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((number, text))
    return text[order], number[order], start[order], stop[order], chars


def _texts_at(texts: pa.Array, spans: tuple) -> pa.Array:
    """The texts of spans; overlapping ones share bytes of the input."""
    _, _, start, stop, chars = spans
    begin, end = chars.byte[start], chars.byte[stop]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    data = np.concatenate([chars.raw[:0], *[chars.raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def chunk_text(docs: DataFrame, text: str = "raw_text", size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """Items 84 and 106: one row per chunk, with its number and the character where it starts.

    The input is plain text, not a serialised parse result, so blank lines are real
    line breaks and the first separator can match. All texts of a slice of about ``SLICE_BYTES`` are cut at once, by
    arithmetic on the places of their separators. NULL and empty texts have no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    kept = [c for c in docs.columns if c != text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _byte_slices(batch, len(kept)):
                spans = _spans(rows.column(len(kept)), size, overlap, separators)
                own, number, start, _, chars = spans
                row = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(i).take(row) for i in range(len(kept))], pa.array(number.astype(np.int32)),
                     pa.array((start - chars.start[own]).astype(np.int32)), _texts_at(rows.column(len(kept)), spans)],
                    names=[*kept, "chunk_no", "start", "chunk"])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("chunk_no", T.IntegerType()),
                           T.StructField("start", T.IntegerType()), T.StructField("chunk", T.StringType())])
    return docs.select(*kept, text).mapInArrow(cut, schema)


#: Text bytes that are cut into chunks at once, at about ten bytes of memory each; a longer text is cut by itself.
SLICE_BYTES = 1 << 20


def _byte_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, row = np.concatenate([[0], np.cumsum(sizes)]), 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(row, last - row)
        row = last


def build_chunk_table(docs: DataFrame, fields: DataFrame | None = None, **chunking) -> DataFrame:
    """Item 107: chunks with file name, document type and extracted fields.

    Without given fields they are read from each text in place, so no text is shuffled. Given fields are joined to
    whole documents before they are cut, as there are fewer rows.
    """
    rows = docs.select("relative_path", "raw_text")
    joined = join_doc_fields(rows, fields) if fields is not None else rows.select(
        "*", *[fn(F.col("raw_text")).alias(name) for name, fn in EXTRACTORS.items()])
    return chunk_text(joined, **chunking).select(
        "relative_path", "company", "date",
        F.array(F.lit("INSURANCE_DOCS")).alias("document_type"),
        F.split_part("relative_path", F.lit("/"), F.lit(-1)).alias("document"),
        "chunk_no",
        F.col("chunk").alias("text"),
    )

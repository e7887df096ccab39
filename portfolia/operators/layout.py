"""Layout of HTML pages by a stack of open tags (item 104): nested lists, tables as rows, tags that are never closed.

:func:`documents.parse_documents` flattens a page by string functions in the JVM; this one keeps what lies in what. A
page is read once from left to right. Every page is a row, so the job needs no shuffle; a task holds one page's tokens.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from portfolia.operators.documents import DROPPED_ELEMENTS

#: A comment, an element whose content is no text (to its end, or to the page's), a tag, or a run of text.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(DROPPED_ELEMENTS)})\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?/][^>]*>|[^<]+|<",
    re.I | re.S)
TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
BLOCKS = frozenset("p div article section main header blockquote body html".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
VOID = frozenset("br img hr meta link input col area base source wbr".split())
#: What an opening tag closes if it is still open, and the elements behind which it looks no further.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"li", "td", "th", "blockquote", "div", "table"}),
    **{h: ({"p", *HEADINGS}, {"li", "td", "th", "div", "table"}) for h in HEADINGS}}
#: Stand for one step of indentation, and for a cell's end, until spaces are settled.
STEP, CELL = "\x01", "\x02"


class _Page:
    """The text so far and the open elements: name, and the number of the last item for lists."""

    def __init__(self):
        self.out: list[str] = []
        self.open: list[list] = []

    def _inside(self, *names: str) -> int:
        return sum(e[0] in names for e in self.open)

    def start(self, tag: str) -> None:
        closes, wall = CLOSES.get(tag, ((), ()))
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in wall:
                break
            if self.open[at][0] in closes:
                self._close(at)
        in_cell = self._inside("td", "th") > 0
        if tag in ("ul", "ol"):
            self.out.append("" if self._inside("ul", "ol") or in_cell else "\n\n")
        elif tag == "li":
            lists = [e for e in self.open if e[0] in ("ul", "ol")]
            mark = "- "
            if lists:
                lists[-1][1] += 1
                mark = f"{lists[-1][1]}. " if lists[-1][0] == "ol" else mark
            self.out.append(("; " if in_cell else "\n" + STEP * max(len(lists) - 1, 0)) + mark)
        elif tag == "tr":
            self.out.append("\n")
        elif tag == "br":
            self.out.append(" " if in_cell else "\n")
        elif tag in HEADINGS:
            self.out.append(" " if in_cell else "\n\n" + "#" * HEADINGS[tag] + " ")
        elif tag == "table":
            self.out.append(" " if in_cell else "\n\n")
        elif tag in BLOCKS:
            self.out.append(self._gap(in_cell))
        if tag not in VOID:
            self.open.append([tag, 0])

    def _gap(self, in_cell: bool) -> str:
        """Between blocks: a blank line; in an item or a cell, which are one line, a space."""
        return " " if in_cell or self._inside("li") else "\n\n"

    def end(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return
            if self.open[at][0] in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return  # what began outside a cell does not end in it
        if tag in BLOCKS or tag in HEADINGS:
            self.out.append(self._gap(self._inside("td", "th") > 0))

    def _close(self, at: int) -> None:
        """Close the element at a place of the stack and all that is still open in it."""
        for tag, _ in reversed(self.open[at:]):
            self.open.pop()
            in_cell = self._inside("td", "th") > 0
            if tag in ("td", "th"):
                self.out.append(" " if in_cell else CELL)
            elif tag in ("ul", "ol"):
                self.out.append("" if self._inside("ul", "ol") or in_cell else "\n\n")
            elif tag in HEADINGS:
                self.out.append(" " if in_cell else "\n\n")
            elif tag == "table":
                self.out.append(" " if in_cell else "\n\n")
            elif tag in BLOCKS:
                self.out.append(self._gap(in_cell))


def layout(page: str) -> str:
    """The text of a page: headings with ``#``, blocks apart, items indented and marked, cells joined by `` | ``."""
    read = _Page()
    for m in TOKEN.finditer(page):
        token = m[0]
        if m[3]:
            (read.end if m[2] else read.start)(m[3].lower())
        elif not token.startswith("<") or token == "<":
            read.out.append(entities.unescape(token).replace("\xa0", " ").replace(STEP, " ").replace(CELL, " "))
    while read.open:
        read._close(len(read.open) - 1)
    text = re.sub(r"[ \t\r]+", " ", "".join(read.out))
    text = re.sub(r" ?\n ?", "\n", text)
    text = re.sub(rf"((?:^|\n|{CELL}) ?); ", r"\1", text)
    text = re.sub(rf" ?{CELL} ?(?=\n|\Z)", "", text)
    text = re.sub(rf" ?{CELL} ?", " | ", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip(" \n")
    return text.replace(STEP, "  ")


def title_of(page: str) -> str:
    found = TITLE.search(page)
    return entities.unescape(found[1]).replace("\xa0", " ").strip(" ") if found else ""


def parse_layout(pages: DataFrame, html: str = "html") -> DataFrame:
    """Item 104: the rows with ``title`` and ``content`` of their page; a NULL page has neither."""
    at = pages.columns.index(html)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            made = [[None if t is None else f(t) for t in texts] for f in (title_of, layout)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(m, pa.string()) for m in made]], names=[*batch.schema.names, "title", "content"])

    return pages.mapInArrow(read, T.StructType([
        *pages.schema, T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))

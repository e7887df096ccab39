"""Quality rules: a table of thresholds compiled into one Spark projection.

The projection makes one struct of counts per text from its words and lines: sizes, symbols, stop words, letters,
repeated lines and words in repeated windows. Every row of the threshold table then becomes one comparison of two of
these counts, in whole numbers, and a document is kept if all hold. No user functions, no joins, no shuffles: a text
is read once, in the task that scans it.

Windows found twice are seen by sorting a text's windows, with their places, by hash and words: neighbours that are
equal are repeats. So the work on a text of n words is n log n, and memory is a few dozen bytes a word.

Rows: null counts as empty text; a text without words has all counts 0 and fails; repeated rows are judged alike; a
null id is kept as it is; an empty table gives no rows. Other columns are unread.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as by this are at from was "
    "le la les de des et un une en du que qui pour dans est par sur pas au avec "
    "der die das und von zu mit ein eine nicht auf den im dem sich ist für als "
    "el los las y con por una del se no su para al lo").split()
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 3


class Rule(NamedTuple):
    """``part`` must be at least ``least`` and at most ``most`` percent of ``whole`` (None: no bound)."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: What every kept text must satisfy beside the base rules.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 300, 1000),
    Rule("symbols to words", "n_symbols", "n_words", None, 10),
    Rule("stop words", "n_stop_words", "n_words", 5, None),
    Rule("different stop words", "n_stop_kinds", "one", 200, None),
    Rule("words with a letter", "n_letter_words", "n_words", 80, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("lines that end in an ellipsis", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("lines that begin with a bullet", "n_bullet_lines", "n_lines", None, 90),
)
#: The base: enough words, and at most so many percent of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row: the one element of an array, bound by a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_where(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def covered(starts: Column, width: int) -> Column:
    """How many places windows of one width cover, given the sorted places where they begin."""
    gain = F.transform(starts, lambda x, p: F.least(F.coalesce(F.get(starts, p + 1) - x, F.lit(width)), F.lit(width)))
    return F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more, the first occurrence included."""
    def window(i: Column) -> Column:
        own = [F.get(words, i + j) for j in range(width)]
        return F.struct(F.xxhash64(*own).alias("h"), F.struct(*[w.alias(f"w{j}") for j, w in enumerate(own)]).alias("w"),
                        i.alias("i"))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

    def starts(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, p: same(x, F.get(ordered, p + 1)) | same(x, F.get(ordered, p - 1)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), window)
    found = let(F.sort_array(windows), lambda ordered: let(starts(ordered), lambda s: covered(s, width)))
    return F.when(F.size(words) >= width, found).otherwise(F.lit(0).cast("long"))


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """A struct of all counts of a text."""
    whole = F.coalesce(text, F.lit(""))
    lower = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def plain(word: Column) -> Column:
        return F.btrim(word, F.lit(".,;:!?\"'()"))

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            count_where(words, lambda w: w.rlike(r"\p{L}")).alias("n_letter_words")]

    def of_stops(found: Column) -> list[Column]:
        return [F.size(found).cast("long").alias("n_stop_words"),
                F.size(F.array_distinct(found)).cast("long").alias("n_stop_kinds")]

    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            count_where(lines, lambda x: x.rlike(rf"(\.\.\.|…){SPACE}*$")).alias("n_ellipsis_lines"),
            count_where(lines, lambda x: x.rlike(rf"^{SPACE}*[-*•]")).alias("n_bullet_lines")]

    stops = F.filter(F.transform(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), plain),
                     lambda w: w.isin(*stop_words))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    return F.struct(
        let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), lambda w: F.struct(*of_words(w))).alias("words"),
        let(stops, lambda w: F.struct(*of_stops(w))).alias("stops"),
        let(lines, lambda x: F.struct(*of_lines(x))).alias("lines"),
        (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"))


COUNTS = {
    "words": ("n_words", "word_chars", "n_repeat_words", "n_letter_words"),
    "stops": ("n_stop_words", "n_stop_kinds"),
    "lines": ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}


def compiled(rules: Sequence[Rule], of: Callable[[str], Column]) -> Column:
    """The threshold table as one condition over the counts."""
    out = F.lit(True)
    for r in rules:
        part, whole = of(r.part) * 100, F.lit(1) if r.whole == "one" else of(r.whole)
        if r.least is not None:
            out = out & (part >= whole * r.least)
        if r.most is not None:
            out = out & (part <= whole * r.most)
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, the counts, base_failed and kept."""
    def verdict(m: Column) -> Column:
        place = {name: m[group][name] for group, names in COUNTS.items() for name in names}
        place["n_symbols"] = m["n_symbols"]
        n = place["n_words"]
        failed = (n < LEAST_WORDS) | (place["n_repeat_words"] * 100 > n * MOST_REPEATED)
        return F.struct(*[c.alias(k) for k, c in place.items()], failed.alias("base_failed"),
                        (~failed & compiled(rules, place.__getitem__)).alias("kept"))

    one = docs.select(F.col(id_col), let(measures(F.col(text_col), stop_words), verdict).alias("verdict"))
    return one.select(id_col, "verdict.*")

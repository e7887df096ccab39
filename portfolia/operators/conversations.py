"""Message runs, role alternation and event folding (items 72, 73, 109).

A conversation or stream may hold a third of all rows, so none of these gathers a whole group. Everything is decided
on rows without texts, which are numbered by one sort over all of them; texts are attached once, in pieces of about
``PIECE_BYTES``. Every text comes out as pieces with a number ``part``: the window of that many bytes of the whole text
in which the piece begins. Put together in order, without anything between them, the pieces are the whole text.

Rows without a conversation form one of their own; rows without a turn stand behind those that have one; rows that are
equal in everything are kept as often as they occur; a row without a role makes a run of its own kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from portfolia.operators.skew import BLOCK, number_runs, numbered

#: Bytes of text after which a new piece begins; a piece is longer by at most one input text.
PIECE_BYTES = 1 << 20

BLANK_LINE = "\n\n"
#: What is cut off around the text of an event stream.
WHITE = " \t\n\r\x0b\x0c"
#: The line that tells of a used tool, and its name where the event has none.
TOOL_LINE, NO_TOOL = "I used the following tool to serve your request: **{}**\n\n", "Unknown tool"


def _present(role: str) -> Column:
    """A role as a value that is never NULL, so that rows without one still open and close runs."""
    return F.coalesce(F.concat(F.lit("="), F.col(role)), F.lit("none"))


def _slim(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per different row of ``keys`` and text, without the text: its digest, size and number of copies."""
    return rows.groupBy(*keys, F.md5(F.coalesce(F.col(text), F.lit("?"))).alias("_digest"), F.col(text).isNull().alias("_no")).agg(
        F.count(F.lit(1)).alias("_copies"), F.coalesce(F.max(F.octet_length(text)), F.lit(0)).cast("long").alias("_bytes"))


def _in_pieces(slim: DataFrame, texts: DataFrame, keys: Sequence[str], text: str, group: Sequence[str],
               carried: Sequence[str], separator: str, piece_bytes: int) -> DataFrame:
    """``group``, ``carried``, part, text and the last place: every group's texts, joined by ``_place``, in pieces.

    ``slim`` are the rows of :func:`_slim` that take part, with ``_place`` over all rows; ``texts`` are the input rows.
    Offsets are sums of bytes inside blocks of places and over the blocks' totals. Copies of one row are dealt to
    chunks of a piece's size, so that not even they are gathered.
    """
    gap = len(separator.encode())
    size = F.greatest(F.col("_bytes") + gap, F.lit(1))
    chunk = slim.withColumn("_per", F.greatest(F.floor(F.lit(piece_bytes) / size), F.lit(1))).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / F.col("_per")))))
    chunk = chunk.withColumn("_times", F.least("_per", F.col("_copies") - F.col("_chunk") * F.col("_per")))
    chunk = chunk.withColumn("_size", F.col("_times") * (F.col("_bytes") + gap)).withColumn(
        "_block", F.floor(F.col("_place") / BLOCK))
    order = Window.partitionBy(*group, "_block").orderBy("_place", "_chunk")
    over = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = chunk.groupBy(*group, "_block").agg(F.sum("_size").alias("_all")).withColumn(
        "_before", F.coalesce(F.sum("_all").over(over), F.lit(0))).drop("_all")
    placed = chunk.withColumn("_inside", F.sum("_size").over(order) - F.col("_size")).alias("x").join(
        blocks.alias("y"), _same("x", "y", [*group, "_block"])).select("x.*", "y._before")
    placed = placed.withColumn("part", F.floor((F.col("_before") + F.col("_inside")) / piece_bytes))
    key = [*keys, "_digest", "_no"]
    whole = texts.withColumns({"_digest": F.md5(F.coalesce(F.col(text), F.lit("?"))), "_no": F.col(text).isNull()}).groupBy(
        *key).agg(F.first(text).alias("_text"))
    met = placed.alias("x").join(whole.alias("y"), _same("x", "y", key)).select("x.*", "y._text")
    copies = F.array_repeat(F.coalesce("_text", F.lit("")), F.col("_times").cast("int"))
    pieces = met.groupBy(*group, *carried, "part").agg(F.array_sort(F.collect_list(F.struct(
        "_place", "_chunk", F.array_join(copies, separator).alias("t")))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x: x["t"]), separator)
    return pieces.select(*group, *carried, "part", F.when(F.col("part") > 0, F.concat(F.lit(separator), text)).otherwise(
        text).alias("text"), F.element_at("_all", -1)["_place"].alias("_end"))


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _runs(messages: DataFrame, keys: Sequence[str], tracks: dict[str, Column]) -> DataFrame:
    """The slim rows of messages in order, with their place and the numbers of their runs."""
    slim = numbered(_slim(messages, keys, "text"), [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn"), "_digest",
                                                    *[k for k in keys if k not in ("conv_id", "turn")]], "_place")
    return number_runs(slim, "conv_id", "_place", tracks)


def coalesce_turns(messages: DataFrame, properties: Sequence[str] = (), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Item 72: merge consecutive messages of one role, joined by a blank line; empty ones are skipped.

    The first message's type is kept. ``properties`` are columns of which a run of the assistant keeps the last value
    that is not NULL; runs of others have none. Output: conversation, run, first turn, role, type, number of messages,
    properties, part, text.
    """
    keys = ["conv_id", "turn", "role", "type", *properties]
    runs = _runs(messages, keys, {"run": _present("role")})
    last = [F.max_by(p, F.when(F.col(p).isNotNull() & (F.col("role") == "assistant"), F.col("_place"))).alias(f"_p{i}")
            for i, p in enumerate(properties)]
    heads = runs.groupBy("conv_id", "run").agg(
        F.min_by("turn", "_place").alias("first_turn"), F.first("role").alias("_role"),
        F.min_by("type", "_place").alias("_type"), F.sum("_copies").alias("n_messages"), *last)
    facts = ["first_turn", "_role", "_type", "n_messages", *[f"_p{i}" for i in range(len(properties))]]
    filled = runs.where("_bytes > 0").alias("x").join(heads.alias("h"), _same("x", "h", ["conv_id", "run"])).select(
        "x.*", *[f"h.{f}" for f in facts])
    pieces = _in_pieces(filled, messages, keys, "text", ["conv_id", "run"], facts, BLANK_LINE, piece_bytes)
    blank = heads.alias("h").join(runs.where("_bytes > 0").select("conv_id", "run").distinct().alias("x"),
                                  _same("x", "h", ["conv_id", "run"]), "left_anti")
    stubs = blank.select("conv_id", "run", *facts, F.lit(0).cast("long").alias("part"), F.lit("").alias("text"))
    return pieces.drop("_end").unionByName(stubs).select(
        "conv_id", "run", "first_turn", F.col("_role").alias("role"), F.col("_type").alias("type"), "n_messages",
        *[F.col(f"_p{i}").alias(p) for i, p in enumerate(properties)], "part", "text")


def alternate_roles(messages: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Item 73: strict user/assistant alternation, starting with the user.

    Messages of other roles split runs and are then ignored. Of neighbouring runs of
    one role the first is taken: its first message for the user, all its text messages
    for the assistant. Leading assistant runs are dropped. An assistant run without
    text leaves two user runs side by side, of which the later stays.
    """
    keys = ["conv_id", "turn", "role", "type"]
    taking_part = F.when(F.col("role").isin("user", "assistant"), F.col("role"))
    runs = _runs(messages, keys, {"_raw_run": _present("role"), "run": taking_part}).where(F.col("run").isNotNull())
    is_text = F.col("type") == "text"
    per_raw = runs.groupBy("conv_id", "run", "_raw_run").agg(
        F.min("_place").alias("at"), F.min_by("turn", "_place").alias("turn"), F.count_if(is_text).alias("n"),
        F.first("role").alias("role"))
    heads = per_raw.groupBy("conv_id", "run").agg(F.min(F.struct("_raw_run", "at", "turn", "n", "role")).alias("head"))
    # Each run also reports to the two runs before it, which saves a window over a
    # conversation's runs: is the next run empty, and is there one after that?
    empty = (F.col("head.role") == "assistant") & (F.col("head.n") == 0)
    reports = F.array(
        F.struct(F.col("run").alias("to"), F.col("head"), F.lit(False).alias("gap"), F.lit(False).alias("later")),
        F.struct((F.col("run") - 1).alias("to"), F.lit(None).alias("head"), empty.alias("gap"),
                 F.lit(False).alias("later")),
        F.struct((F.col("run") - 2).alias("to"), F.lit(None).alias("head"), F.lit(False).alias("gap"),
                 F.lit(True).alias("later")),
    )
    kept = (
        heads.select("conv_id", F.inline(reports)).groupBy("conv_id", F.col("to").alias("run"))
        .agg(F.max("head").alias("head"), F.max("gap").alias("gap"), F.max("later").alias("later"))
        .where(F.col("head").isNotNull() & ~empty)
        .where((F.col("run") > 1) | (F.col("head.role") == "user"))
        .where(~((F.col("head.role") == "user") & F.col("gap") & F.col("later")))
        .select("conv_id", "run", "head._raw_run", F.col("head.at").alias("_at"), F.col("head.turn").alias("first_turn"))
    )
    chosen = runs.alias("x").join(kept.alias("k"), _same("x", "k", ["conv_id", "run", "_raw_run"])).select(
        "x.*", "k._at", "k.first_turn").where(F.when(F.col("role") == "user", F.col("_place") == F.col("_at")).otherwise(
            F.coalesce(is_text, F.lit(False))))
    # Of a user's first message there is one, also where copies of it follow.
    chosen = chosen.withColumn("_copies", F.when(F.col("role") == "user", F.lit(1)).otherwise(F.col("_copies")).cast("long"))
    chosen = chosen.withColumn("_as", F.col("role"))
    pieces = _in_pieces(chosen, messages, keys, "text", ["conv_id", "run"], ["first_turn", "_as"], BLANK_LINE, piece_bytes)
    return pieces.select("conv_id", "run", "first_turn", F.col("_as").alias("role"), "part", F.col("text").alias("content"))


def assemble_events(events: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Item 109: fold each ordered event stream into one record, its text in pieces.

    Input: ``stream_id, ts, event_id, kind, body``, ordered by time and id. Reading stops at the first ``done``; an
    ``error`` before it wins and replaces the text. Otherwise the text is made of the bodies of ``text`` events, a line
    for each ``tool_use`` that names its tool, and the bodies of ``tool_results`` with a blank line behind them; white
    space around the whole is cut off. The last tool result is kept, too.
    """
    at = F.struct("ts", "event_id")

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, at))

    ends = events.groupBy("stream_id").agg(
        first("done").alias("done_at"), first("error").alias("error_at"),
        F.min_by("body", F.when(F.col("kind") == "error", at)).alias("error_body"),
    )
    failed = F.col("error_at").isNotNull() & (F.col("done_at").isNull() | (F.col("error_at") < F.col("done_at")))
    heads = ends.select(
        "stream_id", F.when(failed, "error").when(F.col("done_at").isNotNull(), "done").otherwise("open").alias("status"),
        F.when(failed, F.btrim("error_body", F.lit(WHITE))).alias("error_body"),
        # Nothing before an error reaches the output, so those events need no further work.
        F.when(~failed, F.col("done_at")).alias("cut"), (~failed).alias("_keep"),
    )
    line = F.replace(F.lit(TOOL_LINE), F.lit("{}"), F.coalesce("body", F.lit(NO_TOOL)))
    said = F.when(F.col("kind") == "text", F.col("body")).when(F.col("kind") == "tool_use", line).when(
        F.col("body") != "", F.concat("body", F.lit(BLANK_LINE)))
    told = events.where(F.col("kind").isin("text", "tool_use", "tool_results")).withColumn("_said", said)
    keys = ["stream_id", "ts", "event_id", "kind"]
    slim = _slim(told, [*keys, (F.btrim("_said", F.lit(WHITE)) != "").alias("_ink")], "_said")
    slim = numbered(slim, [F.asc_nulls_last("stream_id"), "ts", "event_id", "kind", "_digest"], "_place")
    live = slim.alias("x").join(heads.where("_keep").alias("h"), _same("x", "h", ["stream_id"])).select(
        "x.*", "h.cut").where(F.col("cut").isNull() | (at < F.col("cut"))).drop("cut")
    # From the first to the last event with more than white space the text is whole; its edges are cut.
    edge = live.where("_ink").groupBy("stream_id").agg(F.min("_place").alias("_from"), F.max("_place").alias("_to"))
    counts = live.groupBy("stream_id").agg(
        F.sum(F.when(F.col("kind") == "text", F.col("_copies")).otherwise(0)).alias("n_texts"))
    tools = events.alias("x").join(heads.where("_keep").alias("h"), _same("x", "h", ["stream_id"])).where(
        "x.kind = 'tool_results'").where(F.col("h.cut").isNull() | (F.struct("x.ts", "x.event_id") < F.col("h.cut"))).groupBy(
        "x.stream_id").agg(F.max_by("x.body", F.struct("x.ts", "x.event_id")).alias("tool_result"))
    records = heads.select("stream_id", "status", "error_body")
    for table in (counts, tools, edge):
        new = [c for c in table.columns if c != "stream_id"]
        records = records.alias("x").join(table.alias("y"), _same("x", "y", ["stream_id"]), "left").select(
            "x.*", *[f"y.{c}" for c in new])
    # The record travels with the rows without texts, so that no text is shuffled once more to meet it.
    facts = ["status", "n_texts", "tool_result", "_to"]
    inner = live.alias("x").join(records.where("_from IS NOT NULL").alias("y"), _same("x", "y", ["stream_id"])).where(
        "_bytes > 0 AND _place BETWEEN y._from AND y._to").select("x.*", *[f"y.{f}" for f in facts])
    pieces = _in_pieces(inner, told, keys, "_said", ["stream_id"], facts, "", piece_bytes)
    text = F.when(F.col("part") == 0, F.ltrim("text", F.lit(WHITE))).otherwise(F.col("text"))
    text = F.when(F.col("_end") == F.col("_to"), F.rtrim(text, F.lit(WHITE))).otherwise(text)
    stubs = records.where("_from IS NULL").select(
        "stream_id", F.lit(0).cast("long").alias("part"), "status", F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        F.coalesce("error_body", F.lit("")).alias("text"), "tool_result")
    return pieces.select("stream_id", "part", "status", "n_texts", text.alias("text"), "tool_result").unionByName(stubs)

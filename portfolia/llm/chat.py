"""Chat formatting with a grammar round trip, in DataFrame functions only.

The grammar of a rendered conversation::

    conversation := turn*
    turn         := "<s>[INST] " level " " role " [/INST]" text "</s>"
    level        := "0" | "1"

At level 0 role and text stand as they are; at level 1 every backslash in them is doubled and every control
string gets a backslash after its first character. The parser is deterministic: it cuts at "</s>" and, in
each piece, at the first " [/INST]". A turn is rendered at level 0, reparsed and compared with its source;
if anything differs it is escaped (level 1) and tried again. A level-1 turn holds no control string, so the
second try is the last; a difference after it, or in a whole block, raises.

Turns are rendered in blocks of ``BLOCK`` turn numbers, so a conversation with any share of the rows is
spread over tasks; block follows block in one conversation's text.

Rows: null role or text counts as empty; null turns come first; ties of turn are ordered by role, then text,
and repeated rows are turns of their own; a null conversation id is a conversation. Other columns are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
OPEN, SHUT, END = "<s>[INST] ", " [/INST]", "</s>"
BLOCK = 64


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(f"{word[0]}\\{word[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column, level: int) -> Column:
    if level:
        role, text = escape(role), escape(text)
    return F.concat(F.lit(f"{OPEN}{level} "), role, F.lit(SHUT), text, F.lit(END))


def _parse_piece(piece: Column) -> Column:
    """Role, text and the place of the text within one turn, read from what stands before its end mark."""
    shut = F.instr(piece, SHUT)
    head = len(OPEN) + 2
    good = piece.startswith(OPEN) & (shut > head) & piece.substr(len(OPEN) + 1, 2).isin("0 ", "1 ")
    level = piece.substr(len(OPEN) + 1, 1)
    role = piece.substr(F.lit(head + 1), shut - F.lit(head + 1))
    text = piece.substr(shut + len(SHUT), F.length(piece))
    def plain(x: Column) -> Column:
        return F.when(level == "1", unescape(x)).otherwise(x)
    return F.when(good, F.struct(
        plain(role).alias("role"), plain(text).alias("text"), level.alias("level"),
        (shut + F.lit(len(SHUT) - 1)).alias("text_at"), F.length(text).alias("length"), F.length(piece).alias("size")))


def parse(rendered: Column) -> Column:
    """The turns of rendered text, in order; a piece that the grammar does not allow is null."""
    pieces = F.split(rendered, END)
    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), _parse_piece)


def _says(turn: Column) -> Column:
    return F.struct(turn["role"].alias("role"), turn["text"].alias("text"))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Render conversations: ``conv``, block, formatted, n_turns and the loss mask.

    ``loss_mask`` lists (start, length) in code points from 0 over the block's formatted text: the texts of
    the trained role, without their marks.
    """
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    said = F.array(F.struct("role", "text"))
    def same(rendered: Column) -> Column:
        return F.transform(parse(rendered), _says).eqNullSafe(said)
    raw, escaped = (_render(F.col("role"), F.col("text"), level) for level in (0, 1))
    turns = rows.select(
        "conv", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", "role", "text",
        F.when(same(raw), raw).when(same(escaped), escaped)
        .otherwise(F.raise_error(F.lit("a chat turn cannot be read back"))).alias("rendered"))
    blocks = turns.groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns"))
    blocks = blocks.select(
        "conv", "block", F.transform("turns", _says).alias("source"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"))
    read = blocks.withColumn("read", parse(F.col("formatted")))
    read = read.withColumn("formatted", F.when(
        F.transform("read", _says).eqNullSafe(F.col("source")), F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a chat block cannot be read back"))))
    spans = F.aggregate(
        "read", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"] + len(END)).alias("at"),
            F.when(t["role"] == trained_role, F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + t["text_at"]).alias("start"), t["length"].alias("length")))))
            .otherwise(acc["spans"]).alias("spans")))
    return read.select(
        F.col("conv").alias(conv), "block", "formatted", F.size("read").cast("long").alias("n_turns"),
        spans["spans"].alias("loss_mask"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Read blocks back: all columns of ``format_chat`` with the turns and the unescaped texts under the mask.

    A masked text is unescaped when its turn says so; the turn is found by the place where its text starts.
    """
    turns = parse(F.col("formatted"))
    starts = F.aggregate(
        turns, F.struct(F.lit(0).alias("at"), F.expr("cast(map() as map<int,string>)").alias("level")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"] + len(END)).alias("at"),
            F.map_concat(acc["level"], F.create_map(acc["at"] + t["text_at"], t["level"])).alias("level")))
    with_levels = formatted.withColumn("levels", starts["level"])
    def under(span: Column) -> Column:
        cut = F.substring(F.col("formatted"), span["start"] + 1, span["length"])
        return F.when(F.col("levels")[span["start"]] == "1", unescape(cut)).otherwise(cut)
    return with_levels.select(
        *formatted.columns, F.transform(turns, _says).alias("turns"),
        F.transform("loss_mask", under).alias("masked")).drop("levels")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation: counts and digests of what is read back from the blocks, joined in their order."""
    parts = read_chat(formatted).select(
        conv, "block", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        .alias("said"), F.array_join("masked", "").alias("loss"))
    whole = parts.groupBy(conv).agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("block", "said", "loss"))).alias("parts"))
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        conv, "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")

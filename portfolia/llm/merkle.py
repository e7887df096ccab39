"""Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and a proof per row.

1. A leaf is the sha256 of a row's values, each as ``-`` if null, else its UTF-8 byte count, ``:`` and the value.
   Leaves of a group are numbered in order by one sort by ranges over all rows, so a group of any size is split.
2. At every level the nodes are joined with themselves on computed sibling indices: in a tree of pairs the sibling
   of node i is i XOR 1, else those at the other ``arity - 1`` offsets within its run. The row at slot zero of each
   run, which then holds the whole run, emits the parent, the sha256 of the run's hex digests. Groups of one node
   are done: that node is their root. The last level's roots, in the order of their groups, are leaves of a second
   forest with one tree.
3. Down from the root every node gets its parent's path behind its own siblings, by a join on the parent's index.
   A leaf's path proves it: the digests at its left and right, level by level, folded with it, give the root.

A level is a written table a third (1 / ``arity``) of the size of the one below it; the number of levels is the
logarithm of the largest group. Digests travel as bytes and are hashed as their lowercase hex text.

Rows: null values are ``-``; a null group is a group of its own and the first; null ids come first in a group;
equal ids are ordered by leaf; repeated rows are leaves of their own; a null id counts as empty text in ``tampered``;
an empty table gives no rows. Other columns are unread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import numbered, remainder, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """sha256 as lowercase hex text."""
    return F.sha2(value, 256)


def hexed(value: Column | str) -> Column:
    return F.lower(F.hex(value))


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's values, each with its length before it, so that no two rows read alike."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Every node with the digests of its run at its left and right, as bytes, and its slot in the run.

    ``nodes``: tree, i, h. One equijoin for each other place of the run; a place that the last run lacks is null.
    """
    slot, first = F.col("i") % arity, F.col("i") - F.col("i") % arity
    out = nodes.withColumn("slot", slot)
    others = range(1, arity)
    for k in others:
        index = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else first + (slot + k) % arity
        other = nodes.select(F.col("tree"), F.col("i").alias(f"i{k}"), F.col("h").alias(f"h{k}"))
        out = out.withColumn(f"i{k}", index).join(other, ["tree", f"i{k}"], "left")
    empty = F.lit(b"")
    # Offsets that pass the end of the run start again at its beginning: those are at the left.
    left = [F.when(F.col("slot") + k >= arity, F.coalesce(F.col(f"h{k}"), empty)).otherwise(empty) for k in others]
    right = [F.when(F.col("slot") + k < arity, F.coalesce(F.col(f"h{k}"), empty)).otherwise(empty) for k in others]
    return out.select("tree", "i", "slot", "h", F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def forest(leaves: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, from the leaves up, with siblings; and the root of every tree (tree, h).

    ``leaves``: a stored table of tree, i (from 0, without gaps) and h (bytes).
    """
    levels, roots, nodes = [], [], leaves
    while True:
        sizes = nodes.groupBy("tree").agg(F.max("i").alias("last"))
        if not (sizes.agg(F.max("last")).first()[0] or 0):
            return levels, _union([*roots, nodes.select("tree", "h")])
        alone = sizes.where("last = 0").select("tree")
        roots.append(nodes.where("i = 0").join(alone, "tree", "left_semi").select("tree", "h"))
        level = stored(_siblings(nodes.join(alone, "tree", "left_anti"), arity), f"{name}-{len(levels)}")
        levels.append(level)
        run = F.concat("h", "right")
        nodes = stored(level.where("slot = 0").select(
            "tree", F.floor(F.col("i") / arity).alias("i"), F.unhex(digest(hexed(run))).alias("h")), f"{name}-nodes")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """tree, i and path of every leaf: an array of (left, right), level by level, up to the last root.

    ``tops``: the path of each tree's root (tree, path). Rows meet their parent's path on the parent's index.
    """
    up = tops.select("tree", F.lit(0).cast("long").alias("i"), "path")
    for no, level in reversed(list(enumerate(levels))):
        own = level.select("tree", "i", F.floor(F.col("i") / arity).alias("p"), F.struct("left", "right").alias("s"))
        parents = up.withColumnRenamed("i", "p")
        # A tree that ends below this level keeps its own root's path for the levels under it.
        here = own.join(parents, ["tree", "p"]).select(
            "tree", "i", F.concat(F.array("s"), F.col("path")).alias("path"))
        lower = up.where("i = 0").join(level.select("tree").distinct(), "tree", "left_anti")
        up = here.unionByName(lower)
        if no:
            up = stored(up, f"paths-{no}")
    return up


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(hexed(s["left"]), h, hexed(s["right"]))))


def manifest(docs: DataFrame, arity: int = 3, fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
             group_col: str = "source", text_col: str = "text", tampered_parts: int = 2) -> DataFrame:
    """Per row: its id, leaf, subroot, root, proof_sha256, folded_root and verified.

    The check folds each row's path from a leaf that is computed anew. Rows whose id has a crc32 divisible by
    ``tampered_parts`` are tampered with before that: the line breaks of their text are deleted.
    """
    values = [F.col(f) for f in fields]
    cut = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == text_col else F.col(f) for f in fields]
    harmed = remainder(id_col, tampered_parts) == 0
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("g"), leaf_of(values).alias("leaf"),
        F.when(harmed, leaf_of(cut)).otherwise(leaf_of(values)).alias("now"))
    rows = rows.withColumns({"leaf": F.unhex("leaf"), "now": F.when(F.col("now") != F.col("leaf"), F.unhex("now"))})
    placed = numbered(rows, [F.asc_nulls_first("g"), F.asc_nulls_first("id"), F.asc("leaf")], "place")
    groups = stored(placed.groupBy("g").agg(F.min("place").alias("start")), "groups")
    groups = stored(numbered(groups, [F.asc("start")], "tree"), "trees")
    leaves = stored(placed.join(groups, placed["g"].eqNullSafe(groups["g"])).select(
        "tree", (F.col("place") - F.col("start")).alias("i"), F.col("leaf").alias("h"), "id", "now"), "leaves")
    levels, subroots = forest(leaves.select("tree", "i", "h"), arity, "tree")
    subroots = stored(subroots, "subroots")
    one = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), "h")
    top_levels, top = forest(one, arity, "top")
    no_path = F.array().cast("array<struct<left:binary,right:binary>>")
    up = paths(top_levels, top.select("tree", no_path.alias("path")), arity)
    tops = up.select(F.col("i").alias("tree"), "path")
    down = paths(levels, stored(tops, "tops"), arity)
    path = F.col("path")
    last = top.select(hexed("h").alias("root")).first()
    root = F.lit(None if last is None else last["root"]).cast("string")
    out = leaves.join(down, ["tree", "i"]).join(subroots.withColumnRenamed("h", "subroot"), "tree").select(
        "id", hexed(F.col("h")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        digest(hexed(F.aggregate(path, F.lit(b""), lambda a, s: F.concat(a, s["left"], s["right"])))).alias("proof_sha256"),
        folded(hexed(F.coalesce("now", "h")), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)

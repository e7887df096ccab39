"""Joins, run numbering and quantiles that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from portfolia.session import scratch_dir

#: Rows of one key that a single task is asked to take in a join.
ROWS_PER_SALT = 2_000_000
#: Order units per block when one group is numbered in pieces.
BLOCK = 65_536
#: Ranges of values, or hot keys, that are sent to all rows; more of them are joined.
FEW = 100_000


def row_salt(df: DataFrame, salts: Column) -> Column:
    """A salt that a re-run task gives to the same row again.

    It hashes the row and the input partition, so copies of one row that lie in
    different partitions still spread, and nothing depends on row order.
    """
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in _hashable(df)]), salts)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]


def key_counts(df: DataFrame, *keys: str) -> DataFrame:
    return _with_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
    left_counts: DataFrame | None = None,
    right_unique: bool = False,
) -> DataFrame:
    """Equi-join on ``key`` with hot keys of either side spread over salts.

    Keys with at least ``rows_per_salt`` rows are counted first, with map-side
    partial counts, by a job of their own. There are at most (left rows + right rows) /
    rows_per_salt of them; up to ``FEW`` are broadcast. A hot key's rows on one side get a salt
    and the matching rows of the other side are repeated once per salt, so each
    pair of rows still meets exactly once. ``how`` is ``inner`` or ``left``.

    ``left_counts`` (key columns and ``_n``) saves a pass when the counts are at hand,
    as does ``right_unique`` for a right side with few rows per key.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    keys = [key] if isinstance(key, str) else list(key)

    def hot(counts: DataFrame, name: str) -> DataFrame:
        return counts.where(F.col("_n") >= rows_per_salt).select(
            *keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias(name)
        )

    # One row per hot key: how many salts its left rows and its right rows take. Counted once and written, so that
    # the plan of the result neither counts nor, without hot keys, has a branch for them.
    fans = hot(key_counts(left, *keys) if left_counts is None else left_counts, "_fan_l")
    if not right_unique:
        fans = fans.unionByName(hot(key_counts(right, *keys), "_fan_r"), allowMissingColumns=True)
        fans = fans.groupBy(*keys).agg(F.max("_fan_l").alias("_fan_l"), F.max("_fan_r").alias("_fan_r"))
    else:
        fans = fans.withColumn("_fan_r", F.lit(1))
    path = scratch_dir(left.sparkSession, "hot")
    fans.write.parquet(path)
    fans = left.sparkSession.read.schema(fans.schema).parquet(path)
    n_hot = fans.count()
    if not n_hot:
        return left.join(_with_keys(right, keys), keys, how)
    fans = F.broadcast(fans) if n_hot <= FEW else fans
    hot_keys = fans.select(*keys) if n_hot > FEW else F.broadcast(fans.select(*keys))
    # Rows of ordinary keys, and those without a key, take a plain join that Catalyst prunes and filters through
    # and that adaptive execution may split; only hot keys are salted.
    plain = left.join(hot_keys, keys, "left_anti").join(_with_keys(right, keys), keys, how)
    left, right = (df.join(hot_keys, keys, "left_semi") for df in (left, right))

    def spread(df: DataFrame, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        out = df.withColumn("_row", row_salt(df, F.lit(1 << 30))).join(fans, keys, "left")
        own_n = F.coalesce(F.col(own), F.lit(1))
        return (
            out.withColumn(own_salt, F.pmod(F.col("_row"), own_n).cast("int"))
            .withColumn("_copies", F.coalesce(F.col(other), F.lit(1)))
            .withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
            .drop("_row", "_fan_l", "_fan_r")
        )

    lhs = spread(left, "_fan_l", "_fan_r", "_salt_l", "_salt_r")
    rhs = spread(right, "_fan_r", "_fan_l", "_salt_r", "_salt_l")
    rhs = rhs.drop("_copies").withColumn("_hit", F.lit(True))
    out = lhs.join(rhs, [*keys, "_salt_l", "_salt_r"], how)
    if how == "left":
        # A repeated left row has a hot partner key, so at least one copy matches;
        # the copies whose salt met nothing are not rows of the result.
        out = out.where(F.col("_hit").isNotNull() | (F.col("_copies") == 1))
    return plain.unionByName(out.drop("_salt_l", "_salt_r", "_copies", "_hit"))


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join with a table that has one row per key.

    A plain join: Spark broadcasts the table where its size in bytes allows, and splits hot keys of the big side
    otherwise. Nothing is counted while the plan is built.
    """
    return rows.join(lookup, key, how)


def number_runs(
    df: DataFrame, group: str, order: str, tracks: dict[str, Column], block: int = BLOCK
) -> DataFrame:
    """Number the runs of equal values within each group, in ``order``.

    ``tracks`` maps an output column to a value; rows whose value is NULL are not part
    of that track and get no number. Numbers start at 1.

    A window over the group would put a hot group into one task. Instead the order is
    cut into blocks of ``block`` units; runs are numbered inside a block, and one
    summary row per block carries the offset across blocks. ``order`` is an integer,
    unique within the group.
    """
    inside = Window.partitionBy(group, "_block").orderBy(order)
    across = Window.partitionBy(group).orderBy("_block")
    earlier = (Window.unboundedPreceding, -1)

    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    rows = rows.withColumns({f"_v_{t}": value for t, value in tracks.items()})
    opens = {}
    for t in tracks:
        before = F.last(f"_v_{t}", ignorenulls=True).over(inside.rowsBetween(*earlier))
        new = F.col(f"_v_{t}").isNotNull() & ~before.eqNullSafe(F.col(f"_v_{t}"))
        opens[f"_o_{t}"] = new.cast("long")
    rows = rows.withColumns(opens)
    rows = rows.withColumns(
        {f"_n_{t}": F.sum(f"_o_{t}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for t in tracks}
    )
    aggs = []
    for t in tracks:
        present = F.when(F.col(f"_v_{t}").isNotNull(), F.col(order))
        aggs += [F.min_by(f"_v_{t}", present).alias(f"_first_{t}"),
                 F.max_by(f"_v_{t}", present).alias(f"_last_{t}"),
                 F.max(f"_n_{t}").alias(f"_runs_{t}")]
    blocks = rows.groupBy(group, "_block").agg(*aggs)
    # A block that opens with the value the previous one closed with continues its run.
    blocks = blocks.withColumns({
        f"_joined_{t}": (
            F.col(f"_first_{t}").isNotNull()
            & F.last(f"_last_{t}", ignorenulls=True).over(across.rowsBetween(*earlier))
            .eqNullSafe(F.col(f"_first_{t}"))
        ).cast("long")
        for t in tracks
    })
    offsets = [
        (F.coalesce(F.sum(f"_runs_{t}").over(across.rowsBetween(*earlier)), F.lit(0))
         - F.sum(f"_joined_{t}").over(across.rowsBetween(Window.unboundedPreceding, 0))).alias(f"_offset_{t}")
        for t in tracks
    ]
    offsets = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), *offsets)
    numbered = rows.join(
        offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col("_block").eqNullSafe(F.col("_b")))
    return numbered.select(
        *df.columns,
        *[F.when(F.col(f"_v_{t}").isNotNull(), F.col(f"_offset_{t}") + F.col(f"_n_{t}")).alias(t) for t in tracks],
    )


def exact_quantiles(
    df: DataFrame, group: str, value: str, probs: Sequence[float],
    weight: str | None = None, cuts: int = 64, most: int = 65_536,
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, with bounded state per task.

    ``percentile`` keeps every distinct value of a group in one task. Here values are counted and written once. Every
    wanted rank then has a range of values that holds it: as long as a range holds more than ``most`` of them, a sketch
    cuts it in ``cuts`` parts of about equal size, and the part with the rank is the new range. So a pass reads what is
    left of the ranges, their number is the logarithm of the largest group, and no task orders more than ``most``
    values. The sketch affects the balance alone: any cut gives the same result.

    A row counts ``weight`` times; rows without a group or value count nowhere. Output: group, ``n``, ``prob``,
    ``quantile``.
    """
    spark = df.sparkSession

    def kept(table: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(spark, name)
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    w = F.col(weight) if weight else F.lit(1).cast("long")
    counts = kept(
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
        .agg(F.sum(w).cast("long").alias("_c")).where("_c > 0"), "values")
    whole = counts.groupBy("_g").agg(
        F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = kept(whole, "groups")
    at = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    ranks = whole.withColumn("prob", at).withColumn("_at", F.col("prob") * (F.col("n") - 1))
    held = ranks.select("_g", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"), "_lo", "_hi", "_size",
                        F.lit(0).cast("long").alias("_start")).distinct()
    span = ["_g", "_lo", "_hi"]

    def inside(ranges: DataFrame) -> DataFrame:
        """The values of the ranges; what several ranks share is read once. Few ranges go to the rows."""
        few = ranges.select(*span, "_start").distinct()
        few = F.broadcast(few) if few.limit(FEW + 1).count() <= FEW else few
        return counts.join(few, "_g").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    while True:
        wide = held.where(F.col("_size") > most)
        if wide.isEmpty():
            break
        rows = inside(wide)
        marks = rows.groupBy(*span).agg(
            F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("_marks"))
        binned = rows.join(marks, span).withColumn("_bin", F.size(F.filter("_marks", lambda x: x < F.col("_v"))))
        bins = binned.groupBy(*span, "_start", "_bin").agg(
            F.sum("_c").alias("_in"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = Window.partitionBy(*span).orderBy("_bin")  # at most ``cuts`` rows
        bins = bins.withColumn("_first", F.col("_start") + F.sum("_in").over(upto) - F.col("_in")).drop("_start", "_bin")
        narrow = wide.select(*span, "_rank").join(bins, span).where(
            (F.col("_first") <= F.col("_rank")) & (F.col("_rank") < F.col("_first") + F.col("_in"))).select(
            "_g", "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_n").alias("_size"),
            F.col("_first").alias("_start"))
        held = kept(held.where(F.col("_size") <= most).unionByName(narrow), "ranges")

    order = Window.partitionBy(*span).orderBy("_v")  # at most ``most`` rows
    near = inside(held).withColumn("_last", F.col("_start") + F.sum("_c").over(order) - 1)
    near = near.withColumn("_first", F.col("_last") - F.col("_c") + 1).select(*span, "_v", "_first", "_last")
    found = held.select(*span, "_rank").join(near, span).where(
        F.col("_rank").between(F.col("_first"), F.col("_last"))).select("_g", "_rank", "_v")
    low, high = (found.select("_g", F.col("_rank").alias(r), F.col("_v").alias(v)) for r, v in (("_a", "_x"), ("_b", "_y")))
    both = ranks.select("_g", "n", "prob", "_at", F.floor("_at").alias("_a"), F.ceil("_at").alias("_b")).join(
        low, ["_g", "_a"]).join(high, ["_g", "_b"])
    return both.select(
        F.col("_g").alias(group), "n", "prob",
        (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.col("_a"))).alias("quantile"))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """The rows of ``df`` with their place, from 0, in the order over all rows; they are written to scratch once.

    One sort by ranges; a row per task tells how many rows come before it. Rows that are equal in the order are dealt
    by their place in the input, so many equal rows do not fall to one task, and a repeated task numbers them alike.
    """
    spark, own = df.sparkSession, F.monotonically_increasing_id()
    path = scratch_dir(spark, "numbered")
    df.withColumn("_tie", own).orderBy(*order, "_tie").withColumn(name, own).drop("_tie").write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright(name, 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(tasks), "_task").withColumn(
        name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_task", "_before")

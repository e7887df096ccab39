"""Trends, territories and customer segments: what the plan of the portfolio names beyond its dashboards (2.13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from portfolia.session import scratch_dir

# Trends ----------------------------------------------------------------------------------

MOMENTS = ("n", "sx", "sy", "sxx", "sxy")


def moments(rows: DataFrame, key: str, x: Column, y: Column) -> DataFrame:
    """Sums of least squares per key over whole-numbered x and y: exact, so any order and any split give the same.

    Rows without x or y count nowhere; a key of NULL is a key.
    """
    wide = "decimal(38,0)"
    return rows.select(F.col(key), x.cast(wide).alias("_x"), y.cast(wide).alias("_y")).where(
        "_x IS NOT NULL AND _y IS NOT NULL").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").cast(wide).alias("sx"), F.sum("_y").cast(wide).alias("sy"),
        F.sum(F.col("_x").cast("long") * F.col("_x").cast("long")).cast(wide).alias("sxx"),
        F.sum((F.col("_x").cast("decimal(18,0)") * F.col("_y").cast("decimal(18,0)"))).cast(wide).alias("sxy"))


def merged(key: str, *parts: DataFrame) -> DataFrame:
    """Moments of the rows of all parts together, from the parts' moments alone."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(*[F.sum(m).cast("long" if m == "n" else "decimal(38,0)").alias(m) for m in MOMENTS])


def fitted(sums: DataFrame) -> DataFrame:
    """Slope and intercept per key; NULL where all x are equal."""
    n, sx, sy, sxx, sxy = (F.col(m).cast("double") for m in MOMENTS)
    # Around the mean of x the sums are small, so doubles hold them.
    spread, common = sxx - sx * sx / n, sxy - sx * sy / n
    slope = F.when(spread > 0, common / spread)
    return sums.withColumns({"slope": slope, "intercept": (sy - slope * sx) / n})


def risk_trajectory(policies: DataFrame, claims: DataFrame, origin: str = "2000-01-01") -> DataFrame:
    """How claim amounts of each broker's customers change over time: claims, slope per day and intercept at ``origin``.

    Claims are summed per policy number first, so a hot number or broker is a few rows per task; a claim counts once
    for every policy of its number, as in the portfolio.
    """
    day = F.date_diff("incident_date", F.lit(origin).cast("date"))
    per_policy = moments(claims.where("policy_number IS NOT NULL"), "policy_number", day, F.col("claim_amount"))
    copies = policies.where("broker_id IS NOT NULL").groupBy("policy_number", "broker_id").agg(F.count(F.lit(1)).alias("_m"))
    weighed = copies.join(per_policy, "policy_number").select(
        "broker_id", *[(F.col(m) * F.col("_m")).cast("long" if m == "n" else "decimal(38,0)").alias(m) for m in MOMENTS])
    return fitted(merged("broker_id", weighed)).select("broker_id", F.col("n").alias("n_claims"), "slope", "intercept")


# Territories -----------------------------------------------------------------------------


def broker_premiums(policies: DataFrame) -> DataFrame:
    """Policies and premium per broker, those without one included."""
    return policies.groupBy("broker_id").agg(
        F.count(F.lit(1)).alias("n_policies"),
        F.coalesce(F.sum(F.col("policy_annual_premium").cast("decimal(38,2)")), F.lit(0)).cast("decimal(38,2)").alias("premium"))


def _shares(policies: DataFrame, brokers: DataFrame) -> DataFrame:
    """One row per broker in use and territory, with the territory's share; none is dropped.

    A broker's premium is divided by its different territories in cents; what does not divide goes to the first ones.
    Policies without a broker, of an unknown broker or of one without a territory belong to territory NULL.
    """
    own = brokers.select("broker_id", "active", F.array_sort(F.array_distinct(F.array_compact("territory"))).alias("_t"))
    rows = broker_premiums(policies).join(own, "broker_id", "left")
    at = F.when(F.size("_t") > 0, F.col("_t")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.withColumn("_k", F.size(at)).select("*", F.posexplode(at).alias("_i", "territory"))
    cents = (F.col("premium") * 100).cast("decimal(38,0)")
    share = F.floor(cents / F.col("_k")).cast("decimal(38,0)")
    more = (F.col("_i") < cents - share * F.col("_k")).cast("int")
    return rows.withColumn("share", ((share + more) / 100).cast("decimal(38,2)"))


def territory_premium(policies: DataFrame, brokers: DataFrame) -> DataFrame:
    """Premium, brokers and policies per territory; the premiums add up to that of all policies."""
    return _shares(policies, brokers).groupBy("territory").agg(
        F.sum("share").cast("decimal(38,2)").alias("premium"), F.countDistinct("broker_id").alias("n_brokers"),
        F.sum("n_policies").alias("n_policies"))


def territory_gaps(policies: DataFrame, brokers: DataFrame) -> DataFrame:
    """Territories that no active broker with a policy covers, with the brokers that name them and their premium."""
    named = brokers.select("broker_id", "active", F.explode(F.array_distinct("territory")).alias("territory")).where(
        "territory IS NOT NULL")
    shares = _shares(policies, brokers).where("territory IS NOT NULL").select("broker_id", "territory", "share", "active")
    covered = shares.where("active").select("territory").distinct()
    return named.join(covered, "territory", "left_anti").join(
        shares.select("broker_id", "territory", "share"), ["broker_id", "territory"], "left").groupBy("territory").agg(
        F.count(F.lit(1)).alias("n_brokers"), F.coalesce(F.sum("share"), F.lit(0)).cast("decimal(38,2)").alias("premium"))


# Segments --------------------------------------------------------------------------------

#: Steps between the least and the greatest value of a feature; whole numbers make sums independent of their order.
SCALE = 1_000_000


def scaled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as whole numbers from 0 (least) to ``SCALE`` (greatest), in an array ``_f``; NULL stands in the middle."""
    ends = rows.agg(*[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(features)
                      for p, f in (("a", F.min), ("b", F.max))]).first()
    out = []
    for i, c in enumerate(features):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        step = F.round((F.col(c).cast("double") - low) / (high - low) * SCALE) if low is not None and high > low else F.lit(0)
        out.append(F.coalesce(step.cast("long"), F.lit(SCALE // 2).cast("long")))
    return rows.withColumn("_f", F.array(*out))


def _ranked(centres: Sequence[Sequence[int]]) -> Column:
    """Squared distance to the nearest centre times the number of centres, plus its number (the first of equally near ones).

    Whole numbers, so exact: distances are at most ``SCALE`` squared per feature. One number per centre keeps the
    generated code small enough for the JVM to compile.
    """
    squares = [sum((F.get("_f", F.lit(i)) - F.lit(int(c))) * (F.get("_f", F.lit(i)) - F.lit(int(c))) for i, c in enumerate(centre))
               for centre in centres]
    packed = [(d * F.lit(len(centres)) + F.lit(j)).cast("long") for j, d in enumerate(squares)]
    return F.least(*packed) if len(packed) > 1 else packed[0]


def _nearest(centres: Sequence[Sequence[int]]) -> Column:
    """The number of the nearest centre; centres are constants of the expression."""
    return F.pmod(_ranked(centres), F.lit(len(centres)))


def segment_customers(rows: DataFrame, key: str, features: Sequence[str], k: int = 5, seed: int = 1,
                      rounds: int = 20) -> DataFrame:
    """Key and ``segment`` (0 to k - 1) of every row, by k-means over scaled features.

    Rows of equal features are one weighted point; the points are written to scratch once, and all passes read them
    there, however the rows came in. Centres are begun as in k-means++: the next one is drawn in
    proportion to the squared distance from those there are, as the least of -ln(u) / (weight x distance) over all
    points with u from a hash of point and seed, which is one aggregate over the points. Every round is one aggregate
    as well, of whole numbers, so the segments are the same for any partitioning; k centres are all the driver gets.
    Fewer different points than k give fewer segments; no rows give none.
    """
    table = scaled(rows.select(key, *features), features)
    points = table.groupBy("_f").agg(F.count(F.lit(1)).alias("_w"))
    path = scratch_dir(rows.sparkSession, "points")
    points.write.parquet(path)
    points = rows.sparkSession.read.schema(points.schema).parquet(path)
    centres: list[list[int]] = []
    while len(centres) < k:
        u = (F.pmod(F.xxhash64("_f", F.lit(seed), F.lit(len(centres))), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        far = ((_ranked(centres) - _nearest(centres)) / F.lit(len(centres))) if centres else F.lit(1.0)
        race = -F.log(u) / (F.col("_w") * far)
        first = points.where(far > 0).agg(F.min(F.struct(race.alias("r"), F.col("_f").alias("f"))).alias("m")).first()["m"]
        if first is None:
            break
        centres.append(list(first["f"]))
    if not centres:
        return table.select(key, F.lit(None).cast("int").alias("segment"))
    for _ in range(rounds):
        sums = points.groupBy(_nearest(centres).alias("j")).agg(
            F.sum("_w").alias("w"), *[F.sum(F.get("_f", F.lit(i)) * F.col("_w")).alias(f"s{i}") for i in range(len(features))])
        moved = list(centres)
        for r in sums.collect():
            moved[r["j"]] = [(2 * r[f"s{i}"] + r["w"]) // (2 * r["w"]) for i in range(len(features))]
        if moved == centres:
            break
        centres = moved
    return table.select(key, _nearest(centres).cast("int").alias("segment"))

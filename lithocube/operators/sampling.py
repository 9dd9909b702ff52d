"""Sampling with exact quotas per ring and well, and training chunks; all choices by hash, none by sorting everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithocube.functions.scalars import beta_density
from lithocube.plans.config import Sampling
from lithocube.session import small


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48


def ring_quotas(points: DataFrame, max_points: int) -> DataFrame:
    """ring, n, quota: each ring's part of `max_points`, rounded up; all points if they are no more than that or
    `max_points` is not above 0."""
    counts = points.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per ring
    sample = (F.lit(max_points) > 0) & (total > max_points)
    return counts.select("ring", "n", F.when(sample, F.ceil(F.col("n") / total * max_points)).otherwise(F.col("n")).alias("quota"))


def well_quotas(points: DataFrame, max_points: int) -> DataFrame:
    """ring, well_id, n, quota: a ring's quota shared among its wells in proportion, at least 1 each.

    Shares are rounded up; what is then too many is taken off the largest ones, one point at a time and of equal ones
    from the lower well id, which comes to the same as cutting every share at one level.
    """
    quotas = ring_quotas(points, max_points).select("ring", F.col("n").alias("ring_n"), F.col("quota").alias("ring_quota"))
    wells = points.groupBy("ring", "well_id").agg(F.count(F.lit(1)).alias("n")).join(small(quotas), "ring")
    w = Window.partitionBy("ring")
    wells = wells.withColumn("share", F.ceil(F.col("n") / F.col("ring_n") * F.col("ring_quota")))
    wells = wells.withColumn("extra", F.sum("share").over(w) - F.col("ring_quota"))
    # Ceil adds less than one per well, so no share loses more than the wells ahead of it in size demand.
    order = Window.partitionBy("ring").orderBy(F.desc("share"), "well_id")
    wells = wells.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("share").over(order))
    # Cutting the k largest to one level c takes upto - k * c; the level is that of the smallest k that suffices.
    after = F.coalesce(F.lead("share").over(order), F.lit(1))
    wells = wells.withColumn("room", F.col("upto") - F.col("place") * after)
    k = F.min(F.when(F.col("room") >= F.col("extra"), F.col("place"))).over(w)
    wells = wells.withColumn("k", F.coalesce(k, F.count(F.lit(1)).over(w)))
    left = F.max(F.when(F.col("place") == F.col("k"), F.col("upto") - F.col("extra"))).over(w)
    wells = wells.withColumn("left", left)
    level = F.floor(F.col("left") / F.col("k"))
    more = F.col("left") - level * F.col("k")
    # Of those cut, the ones with the largest ids keep the odd points.
    late = F.row_number().over(Window.partitionBy("ring", F.col("place") <= F.col("k")).orderBy(F.desc("well_id")))
    wells = wells.withColumn("late", late)
    cut = F.when(F.col("place") <= F.col("k"), F.least(F.col("share"), level + F.when(F.col("late") <= more, 1).otherwise(0))).otherwise(F.col("share"))
    return wells.select("ring", "well_id", "n", F.greatest(F.lit(1), F.when(F.col("extra") > 0, cut).otherwise(F.col("share"))).alias("quota"))


def sample_points(points: DataFrame, max_points: int, seed: int = 42, key: tuple[str, ...] = ("x", "y", "z"), alpha: float = 1.0, beta: float = 1.0, by_ring: bool = False) -> DataFrame:
    """At most the quota of each ring and well, chosen without replacement.

    The choice is by a hash key (Efraimidis-Spirakis: log of a uniform number by weight). Weights are 1, or with
    `by_ring` the beta density of a point's ring scaled to the rings there are, so earlier rings can count less.
    """
    q = well_quotas(points, max_points).select("ring", "well_id", "quota")
    p = points.join(small(q), ["ring", "well_id"])
    order: Column = uniform(seed, *key)
    if by_ring:
        most = points.agg(F.max("ring").alias("_most"))
        p = p.join(F.broadcast(most))  # one row
        weight = F.greatest(F.lit(1e-12), beta_density((F.col("ring") + 0.5) / (F.col("_most") + 1), alpha, beta))
        p = p.withColumn("_key", -F.log(uniform(seed, *key)) / weight).drop("_most")
        order = F.col("_key")
    w = Window.partitionBy("ring", "well_id").orderBy(order, *key)
    return p.withColumn("_rn", F.row_number().over(w)).where("_rn <= quota").drop("_rn", "quota", "_key")


def sampled(points: DataFrame, s: Sampling) -> DataFrame:
    """`points`, or a sample of them if the settings' max_points is above 0."""
    if s.max_points <= 0:
        return points
    return sample_points(points, s.max_points, s.seed, alpha=s.alpha, beta=s.beta, by_ring=(s.alpha, s.beta) != (1.0, 1.0))


def last_rings(points: DataFrame, it: int, layers: int) -> DataFrame:
    """Points of the last `layers` rings before iteration `it`; of all rings before it if `layers` is not above 0."""
    low = max(it - layers, 0) if layers > 0 else 0
    return points.where((F.col("ring") >= low) & (F.col("ring") < max(it, 1)))


def chunks(points: DataFrame, n: int, order: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """`points` with `chunk` 0 to n - 1: every ring and well is cut into n slices of equal size, rounded up."""
    w = Window.partitionBy("ring", "well_id")
    at = F.row_number().over(w.orderBy(*order)) - 1
    return points.withColumn("chunk", F.floor(at / F.ceil(F.count(F.lit(1)).over(w) / n)).cast("int"))


def sequential_chunks(points: DataFrame, n: int, order: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """`points` with `chunk` 0 to n - 1: rings and wells one after the other, cut into n pieces of equal size.

    Positions are counted per ring and well and shifted by the sums of those before, so nothing is sorted as a whole.
    """
    sizes = points.groupBy("ring", "well_id").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("ring", "well_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    sizes = sizes.select("ring", "well_id", before.alias("_before"), total.alias("_total"))
    at = F.row_number().over(Window.partitionBy("ring", "well_id").orderBy(*order)) - 1
    p = points.withColumn("_at", at).join(small(sizes), ["ring", "well_id"])
    return p.withColumn("chunk", F.floor((F.col("_before") + F.col("_at")) / F.ceil(F.col("_total") / n)).cast("int")).drop("_at", "_before", "_total")


def tile_quotas(points: DataFrame, max_points: int, tile: int = 100) -> DataFrame:
    """tx, ty, n, quota: each tile's part of `max_points`, rounded up; all its points if no sampling is needed."""
    counts = points.groupBy(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per tile
    sample = (F.lit(max_points) > 0) & (total > max_points)
    return counts.select("tx", "ty", "n", F.when(sample, F.ceil(F.col("n") / total * max_points)).otherwise(F.col("n")).alias("quota"))

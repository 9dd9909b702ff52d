"""Splitting long ordered series into bounded segments, and order statistics of them, so that no series has to fit into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithocube.session import cut, small


def ranked(df: DataFrame, key: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """`df` with the exact place, from 0, of every row in the order of its `key`. Key and order columns hold no nulls.

    Rows are range partitioned by key and order together, so many rows at one place are spread as well if the last of
    `order` tells them apart; places within a partition are shifted by the counts of the partitions before.
    """
    by = [key, *order]
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33)
    counts = rows.groupBy(F.col(key).alias("_key"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    w = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_key", "_part", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = rows.join(small(cut(shift)), (F.col(key) == F.col("_key")) & (part == F.col("_part")))
    return rows.select(*df.columns, (F.col("_i") + F.col("_shift")).alias(name))


def segmented(df: DataFrame, size: int, halo: int, rank: str = "rank") -> DataFrame:
    """Add `seg` and `core`: rows whose places are `rank` are cut into segments of `size` places.

    A segment gets the `halo` rows next to it on both sides as copies with `core` false, from as many segments as it
    takes, so a neighbourhood of up to `halo` rows is whole in the segment that owns its centre.
    """
    at = lambda by: F.floor((F.col(rank) + by) / size)
    to = F.sequence(F.greatest(F.lit(0), at(-halo)), at(halo))
    return df.withColumn("seg", F.explode(to)).withColumn("core", F.col("seg") == at(0))


def nth(df: DataFrame, key: str, value: str, places: DataFrame) -> DataFrame:
    """`key`, n and the exact n-th smallest `value` for every row (`key`, n from 0) of `places`; values are longs not below 0.

    Four histograms of 16 bits, each within the bin that the last one led to, end at the value itself: nothing is
    sorted and no series is in one task. Doubles not below 0 are in the order of their bits.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_b"))
    found = places.select(F.col(key).alias("_key"), "n", F.col("n").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for shift in (48, 32, 16, 0):
        found = cut(found)
        above = F.shiftright("_b", shift + 16) if shift < 48 else F.lit(0).cast("long")
        digit = F.shiftright("_b", shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        within = rows.join(small(found), (F.col("_k") == F.col("_key")) & (above == F.col("_prefix")))
        bins = within.groupBy("_key", "n", "_left", "_prefix", digit.alias("_d")).agg(F.count(F.lit(1)).alias("_m"))
        bins = bins.withColumn("_upto", F.sum("_m").over(Window.partitionBy("_key", "n").orderBy("_d")))
        bins = bins.where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_m") <= F.col("_left")))
        found = bins.select("_key", "n", (F.col("_left") - F.col("_upto") + F.col("_m")).alias("_left"), (F.col("_prefix") * 65536 + F.col("_d")).alias("_prefix"))
    return found.select(F.col("_key").alias(key), "n", F.col("_prefix").alias(value))

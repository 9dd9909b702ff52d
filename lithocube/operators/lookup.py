"""Features at displaced points: one equi-join on traces per feature, then indexing into the trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.operators.cube import clamped


def displacements(spark: SparkSession, window: int, only_z: bool = False) -> DataFrame:
    """dx, dy, dz of the cube of side 2 * window + 1 around a point, or of its vertical line only."""
    if window < 0:
        raise ValueError("window must be 0 or more")
    side = F.sequence(F.lit(-window), F.lit(window))
    one = F.array(F.lit(0)) if only_z else side
    d = spark.range(1).select(F.explode(one).alias("dx")).withColumn("dy", F.explode(one)).withColumn("dz", F.explode(side))
    return d.select(*[F.col(c).cast("int").alias(c) for c in ("dx", "dy", "dz")])


def candidates(features: DataFrame, window: int, only_z: bool = False, first_features: int | None = None, first: int | None = None) -> DataFrame:
    """feature, dx, dy, dz of every candidate; the first so many features by name, the first so many candidates in
    order of name and displacement. The lists are those of a catalogue, never data."""
    f = features.select("feature").distinct()
    if first_features is not None:
        f = f.orderBy("feature").limit(first_features)
    side = F.sequence(F.lit(-window), F.lit(window))
    one = F.array(F.lit(0)) if only_z else side
    c = f.withColumn("dx", F.explode(one)).withColumn("dy", F.explode(one)).withColumn("dz", F.explode(side))
    if first is not None:
        c = c.orderBy("feature", "dx", "dy", "dz").limit(first)
    return c


def displaced(points: DataFrame, traces: DataFrame, dx: int, dy: int, dz: int, shape: tuple[int, int, int], name: str = "f0") -> DataFrame:
    """`points` with the feature's value at (x + dx, y + dy, z + dz); beyond the border the nearest sample's."""
    nx, ny, nz = shape
    t = traces.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("amp").alias("_amp"))
    at = (clamped(F.col("x") + dx, nx) == F.col("_x")) & (clamped(F.col("y") + dy, ny) == F.col("_y"))
    value = F.get("_amp", clamped(F.col("z") + dz, nz).cast("int"))
    return points.join(t, at, "left").withColumn(name, value).drop("_x", "_y", "_amp")


def with_features(points: DataFrame, traces: DataFrame, chosen: Sequence[tuple[str, tuple[int, int, int]]], shape: tuple[int, int, int]) -> DataFrame:
    """`points` with columns f0, f1, ... of the chosen (feature, displacement) list. Each feature's partition is read
    once for all its displacements on one (dx, dy)."""
    out = points
    groups: dict[tuple[str, int, int], list[tuple[int, int]]] = {}
    for i, (feature, (dx, dy, dz)) in enumerate(chosen):
        groups.setdefault((feature, dx, dy), []).append((i, dz))
    nx, ny, nz = shape
    for (feature, dx, dy), wanted in groups.items():
        t = traces.where(F.col("feature") == feature).select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("amp").alias("_amp"))
        at = (clamped(F.col("x") + dx, nx) == F.col("_x")) & (clamped(F.col("y") + dy, ny) == F.col("_y"))
        out = out.join(t, at, "left")
        out = out.withColumns({f"f{i}": F.get("_amp", clamped(F.col("z") + dz, nz).cast("int")) for i, dz in wanted}).drop("_x", "_y", "_amp")
    return out


def minicube(points: DataFrame, traces: DataFrame, window: int, shape: tuple[int, int, int], key: Sequence[str] = ("x", "y", "z"), by: Sequence[str] = ()) -> DataFrame:
    """`key`, `by` (columns of the traces, such as the feature) and `values`: all (2 * window + 1)^3 samples around each point in order of dx, dy, dz.

    Points are spread over the (dx, dy) they look at and meet the traces in one equi-join; vertical neighbours are a
    slice of the trace.
    """
    nx, ny, nz = shape
    side = F.sequence(F.lit(-window), F.lit(window))
    p = points.select(*key).withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
    p = p.withColumn("_x", clamped(F.col("x") + F.col("dx"), nx)).withColumn("_y", clamped(F.col("y") + F.col("dy"), ny))
    t = traces.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "amp", *by)
    line = F.transform(side, lambda dz: F.get("amp", clamped(F.col("z") + dz, nz).cast("int")))
    got = p.join(t, ["_x", "_y"]).select(*key, *by, F.struct("dx", "dy", line.alias("v")).alias("s"))
    lines = got.groupBy(*key, *by).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lines.select(*key, *by, F.flatten(F.transform("s", lambda s: s["v"])).alias("values"))


def candidate_index(dx: Column | int, dy: Column | int, dz: Column | int, window: int) -> Column:
    """Place of a displacement in `values` of minicube, from 1."""
    n = 2 * window + 1
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return ((lit(dx) + window) * n + (lit(dy) + window)) * n + lit(dz) + window + 1

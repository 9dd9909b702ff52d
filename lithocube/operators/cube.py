"""Building, reporting and changing the porosity cube. Each ring is written once, as a partition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.operators.geometry import Box, Well, assign_rings
from lithocube.schema import State

COLUMNS = ["x", "y", "z", "phi", "real", "ring", "well_id"]


def empty_cube(spark: SparkSession, box: Box) -> DataFrame:
    """All points of the box, with nothing known of them."""
    i = F.col("id")
    x, y, z = F.floor(i / (box.ny * box.nz)), F.pmod(F.floor(i / box.nz), F.lit(box.ny)), F.pmod(i, F.lit(box.nz))
    return spark.range(box.nx * box.ny * box.nz).select(
        *[c.cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))],
        F.lit(0.0).alias("phi"), F.lit(int(State.EMPTY)).alias("real"), F.lit(-1).alias("ring"), F.lit(-1).alias("well_id"),
    )


def overlay(cube: DataFrame, logs: DataFrame, others: int | None = None, other_ring: int = -1) -> DataFrame:
    """The cube with the logs' points (x, y, z, phi, well_id) as real points of ring 0.

    Logs without a value are left out. Logged points with a null well_id get state `others` (canal points: known truth
    beside the wells) and ring `other_ring`; without `others` they are left out.
    """
    known = logs.where(F.col("phi").isNotNull() & ~F.isnan("phi"))
    if others is None:
        known = known.where("well_id is not null")
    known = known.groupBy("x", "y", "z").agg(F.min("well_id").alias("_w"), F.min_by("phi", F.coalesce("well_id", F.lit(2**31 - 1))).alias("_phi"))
    own, there = F.col("_w").isNotNull(), F.col("_phi").isNotNull()
    return cube.join(known, ["x", "y", "z"], "left").select(
        "x", "y", "z",
        F.when(there, F.col("_phi")).otherwise(F.col("phi")).alias("phi"),
        F.when(own, int(State.REAL)).when(there, int(State.CANAL if others is None else others)).otherwise(F.col("real")).alias("real"),
        F.when(own, 0).when(there, other_ring).otherwise(F.col("ring")).alias("ring"),
        F.when(own, F.col("_w")).when(there, -1).otherwise(F.col("well_id")).cast("int").alias("well_id"),
    )


def update_where(cube: DataFrame, condition: Column, **values: Column | float | int) -> DataFrame:
    """The cube with columns set where `condition` holds; the condition is that of the row before any change."""
    c = cube.withColumn("_hit", F.coalesce(condition, F.lit(False)))
    for name, v in values.items():
        c = c.withColumn(name, F.when(F.col("_hit"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(name)).cast(cube.schema[name].dataType))
    return c.drop("_hit")


def clear_after(cube: DataFrame, ring: int) -> DataFrame:
    """Points of rings above `ring` as nothing known."""
    return update_where(cube, F.col("ring") > ring, phi=0.0, real=int(State.EMPTY), ring=-1, well_id=-1)


def zero_wells(cube: DataFrame, coords: Sequence[tuple[int, int]]) -> DataFrame:
    """Columns at these coordinates as nothing known."""
    hit = F.lit(False)
    for x, y in coords:
        hit = hit | ((F.col("x") == x) & (F.col("y") == y))
    return update_where(cube, hit, phi=0.0, real=int(State.EMPTY), ring=-1, well_id=-1)


def fill_rings(cube: DataFrame, wells: Sequence[Well], upto: int, seed: int = 3) -> DataFrame:
    """Empty points of rings 1 to `upto` as propagated, with one made-up value per ring and well (for trials)."""
    got = assign_rings(cube.select("x", "y").distinct(), wells, 1).select("x", "y", F.col("ring").alias("_r"), F.col("well_id").alias("_w"))
    value = F.pmod(F.xxhash64("_r", "_w", F.lit(seed)), F.lit(20_000)) / 1000.0
    c = cube.join(got, ["x", "y"], "left")
    hit = (F.col("real") == int(State.EMPTY)) & (F.col("_r") <= upto)
    return update_where(c, hit, phi=value, real=int(State.PROPAGATED), ring=F.col("_r"), well_id=F.col("_w")).select(*COLUMNS)


def tile(cube: DataFrame, box: Box, times: tuple[int, int, int], wells: int = 0) -> DataFrame:
    """The cube repeated along its axes; the wells of a copy get ids of their own, other points lose theirs."""
    mx, my, mz = times
    copies = F.explode(F.sequence(F.lit(0), F.lit(mx * my * mz - 1)))
    k = F.col("_k")
    c = cube.withColumn("_k", copies)
    real = F.col("real") == int(State.REAL)
    shift = (F.floor(k / (my * mz)), F.pmod(F.floor(k / mz), F.lit(my)), F.pmod(k, F.lit(mz)))
    return c.select(
        *[(F.col(n) + s * size).cast("int").alias(n) for n, s, size in (("x", shift[0], box.nx), ("y", shift[1], box.ny), ("z", shift[2], box.nz))],
        "phi", "real", "ring", F.when(real, F.col("well_id") + k * wells).otherwise(-1).cast("int").alias("well_id"),
    )


def clamped(c: Column, n: int) -> Column:
    """An index outside the cube as the nearest inside: the halo of a feature cube repeats its border."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))


def summary(cube: DataFrame, total: int | None = None) -> DataFrame:
    """kind ('state', 'ring', 'well', 'all'), key, points, share: the cube's report in one pass over its rows."""
    g = cube.groupingSets([["real"], ["ring"], ["well_id"], []], "real", "ring", "well_id").agg(
        F.count(F.lit(1)).alias("points"), F.grouping_id().alias("g")
    )
    whole = F.lit(total) if total else F.max(F.when(F.col("g") == 7, F.col("points"))).over(_everything())
    kind = F.when(F.col("g") == 3, "state").when(F.col("g") == 5, "ring").when(F.col("g") == 6, "well").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("real", "ring", "well_id").alias("key"), "points", (F.col("points") / whole).alias("share"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()


def write_ring(points: DataFrame, path: str) -> None:
    """Write points into their rings' partitions; writing a ring again replaces it, so a repeated iteration is harmless."""
    points.select(*[c for c in COLUMNS if c != "ring"], "ring").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ring").parquet(path)


def known_before(spark: SparkSession, path: str, it: int, layers: int = -1) -> DataFrame:
    """Points of the rings before `it` (of the last `layers` rings only, if that is above 0): other partitions are not read."""
    c = spark.read.parquet(path)
    low = it - layers if layers > 0 else 0
    return c.where((F.col("ring") >= low) & (F.col("ring") < max(it, 1)))


def with_halo(traces: DataFrame, box: Box, window: int) -> DataFrame:
    """The traces with a border of `window` cells that repeats the nearest samples, for readers that store halos.

    Coordinates are shifted by `window`. The engine itself never stores a halo: it clamps indices when it looks up.
    """
    side = F.sequence(F.lit(-window), F.lit(window))
    copy = lambda c, n: F.filter(F.transform(side, lambda d: F.col(c) + d), lambda v: (v == F.col(c)) | ((F.col(c) == 0) & (v < 0)) | ((F.col(c) == n - 1) & (v >= n)))
    t = traces.withColumn("_x", F.explode(copy("x", box.nx))).withColumn("_y", F.explode(copy("y", box.ny)))
    first, last = F.array_repeat(F.element_at("amp", 1), window), F.array_repeat(F.element_at("amp", -1), window)
    return t.select((F.col("_x") + window).alias("x"), (F.col("_y") + window).alias("y"), F.concat(first, "amp", last).alias("amp"))


def random_wells(spark: SparkSession, box: Box, n: int, seed: int = 1, first_id: int = 0) -> DataFrame:
    """x, y, z, phi, well_id of `n` made-up wells at different places, with made-up porosities, for trials of size.

    Places are a walk through all columns by a step prime to their number, so none is met twice and none is remembered.
    """
    columns = box.nx * box.ny
    if n > columns:
        raise ValueError("more wells than columns")
    step = next(s for s in range(int(columns * 0.618) + 1, 2 * columns + 3) if math.gcd(s, columns) == 1)
    at = F.pmod(F.col("id") * step + seed, F.lit(columns))
    w = spark.range(n).select((F.col("id") + first_id).cast("int").alias("well_id"), F.floor(at / box.ny).cast("int").alias("x"), F.pmod(at, F.lit(box.ny)).cast("int").alias("y"))
    w = w.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(box.nz - 1))))
    phi = F.pmod(F.xxhash64("well_id", "z", F.lit(seed)), F.lit(30_000)) / 1000.0
    return w.select("x", "y", "z", phi.alias("phi"), "well_id")


def scratch_sets(cube: DataFrame, test_wells: Sequence[int], share: float = 1.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the known points: those of `test_wells` test, of the others a share chosen by hash trains."""
    known = cube.where(F.col("real").isin(int(State.REAL), int(State.PROPAGATED)))
    u = F.pmod(F.xxhash64("x", "y", "z", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    own = F.col("well_id").isin(*test_wells) if test_wells else F.lit(False)
    return known.where(~own & (u < share)), known.where(own & (F.col("real") == int(State.REAL)))

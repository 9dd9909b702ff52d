"""Well-log preparation: filters, rolling and per-metre means, one resolution for all wells, joins with areas and traces."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithocube.functions.scalars import depth_index
from lithocube.operators.segments import ranked, segmented
from lithocube.session import cut, small


def no_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN as null in `columns` (all floating ones if none are named): Spark's means skip nulls, not NaN."""
    names = columns or [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def between_depths(log: DataFrame, low: float, high: float, depth: str = "depth") -> DataFrame:
    return log.where(F.col(depth).between(low, high))


def every_nth_depth(log: DataFrame, n: float, depth: str = "depth") -> DataFrame:
    """Readings whose depth is a multiple of `n`."""
    return log.where(F.pmod(F.col(depth), F.lit(n)) == 0)


def after_start(log: DataFrame, starts: DataFrame | None, key: str, time: str, default: float) -> DataFrame:
    """Readings at or after the start time of their well (`starts`: key, start), or `default` where it has none."""
    if starts is None:
        return log.where(F.col(time) >= default)
    s = starts.groupBy(F.col(key).alias("_k")).agg(F.min("start").alias("_start"))
    joined = log.join(small(s), F.col(key) == F.col("_k"), "left")
    return joined.where(F.col(time) >= F.coalesce("_start", F.lit(default))).drop("_k", "_start")


#: A series of more readings is averaged in stretches of so many, each with its neighbours: the means are the same.
STRETCH = 50_000


def rolling_mean(log: DataFrame, keys: Sequence[str], order: Sequence[str], window: int, values: Sequence[str], stretch: int = STRETCH) -> DataFrame:
    """Values replaced by the mean of the centred window of `window` readings of their series; fewer at its ends.

    Series of more than `stretch` readings are cut by exact place into stretches that see the `window` readings next to
    them, so no series has to lie in one task. `order` should tell all readings of a series apart.
    """
    back = window // 2
    frame = (-back, window - 1 - back)
    over = lambda d, w: d.withColumns({v: F.avg(v).over(w.rowsBetween(*frame)) for v in values})
    plain = Window.partitionBy(*keys).orderBy(*order)
    names = [f"_k{i}" for i in range(len(keys))]
    long = log.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > stretch)
    long = cut(long.select(*names, F.row_number().over(Window.orderBy(*names)).alias("_s")))
    if long.isEmpty():
        return over(log, plain)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    short = over(log.join(small(long), same, "left_anti"), plain)
    rows = segmented(ranked(log.join(small(long), same).drop(*names), "_s", order, "_rank"), stretch, window, "_rank")
    rows = over(rows.repartition("_s", "seg"), Window.partitionBy("_s", "seg").orderBy("_rank"))
    return short.unionByName(rows.where("core").select(*log.columns))


def mean_every(log: DataFrame, keys: Sequence[str], n: Column | float, values: Sequence[str], depth: str = "depth") -> DataFrame:
    """Mean depth and values of each stretch of `n` metres of a series."""
    step = F.floor(F.col(depth) / n).alias("step")
    return log.where(F.col(depth).isNotNull()).groupBy(*keys, step).agg(F.avg(depth).alias(depth), *[F.avg(v).alias(v) for v in values])


def mean_by_whole_depth(log: DataFrame, keys: Sequence[str], values: Sequence[str], depth: str = "depth") -> DataFrame:
    """Means by depth cut to whole units."""
    whole = F.col(depth).cast("long").alias("whole_depth")
    return log.where(F.col(depth).isNotNull()).groupBy(*keys, whole).agg(*[F.avg(v).alias(v) for v in values])


def interpolated(log: DataFrame, keys: Sequence[str], targets: DataFrame, values: Sequence[str], depth: str = "depth") -> DataFrame:
    """Values of every series at the depths of `targets` (one column, `depth`): straight lines between readings, the
    end values beyond them.

    Equi-joins only: readings and targets of a series lie in one window, each target takes the readings next to it.
    Readings with a null depth or value take no part; several of one depth count as their mean.
    """
    names = list(keys)
    r = log.where(F.col(depth).isNotNull()).groupBy(*names, F.col(depth).alias("at")).agg(*[F.avg(v).alias(v) for v in values])
    few = targets.select(F.col(depth).alias("_t")).distinct()
    ask = log.select(*names).distinct().join(F.broadcast(few) if _few(few) else few)
    both = r.select(*names, "at", *values, F.lit(0).alias("ask")).unionByName(ask.select(*names, F.col("_t").alias("at"), F.lit(1).alias("ask")), allowMissingColumns=True)
    # Both frames grow from one side: a frame that shrinks is worked out anew for every row.
    up = Window.partitionBy(*names).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*names).orderBy(F.desc("at"), "ask").rowsBetween(Window.unboundedPreceding, 0)
    known = {v: F.when((F.col("ask") == 0) & F.col(v).isNotNull(), F.struct("at", F.col(v).alias("v"))) for v in values}
    both = both.withColumns({f"lo_{v}": F.last(known[v], True).over(up) for v in values})
    both = both.withColumns({f"hi_{v}": F.last(known[v], True).over(down) for v in values})

    def value(v: str) -> Column:
        lo, hi = (F.col(f"{s}_{v}") for s in ("lo", "hi"))
        slope = F.try_divide(hi["v"] - lo["v"], hi["at"] - lo["at"])
        return F.coalesce(lo["v"] + (F.col("at") - lo["at"]) * slope, lo["v"], hi["v"])

    return both.where("ask = 1").select(*names, F.col("at").alias(depth), *[value(v).alias(v) for v in values])


def _few(df: DataFrame, rows: int = 20_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def densest(log: DataFrame, key: str) -> DataFrame:
    """The series with most readings (of equals, the smallest key)."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(1)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def ranges(log: DataFrame, key: str, *columns: str) -> DataFrame:
    """Least and greatest of columns per series, nulls and NaN aside."""
    l = no_nan(log, *columns)
    return l.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def wells_in_areas(wells: DataFrame, areas: DataFrame, x: str = "x_coord", y: str = "y_coord") -> DataFrame:
    """Every well with every area that holds it, rims included."""
    w, a = wells.select("well_id", x, y), areas.select("area", "min_x", "max_x", "min_y", "max_y")
    found = _in_rectangles(w, a, x, y)
    return found.select("well_id", "area", (F.col(x) - F.col("min_x")).alias("area_x"), (F.col(y) - F.col("min_y")).alias("area_y"))


#: Side of the grid cells over which more rectangles than can be broadcast meet their points.
CELL = 1024


def _in_rectangles(wells: DataFrame, areas: DataFrame, x: str, y: str) -> DataFrame:
    """Every well with every rectangle that holds it: few rectangles are broadcast, many meet the wells in grid cells."""
    inside = F.col(x).between(F.col("min_x"), F.col("max_x")) & F.col(y).between(F.col("min_y"), F.col("max_y"))
    if _few(areas):
        return wells.join(F.broadcast(areas), inside)
    cell = lambda c: F.floor(F.col(c) / CELL)
    w = wells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_cx": cell(x), "_cy": cell(y)})
    # Rectangles are cut by the cells that hold a well.
    there = w.groupBy("_cx").agg(F.min("_cy").alias("_lo"), F.max("_cy").alias("_hi"))
    span = w.agg(F.min("_cx").alias("_first"), F.max("_cx").alias("_end"))
    a = areas.where("min_x <= max_x and min_y <= max_y").join(F.broadcast(span)).withColumn("_a", F.greatest(cell("min_x"), F.col("_first"))).withColumn("_b", F.least(cell("max_x"), F.col("_end")))  # one row
    a = a.where("_a <= _b").withColumn("_cx", F.explode(F.sequence("_a", "_b"))).join(there, "_cx")
    a = a.withColumn("_a", F.greatest(cell("min_y"), F.col("_lo"))).withColumn("_b", F.least(cell("max_y"), F.col("_hi"))).where("_a <= _b")
    a = a.withColumn("_cy", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b", "_lo", "_hi", "_first", "_end")
    return w.join(a, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def first_area(wells: DataFrame, areas: DataFrame, x: str = "x_coord", y: str = "y_coord") -> DataFrame:
    """Every well with the first listed area that holds it, null if none does."""
    a = areas.select("area_id", "area", "min_x", "max_x", "min_y", "max_y")
    found = _in_rectangles(wells.select("well_id", x, y), a, x, y).select("well_id", "area_id", "area")
    every = wells.select("well_id", F.lit(None).cast("long").alias("area_id"), F.lit(None).cast("string").alias("area"))
    return found.unionByName(every).groupBy("well_id").agg(F.min_by("area", "area_id").alias("area"))


def merge_with_traces(log: DataFrame, traces: DataFrame, resolution: float, start: str = "start", value: str = "amp") -> DataFrame:
    """Readings (x, y, depth) with the sample of their trace at their depth; `start` is the depth of sample 0.

    traces: x, y, amp array. Readings beyond the trace get null.
    """
    i = depth_index(F.col("depth"), resolution, F.col(start))
    return log.withColumn("_i", i).join(traces.select("x", "y", value), ["x", "y"], "left").withColumn(value, F.get(value, F.col("_i"))).drop("_i")


def window_slice(traces: DataFrame, z_low: float, z_high: float, start: float, resolution: float, nz: int) -> DataFrame:
    """Samples of traces between two depths: first and last index cut at the trace's ends. Depths come out as `depth`."""
    import math

    i0 = max(int((z_low - start) // resolution), 0)
    i1 = min(math.ceil((z_high - start) / resolution), nz - 1)
    part = traces.select("x", "y", F.posexplode(F.slice("amp", i0 + 1, max(i1 - i0 + 1, 0))).alias("k", "amp"))
    return part.select("x", "y", (F.col("k") + i0).alias("z"), ((F.col("k") + i0) * resolution + start).alias("depth"), "amp")


def resample_traces(traces: DataFrame, depths: Sequence[float], targets: Sequence[float]) -> DataFrame:
    """Every trace interpolated from `depths` to `targets`, in Arrow batches."""
    d, t = np.asarray(depths, float), np.asarray(targets, float)

    @F.pandas_udf("array<double>")
    def at(amp: pd.Series) -> pd.Series:
        return amp.map(lambda a: np.interp(t, d, np.asarray(a, float)).tolist() if a is not None else None)

    return traces.withColumn("amp", at("amp"))


def by_well(log: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The user's `function` on the readings of every series; what it gives has `schema`. A series is one pandas table,
    so this is for functions that no expression can state."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return function(pdf)

    return log.groupBy(*keys).applyInPandas(work, schema)

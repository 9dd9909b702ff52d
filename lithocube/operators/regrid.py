"""Problem 2: irregular readings onto a regular depth grid, holes filled by singular-spectrum imputation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithocube.operators.missing import CODES, is_missing
from lithocube.session import cut, small

#: Steps of a block of grid and of the margin it sees of its neighbours. A block is what one numpy call works on.
BLOCK, MARGIN = 256, 32
#: Rounds after which a filling that still moves is an error. Long holes take up to some thousands.
MOST_ROUNDS = 100_000


def _project(x: np.ndarray, lags: int, rank: int) -> np.ndarray:
    """Rank-`rank` singular-spectrum reconstruction of each row of `x`: Hankel trajectories, truncation, diagonal means."""
    n = x.shape[1]
    hankel = np.lib.stride_tricks.sliding_window_view(x, lags, axis=1)
    _, vectors = np.linalg.eigh(hankel.transpose(0, 2, 1) @ hankel)
    top = vectors[:, :, -rank:]
    low = (hankel @ top) @ top.transpose(0, 2, 1)
    out, k = np.zeros_like(x), n - lags + 1
    for j in range(lags):
        out[:, j : j + k] += low[:, :, j]
    at = np.arange(n)
    return out / np.minimum(np.minimum(at + 1, n - at), min(lags, k))


def ssa_fill(x: np.ndarray, lags: int = 12, rank: int = 2, most: int = MOST_ROUNDS, tol: float = 1e-3) -> np.ndarray:
    """Rows of `x` with NaN replaced: straight lines first, then truncated reconstructions until no value of the row
    moves by more than `tol` of the scatter of its known values. More than `most` rounds are an error.

    Rows need at least one number. Known values are never changed. Series shorter than 6 keep the straight lines.
    """
    gap = np.isnan(x)
    at = np.arange(x.shape[1])
    y = x.copy()
    for row, g in zip(y, gap):
        row[g] = np.interp(at[g], at[~g], row[~g])
    if x.shape[1] < 6:
        return y
    lags = min(lags, x.shape[1] // 2)
    count = np.maximum((~gap).sum(axis=1), 1)
    mean = np.where(gap, 0.0, y).sum(axis=1) / count
    scale = np.sqrt(np.where(gap, 0.0, (y - mean[:, None]) ** 2).sum(axis=1) / count)
    lo, hi = np.where(gap, np.inf, y).min(axis=1), np.where(gap, -np.inf, y).max(axis=1)
    live = np.flatnonzero(gap.any(axis=1) & (scale > 0))
    for _ in range(most):
        if not live.size:
            break
        z, g, m = y[live], gap[live], mean[live, None]
        new = np.clip(_project(z - m, lags, min(rank, lags)) + m, lo[live, None], hi[live, None])
        moved = np.where(g, np.abs(new - z), 0.0).max(axis=1)
        y[live] = np.where(g, new, z)
        live = live[moved > tol * scale[live]]
    if live.size:
        raise ValueError(f"{live.size} series still move after {most} rounds of filling")
    return y


def _fill_blocks(lags: int, rank: int):
    def run(batches):
        for pdf in batches:
            first, lengths = pdf["first"].to_numpy(), pdf["length"].to_numpy()
            values: list = [None] * len(pdf)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                x = np.full((len(rows), n), np.nan)
                for k, i in enumerate(rows):
                    at, v = pdf["at"].iat[i], pdf["v"].iat[i]
                    if at is not None and len(at):
                        x[k, np.asarray(at) - first[i]] = v
                    if np.isnan(x[k]).all():  # wholly inside a hole: its neighbours' nearest values
                        a, b = pdf["before"].iat[i], pdf["after"].iat[i]
                        (a0, av), (b0, bv) = (a["bucket"], a["v"]), (b["bucket"], b["v"])
                        x[k] = av + (bv - av) * (first[i] + np.arange(n) - a0) / (b0 - a0)
                    elif np.isnan(x[k, 0]) or np.isnan(x[k, -1]):
                        for end, side in ((0, pdf["before"].iat[i]), (n - 1, pdf["after"].iat[i])):
                            beyond = side is not None and (side["bucket"] < first[i] if end == 0 else side["bucket"] >= first[i] + n)
                            if np.isnan(x[k, end]) and beyond:
                                near = np.flatnonzero(~np.isnan(x[k]))[0 if end == 0 else -1]
                                share = (first[i] + end - side["bucket"]) / (first[i] + near - side["bucket"])
                                x[k, end] = side["v"] + (x[k, near] - side["v"]) * share
                y = ssa_fill(x, lags, rank)
                for k, i in enumerate(rows):
                    values[i] = y[k].tolist()
            yield pd.DataFrame({"run_id": pdf["run_id"], "own_lo": pdf["own_lo"], "own_hi": pdf["own_hi"], "first": first, "at": pdf["own"], "value": values})

    return run


def regular_grid(
    readings: DataFrame, steps: DataFrame, value: str = "density_por", lags: int = 12, rank: int = 2, codes: tuple[float, ...] = CODES
) -> DataFrame:
    """One row per run and depth step from the first to the last step that has a reading.

    `readings`: run_id, campaign, depth, log_id and `value`; `steps`: campaign, n_meters (one row per campaign).
    Result: run_id, bucket = floor(depth / n_meters), n_readings, `value`, filled. A step with readings holds the mean
    of them, a reading counting once per log_id; a step without is filled by iterative singular-spectrum imputation
    on blocks of 256 steps that see 32 steps of their neighbours; a block wholly inside a hole takes the straight line
    between the readings on both sides. Filled values stay within what the block has measured. Filling goes on until
    no value of a block moves by more than a thousandth of its scatter, however many rounds that takes; one that has
    not come to rest after MOST_ROUNDS is an error.
    - Readings with null depth, missing value (see is_missing), null run_id, or a campaign without a positive step
      take no part. Wrong but measured values do, clipped to 0..100 in the means only where they exceed it.
    - A run on several campaigns' steps is one series per step size; its rows then repeat by step only if the sizes
      differ. Empty tables give empty results; other columns are ignored.
    """
    steps = steps.where("n_meters > 0").groupBy(F.col("campaign").alias("_c")).agg(F.min("n_meters").alias("step"))
    v: Column = F.col(value)
    depth_ok = F.col("depth").isNotNull() & ~F.isnan("depth") & (F.abs("depth") < 1e15)
    r = readings.where(depth_ok & ~is_missing(v, codes) & F.col("run_id").isNotNull())
    r = r.select("run_id", "campaign", "log_id", "depth", v.alias("v")).join(small(steps), F.col("campaign") == F.col("_c"))
    r = r.select("run_id", F.floor(F.col("depth") / F.col("step")).alias("bucket"), F.coalesce("log_id", F.xxhash64("depth", "v")).alias("rid"), "v")
    # Keyed by run and step from the start: one shuffle serves both aggregations, and no run is in one task.
    r = r.repartition("run_id", "bucket").groupBy("run_id", "bucket", "rid").agg(F.min("v").alias("v"))
    cells = r.groupBy("run_id", "bucket").agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "v"))).alias("v"), F.count(F.lit(1)).alias("n_readings"))
    cells = cut(cells)

    # Blocks: each takes its own steps, and copies of the steps next to it.
    own = F.floor(F.col("bucket") / BLOCK)
    inside = F.pmod(F.col("bucket"), F.lit(BLOCK))
    copies = F.array(
        F.struct(own.alias("block"), F.lit(True).alias("mine")),
        F.when(inside < MARGIN, F.struct((own - 1).alias("block"), F.lit(False).alias("mine"))),
        F.when(inside >= BLOCK - MARGIN, F.struct((own + 1).alias("block"), F.lit(False).alias("mine"))),
    )
    spread = cells.withColumn("c", F.explode(copies)).where("c is not null")
    cell = F.struct("bucket", "v", "n_readings")
    blocks = spread.groupBy("run_id", F.col("c.block").alias("block")).agg(
        F.collect_list(F.when(F.col("c.mine"), cell)).alias("own"),
        F.collect_list(F.when(~F.col("c.mine"), cell)).alias("near"),
    )
    spans = cells.groupBy("run_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    frame = spans.select("run_id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))).alias("block"))
    # Only the ends of blocks, a few numbers each, are looked at along a run; frames grow from one side, so it is linear.
    ends = cells.groupBy("run_id", own.alias("block")).agg(F.max(F.struct("bucket", "v")).alias("last"), F.min(F.struct("bucket", "v")).alias("start"))
    along = Window.partitionBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.join(ends, ["run_id", "block"], "left")
    frame = frame.withColumn("before", F.last("last", ignorenulls=True).over(along.orderBy("block")))
    frame = cut(frame.withColumn("after", F.last("start", ignorenulls=True).over(along.orderBy(F.desc("block")))).drop("last", "start"))
    blocks = frame.join(blocks, ["run_id", "block"], "left")
    margin = lambda b, sign: F.greatest(F.col("lo"), F.least(F.col("hi"), b + sign * MARGIN))
    start, end = F.col("block") * BLOCK, F.col("block") * BLOCK + BLOCK - 1
    every = F.concat(F.coalesce("own", F.array()), F.coalesce("near", F.array()))
    blocks = blocks.select(
        "run_id", "before", "after",
        F.greatest(F.col("lo"), start).alias("own_lo"), F.least(F.col("hi"), end).alias("own_hi"),
        margin(start, -1).alias("first"), (margin(end, 1) - margin(start, -1) + 1).alias("length"),
        F.transform(F.coalesce("own", F.array()), lambda x: F.struct(x.bucket.alias("bucket"), x.n_readings.alias("n"))).alias("own"),
        F.transform(every, lambda x: x.bucket).alias("at"), F.transform(every, lambda x: x.v).alias("v"),
    )
    kinds = "run_id long, own_lo long, own_hi long, first long, at array<struct<bucket:long,n:long>>, value array<double>"
    done = blocks.mapInPandas(_fill_blocks(lags, rank), kinds)
    n_at = F.map_from_entries("at")
    rows = done.select(
        "run_id", "first", "value", n_at.alias("n_at"),
        F.explode(F.sequence("own_lo", "own_hi")).alias("bucket"),
    )
    return rows.select(
        "run_id", "bucket", F.coalesce(F.try_element_at("n_at", F.col("bucket")), F.lit(0)).cast("long").alias("n_readings"),
        F.element_at("value", (F.col("bucket") - F.col("first") + 1).cast("int")).alias(value),
        F.try_element_at("n_at", F.col("bucket")).isNull().alias("filled"),
    )

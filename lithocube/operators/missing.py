"""Problem 1: missing porosities filled by chained equations.

Every notation of "no value" is recognised, every such cell is filled from comparable readings (same run, else same
campaign, else all) and marked. The fit is distributed: each sweep is one aggregation of normal equations per campaign
and field, solved where the sums arrive; rows never leave the JVM.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithocube.session import cut, small

FIELDS = ("neutron_por", "density_por", "sonic_por")
#: Codes that stand for "no value" in log files. No porosity lies near any of them.
CODES = (-999.0, -999.25, -9999.0, -9999.25, -99999.0, 999.0, 999.25, 9999.0, 99999.0, 1e30, -1e30)
#: Fields with each of their predictors, and the sums kept of a predictor over the readings that have the field.
PAIRS = [(f, x) for f in FIELDS for x in FIELDS if x != f]
JOINT = [("js1", F.sum, 1.0), ("jn1", F.count, 1.0), ("js", F.sum, 100.0), ("jn", F.count, 100.0)]


def is_missing(col: Column, codes: tuple[float, ...] = CODES) -> Column:
    """True for null, NaN, infinities and the codes; a wrong but measured value is not missing."""
    return col.isNull() | F.isnan(col) | (F.abs(col) == float("inf")) | F.coalesce(col.isin(*codes), F.lit(False))


def latest_readings(df: DataFrame, key: str = "log_id", received: str = "received_at") -> DataFrame:
    """One row per `key`: the one received last. Of rows received at one time, the one with the greatest hash of its cells.

    Rows without a key cannot be told to be repeats; only those equal in every cell count as one.
    """
    cells = F.xxhash64(*[c for c in df.columns if c != received])
    w = Window.partitionBy("_key", F.isnull(key)).orderBy(F.desc_nulls_last(received), F.desc("_cells"))
    numbered = df.withColumn("_cells", cells).withColumn("_key", F.coalesce(key, F.col("_cells")))
    return numbered.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_cells", "_key", "_rn")


def _solve(p: int, ridge: float):
    """Sums of one campaign and field into coefficients and residual deviation, for mapInPandas."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                d = r._asdict()
                out = {"grp": d["grp"]}
                for f in FIELDS:
                    n = d[f"n_{f}"] or 0.0
                    beta, sd = np.zeros(p), 0.0
                    if n >= 1:
                        xx = np.zeros((p, p))
                        for i, j in pairs:
                            xx[i, j] = xx[j, i] = d[f"xx_{f}_{i}_{j}"]
                        xy = np.array([d[f"xy_{f}_{i}"] for i in range(p)])
                        beta = np.linalg.solve(xx + ridge * np.eye(p), xy)
                        sse = d[f"yy_{f}"] - 2 * beta @ xy + beta @ xx @ beta
                        sd = float(np.sqrt(max(sse, 0.0) / max(n - p, 1.0)))
                    out |= {f"b_{f}": beta.tolist(), f"sd_{f}": sd}
                rows.append(out)
            yield pd.DataFrame(rows, columns=["grp"] + [x for f in FIELDS for x in (f"b_{f}", f"sd_{f}")])

    return run


def _normal(seed: int, f: str) -> Column:
    """A standard normal deviate that depends on the reading and the field only (Box-Muller on two hashes)."""
    u = [(F.pmod(F.xxhash64(F.col("rid"), F.lit(f), F.lit(seed + k)), F.lit(1_000_003)) + 0.5) / 1_000_003 for k in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])


def impute_chained(
    readings: DataFrame, sweeps: int = 3, noise: float = 1.0, ridge: float = 1e-3, seed: int = 7, codes: tuple[float, ...] = CODES
) -> DataFrame:
    """Fill neutron_por, density_por and sonic_por of `readings`; one row per reading.

    Result: log_id, run_id, campaign, depth, the three fields without gaps, and for each field `<field>_state`:
    'measured', 'filled', or 'unfillable' (value null: no reading of the whole table has the field).
    Method: chained equations. A field's deviation from its run mean is regressed on the deviations of the other two
    and on depth within the run, per campaign; the fits are repeated `sweeps` times on the filled values, each with
    residual variation of the fit's own size (`noise` times), drawn by a hash of the reading, so runs repeat exactly.
    - A run without any value of a field takes its campaign's mean, that failing the mean of all readings.
    - Runs that write fractions (most plausible values at most 1) are fitted in percent and come out as fractions.
    - Impossible values stay in the result as measured but take no part in any fit or mean.
    - Null run, campaign or depth: null keys form a group of their own, a null depth counts as the middle of the run.
    - Repeats of a log_id come out once, as received last. Empty tables give empty results. Other columns are ignored.
    """
    base = latest_readings(readings.select("log_id", "run_id", "campaign", "depth", *FIELDS, "received_at"))
    base = base.withColumn("rid", F.coalesce("log_id", F.xxhash64("run_id", "depth", *FIELDS)))
    base = base.withColumn("depth_", F.when(F.isnan("depth"), None).otherwise(F.col("depth")))
    base = cut(base.drop("received_at"))

    # Per run: unit, mean of each field, middle and spread of depth.
    value = {f: F.when(~is_missing(F.col(f), codes), F.col(f)) for f in FIELDS}
    within = lambda c, hi: F.when((c >= 0) & (c <= hi), c)
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    runs = base.groupBy("run_id", "campaign").agg(
        F.sum(total([within(value[f], 1.0).isNotNull().cast("int") for f in FIELDS])).alias("ones"),
        F.sum(total([within(value[f], 100.0).isNotNull().cast("int") for f in FIELDS])).alias("all"),
        *[F.sum(within(value[f], 1.0)).alias(f"s1_{f}") for f in FIELDS],
        *[F.count(within(value[f], 1.0)).alias(f"n1_{f}") for f in FIELDS],
        *[F.sum(within(value[f], 100.0)).alias(f"s_{f}") for f in FIELDS],
        *[F.count(within(value[f], 100.0)).alias(f"n_{f}") for f in FIELDS],
        # Means of a predictor over the readings that have the field: a run's gaps in a field then shift nothing.
        *[g(F.when(within(value[f], hi).isNotNull(), within(value[x], hi))).alias(f"{k}_{f}_{x}") for f, x in PAIRS for k, g, hi in JOINT],
        F.avg("depth_").alias("mid"),
        F.stddev_pop("depth_").alias("spread"),
    )
    fraction = F.coalesce(F.col("ones") * 2 > F.col("all"), F.lit(False))
    runs = runs.withColumn("scale", F.when(fraction, 100.0).otherwise(1.0))
    for f in FIELDS:
        runs = runs.withColumn(f"n_{f}", F.when(F.col("scale") == 100, F.col(f"n1_{f}")).otherwise(F.col(f"n_{f}")))
        runs = runs.withColumn(f"s_{f}", F.when(F.col("scale") == 100, F.col(f"s1_{f}") * 100).otherwise(F.col(f"s_{f}")))
    both = [F.when(F.col("scale") == 100, F.try_divide(F.col(f"js1_{f}_{x}") * 100, F.col(f"jn1_{f}_{x}"))).otherwise(F.try_divide(f"js_{f}_{x}", f"jn_{f}_{x}")).alias(f"j_{f}_{x}") for f, x in PAIRS]
    runs = runs.select("run_id", "campaign", "scale", "mid", "spread", *[f"{k}_{f}" for f in FIELDS for k in ("n", "s")], *both)
    runs = runs.transform(cut)
    # Campaign means, and the mean of all in the row with grp null.
    means = runs.groupBy("campaign").agg(*[F.try_divide(F.sum(f"s_{f}"), F.sum(f"n_{f}")).alias(f"c_{f}") for f in FIELDS])
    over_all = runs.agg(*[F.try_divide(F.sum(f"s_{f}"), F.sum(f"n_{f}")).alias(f"g_{f}") for f in FIELDS])
    means = means.select(F.col("campaign").alias("_c"), *[f"c_{f}" for f in FIELDS])
    runs = runs.join(small(means), F.col("campaign").eqNullSafe(F.col("_c"))).crossJoin(F.broadcast(over_all))  # one row
    runs = runs.select(
        F.col("run_id").alias("_run"), F.col("campaign").alias("_camp"), "scale", "mid", "spread",
        *[F.coalesce(F.try_divide(F.col(f"s_{f}"), F.col(f"n_{f}")), F.col(f"c_{f}"), F.col(f"g_{f}")).alias(f"m_{f}") for f in FIELDS],
        *[f"j_{f}_{x}" for f, x in PAIRS],
    )
    joined = base.join(runs, F.col("run_id").eqNullSafe(F.col("_run")) & F.col("campaign").eqNullSafe(F.col("_camp")))
    grp = F.coalesce(F.xxhash64("campaign"), F.lit(0))
    state = joined.select(
        "log_id", "rid", "run_id", "campaign", "depth", *FIELDS, grp.alias("grp"), "scale",
        F.coalesce(F.try_divide(F.col("depth_") - F.col("mid"), F.col("spread")), F.lit(0.0)).alias("t"),
        *[F.col(f"m_{f}") for f in FIELDS],
        *[F.coalesce(F.col(f"m_{x}") - F.col(f"j_{f}_{x}"), F.lit(0.0)).alias(f"off_{f}_{x}") for f, x in PAIRS],
        *[is_missing(F.col(f), codes).alias(f"gap_{f}") for f in FIELDS],
        # Deviation from the run's mean in percent, null where it is missing or impossible.
        *[(within(value[f] * F.col("scale"), 100.0) - F.col(f"m_{f}")).alias(f"o_{f}") for f in FIELDS],
    )
    state = cut(state)

    p = 4
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    kinds = "grp long, " + ", ".join(f"b_{f} array<double>, sd_{f} double" for f in FIELDS)

    def predictors(f: str) -> list[Column]:
        a, b = [x for x in FIELDS if x != f]
        return [F.lit(1.0), F.col(f"d_{a}") + F.col(f"off_{f}_{a}"), F.col(f"d_{b}") + F.col(f"off_{f}_{b}"), F.col("t")]

    now = state.select("*", *[F.coalesce(F.col(f"o_{f}"), F.lit(0.0)).alias(f"d_{f}") for f in FIELDS])
    for _ in range(sweeps):
        sums = []
        for f in FIELDS:
            x, y, known = predictors(f), F.col(f"o_{f}"), F.col(f"o_{f}").isNotNull()
            sums += [F.sum(known.cast("double")).alias(f"n_{f}"), F.sum(y * y).alias(f"yy_{f}")]
            sums += [F.sum(F.when(known, x[i] * x[j])).alias(f"xx_{f}_{i}_{j}") for i, j in pairs]
            sums += [F.sum(x[i] * y).alias(f"xy_{f}_{i}") for i in range(p)]
        fit = now.groupBy("grp").agg(*sums).mapInPandas(_solve(p, ridge), kinds)
        fit = small(cut(fit))
        # The new values of all three fields are made from the old ones, side by side.
        z = {f: F.element_at(f"b_{f}", 1) + sum(F.element_at(f"b_{f}", i + 1) * predictors(f)[i] for i in range(1, p)) for f in FIELDS}
        keep = [c for c in now.columns if not c.startswith("d_")]
        now = now.join(fit, "grp", "left").select(
            *keep,
            *[F.coalesce(F.col(f"o_{f}"), z[f] + noise * F.col(f"sd_{f}") * _normal(seed, f), F.lit(0.0)).alias(f"d_{f}") for f in FIELDS],
        )
    filled = {f: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(f"m_{f}") + F.col(f"d_{f}"))) / F.col("scale") for f in FIELDS}
    out = now.select(
        "log_id", "run_id", "campaign", "depth",
        *[F.when(F.col(f"gap_{f}"), F.when(F.col(f"m_{f}").isNotNull(), filled[f])).otherwise(F.col(f)).alias(f) for f in FIELDS],
        *[F.col(f"gap_{f}") for f in FIELDS],
    )
    return out.select(
        "log_id", "run_id", "campaign", "depth", *FIELDS,
        *[F.when(~F.col(f"gap_{f}"), "measured").when(F.col(f).isNotNull(), "filled").otherwise("unfillable").alias(f"{f}_state") for f in FIELDS],
    )


def filled_cells(imputed: DataFrame) -> DataFrame:
    """log_id and field of every cell the operator had to fill (or could not fill, if the whole table lacks the field)."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_state").alias("state")) for f in FIELDS])
    cells = imputed.select("log_id", F.explode(cells).alias("c")).where("c.state <> 'measured'")
    return cells.select("log_id", "c.field").distinct()

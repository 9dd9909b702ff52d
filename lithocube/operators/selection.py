"""Forward selection of displaced features by leaving one well out, and the search for training parameters.

A round is one Spark job: every candidate is a group, its folds run inside the group's numpy function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithocube.operators import gbdt
from lithocube.operators.lookup import candidates as list_candidates
from lithocube.operators.lookup import minicube
from lithocube.schema import State
from lithocube.session import cut, settings, small

Chosen = tuple[str, tuple[int, int, int]]

#: Training points that one candidate's group may hold; more are an error, so that a run sets max_points.
MOST_POINTS = 2_000_000


def bounded(points: DataFrame) -> DataFrame:
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} training points; sample them first (max_points)")
    return points


def leave_wells_out(x: np.ndarray, y: np.ndarray, wells: np.ndarray, real: np.ndarray, p: gbdt.Params, chunks: int = 1) -> tuple[float, float, int] | None:
    """Mean over wells of RMSE and MAE, and the number of folds; None if a fold has nothing to train on.

    A well without real points validates nothing and is skipped. With several chunks the model learns them in turn.
    """
    errors = []
    for w in np.unique(wells):
        val = (wells == w) & (real == State.REAL)
        tr = wells != w
        if not val.any():
            continue
        if not tr.any():
            return None
        model = None
        for part in np.array_split(np.flatnonzero(tr), chunks):
            if len(part):
                model = gbdt.train(x[part], y[part], p, x[val], y[val], model)
        e = y[val] - model.predict(x[val])
        errors.append((np.sqrt(np.mean(e * e)), np.mean(np.abs(e))))
    if not errors:
        return None
    m = np.mean(errors, axis=0)
    return float(m[0]), float(m[1]), len(errors)


def trials(points: DataFrame, candidates: DataFrame, n_committed: int, p: gbdt.Params = gbdt.Params(), chunks: int = 1) -> DataFrame:
    """feature, dx, dy, dz, rmse, mae, folds of every candidate; nulls where a fold could not be trained.

    points: feature, x, y, z, values (minicube of the point), phi, well_id, real, committed (array of the features
    chosen so far). candidates: feature, dx, dy, dz and `at`, the place in values, from 0. A group holds the training points of one iteration (the sample's quota), once per candidate.
    """
    each = points.join(small(candidates), "feature").withColumn("v", F.get("values", F.col("at")))
    options = asdict(p)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["well_id", "x", "y", "z"])
        x = pdf["v"].to_numpy(float)[:, None]
        if n_committed:
            x = np.column_stack([np.stack(pdf["committed"].to_numpy()), x])
        got = leave_wells_out(x, pdf["phi"].to_numpy(float), pdf["well_id"].to_numpy(), pdf["real"].to_numpy(), gbdt.Params(**options), chunks)
        rmse, mae, folds = got if got else (None, None, 0)
        return pd.DataFrame([[*key, rmse, mae, folds]], columns=["feature", "dx", "dy", "dz", "rmse", "mae", "folds"])

    take = each.select("feature", "dx", "dy", "dz", "x", "y", "z", "phi", "well_id", "real", "committed", "v")
    return take.groupBy("feature", "dx", "dy", "dz").applyInPandas(run, "feature string, dx int, dy int, dz int, rmse double, mae double, folds int")


def best_of(results: DataFrame) -> DataFrame:
    """The candidate with the least RMSE; ties by name and displacement."""
    return results.where("rmse is not null").orderBy("rmse", "feature", "dx", "dy", "dz").limit(1)


def forward_selection(
    points: DataFrame, traces: DataFrame, window: int, shape: tuple[int, int, int], n_features: int, p: gbdt.Params = gbdt.Params(),
    first: int | None = None, only_z: bool = False, chunks: int = 1, max_features: int | None = None,
) -> tuple[list[Chosen], DataFrame | None]:
    """The features chosen one after the other, and the results of the last round (None if nothing could be tried).

    points: x, y, z, phi, well_id, real (training wells only). traces: feature, x, y, amp. `first` limits the
    candidates tried in a round, as a run's settings may. The best error is looked for anew in every round. Selection
    ends early when no candidate can be trained: at least two wells are needed.
    """
    bounded(points)
    features = traces.select("feature").distinct()
    names = sorted(r[0] for r in settings(features, 10_000))[:max_features]
    if not names:
        return [], None
    # All features in one join: the traces bring their feature along.
    wanted = traces if len(names) == features.count() else traces.join(small(points.sparkSession.createDataFrame([(n,) for n in names], "feature string")), "feature", "left_semi")
    cubes = minicube(points, wanted, window, shape, by=("feature",))
    cubes = cut(points.select("x", "y", "z", "phi", "well_id", "real").join(cubes, ["x", "y", "z"]))
    side = 2 * window + 1
    at = ((F.col("dx") + window) * side + (F.col("dy") + window)) * side + F.col("dz") + window
    every = list_candidates(features if max_features is None else features.where(F.col("feature").isin(*names)), window, only_z, first=first).withColumn("at", at)
    chosen: list[Chosen] = []
    results = None
    committed = points.select("x", "y", "z", F.array().cast("array<double>").alias("committed"))
    for _ in range(n_features):
        left = every
        for f, (dx, dy, dz) in chosen:
            left = left.where(~((F.col("feature") == f) & (F.col("dx") == dx) & (F.col("dy") == dy) & (F.col("dz") == dz)))
        results = cut(trials(cubes.join(committed, ["x", "y", "z"]), left, len(chosen), p, chunks))
        best = best_of(results).first()
        if best is None:
            break
        chosen.append((best["feature"], (best["dx"], best["dy"], best["dz"])))
        one = (((best["dx"] + window) * side) + best["dy"] + window) * side + best["dz"] + window
        column = cubes.where(F.col("feature") == best["feature"]).select("x", "y", "z", F.get("values", F.lit(one)).alias("_v"))
        committed = cut(committed.join(column, ["x", "y", "z"]).select("x", "y", "z", F.array_append("committed", F.col("_v")).alias("committed")))
    return chosen, results


def best_of_all(rounds: Sequence[DataFrame]) -> DataFrame:
    """The best of all sets tested in all rounds (results of forward_selection, one after the other): round, the
    candidate and its errors. A set of an early round, which is shorter, may win; ties go to the shorter set."""
    every = [r.withColumn("round", F.lit(i)) for i, r in enumerate(rounds)]
    out = every[0]
    for r in every[1:]:
        out = out.unionByName(r)
    return out.where("rmse is not null").orderBy("rmse", "round", "feature", "dx", "dy", "dz").limit(1)


def guided_search(
    points: DataFrame, features: Sequence[str], space: DataFrame, base: gbdt.Params = gbdt.Params(), budgets: Sequence[int] = (20, 60, 180), keep: float = 1 / 3,
    done: DataFrame | None = None, path: str | None = None,
) -> DataFrame:
    """stage, trial, rounds, rmse, mae, folds of a search by successive halving: all of `space` with few boosting
    rounds, the best `keep` of them with more, and so on through `budgets`.

    A stage is one job. With `path` each stage's results are written there, and those already there (or in `done`) are
    not computed again, so a search that was cut off goes on; the best trial is the first by stage (descending) and rmse.
    """
    spark = points.sparkSession
    left, out = space.drop("rounds"), None
    n = space.count()
    for stage, rounds in enumerate(budgets):
        have = None if done is None else done.where(F.col("stage") == stage).select("stage", "trial", "rounds", "rmse", "mae", "folds")
        ask = left if have is None else left.join(have.select("trial"), "trial", "left_anti")
        got = parameter_search(points, features, ask.withColumn("rounds", F.lit(rounds)), base)
        got = got.select(F.lit(stage).alias("stage"), "trial", F.lit(rounds).alias("rounds"), "rmse", "mae", "folds")
        if have is not None:
            got = got.unionByName(have.join(left.select("trial"), "trial", "left_semi").select(*got.columns))
        got = cut(got)
        if path:
            got.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)
        out = got if out is None else out.unionByName(got)
        n = max(1, int(np.ceil(n * keep)))
        best = [r["trial"] for r in got.where("rmse is not null").orderBy("rmse", "trial").limit(n).collect()]
        left = left.join(small(spark.createDataFrame([(b,) for b in best], f"trial {space.schema['trial'].dataType.simpleString()}")), "trial", "left_semi")
    return out


def parameter_search(points: DataFrame, features: Sequence[str], space: DataFrame, base: gbdt.Params = gbdt.Params()) -> DataFrame:
    """trial, rmse, mae, folds for every row of `space` (trial and parameters by the names of gbdt.Params): each trial
    is a group with the same leave-one-well-out body as feature selection."""
    names = [c for c in space.columns if c != "trial"]
    each = bounded(points).join(small(space))  # every trial sees all points of the bounded sample

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["well_id", "x", "y", "z"])
        given = {n: type(getattr(base, n))(pdf[n].iat[0]) for n in names}
        got = leave_wells_out(pdf[list(features)].to_numpy(float), pdf["phi"].to_numpy(float), pdf["well_id"].to_numpy(), pdf["real"].to_numpy(), base.with_(**given))
        return pd.DataFrame([[*key, *(got or (None, None, 0))]], columns=["trial", "rmse", "mae", "folds"])

    return each.groupBy("trial").applyInPandas(run, "trial int, rmse double, mae double, folds int")


def random_space(spark, n: int, seed: int = 1) -> DataFrame:
    """`n` parameter sets drawn by hash: learning rate, leaves, depth, least data, bins, rounds."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(10_007)) / 10_007.0
    between = lambda k, lo, hi: (F.lit(lo) + u(k) * (hi - lo)).cast("int")
    return spark.range(n).select(
        F.col("id").cast("int").alias("trial"), F.pow(F.lit(10.0), u(0) * 2 - 2.3).alias("learning_rate"), between(1, 4, 64).alias("num_leaves"),
        between(2, 3, 12).alias("max_depth"), between(3, 2, 40).alias("min_data"), between(4, 16, 255).alias("max_bin"), between(5, 20, 120).alias("rounds"),
    )

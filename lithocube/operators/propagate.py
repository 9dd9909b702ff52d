"""Filling the cube ring by ring: train on what is known, predict the next ring, append it as a partition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.operators import gbdt
from lithocube.operators.compare import error_metrics
from lithocube.operators.cube import COLUMNS
from lithocube.operators.geometry import Well, assign_rings, frontier, owner
from lithocube.operators.lookup import with_features
from lithocube.operators.predicates import PREDICTION
from lithocube.operators.sampling import sampled
from lithocube.operators.selection import Chosen
from lithocube.plans.config import Sampling
from lithocube.schema import State
from lithocube.session import cut

#: Most training points that one model is fitted on. Only a run's `max_points` keeps it below; without it, more are an error.
MAX_TRAIN = 2_000_000


def fit(points: DataFrame, names: Sequence[str], p: gbdt.Params = gbdt.Params(), most: int = MAX_TRAIN) -> gbdt.Model:
    """One model from all `points`' features. More than `most` rows are an error, never cut off silently; a run's own
    settings (max_points) may sample them before."""
    rows = points.where(F.col("phi").isNotNull()).select("x", "y", "z", "phi", *names)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} training points; sample them first")
    pdf = rows.toPandas().sort_values(["x", "y", "z"])
    if not len(pdf):
        raise ValueError("no training points")
    return gbdt.train(pdf[list(names)].to_numpy(float), pdf["phi"].to_numpy(float), p)


def predict(points: DataFrame, names: Sequence[str], model: gbdt.Model, name: str = "phi") -> DataFrame:
    """`points` with the model's value in `name`; the model goes to the executors once."""
    shipped = points.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def value(*columns: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.predict(np.column_stack([c.to_numpy(float) for c in columns])))

    return points.withColumn(name, value(*[F.col(n) for n in names]))


def ring_model(
    cube: DataFrame, traces: DataFrame, test_wells: Sequence[int], chosen: Sequence[Chosen], shape: tuple[int, int, int], ring: int,
    p: gbdt.Params = gbdt.Params(), sample: Sampling | None = None,
) -> gbdt.Model:
    """The model of ring `ring`: trained on the known points of rings before it, all of them or those that the quotas
    of `sample` leave if its max_points is above 0."""
    known = PREDICTION.without_wells(list(test_wells)).of(cube).where(F.col("ring") < max(ring, 1))
    names = [f"f{i}" for i in range(len(chosen))]
    return fit(with_features(sampled(known, sample) if sample else known, traces, chosen, shape), names, p)


def propagate_ring(
    cube: DataFrame, traces: DataFrame, wells: Sequence[Well], test_wells: Sequence[int], chosen: Sequence[Chosen], shape: tuple[int, int, int],
    ring: int, p: gbdt.Params = gbdt.Params(), state: int = State.EMPTY, sample: Sampling | None = None, model: gbdt.Model | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The points of ring `ring` with predicted phi (columns of the cube), and the errors on the test wells.

    Only training wells spread. Without a `model` (a saved one, say) that of ring_model is trained.
    """
    names = [f"f{i}" for i in range(len(chosen))]
    train_wells = [w for w in wells if w[0] not in test_wells]
    model = model or ring_model(cube, traces, test_wells, chosen, shape, ring, p, sample)
    next_ring = with_features(frontier(cube, train_wells, ring, state), traces, chosen, shape)
    filled = predict(next_ring, names, model).withColumn("real", F.lit(int(State.PROPAGATED))).select(*COLUMNS)
    test = PREDICTION.wells(list(test_wells)).at_ring(0).of(cube) if test_wells else cube.limit(0)
    scored = predict(with_features(test, traces, chosen, shape), names, model, "predicted")
    return filled, error_metrics(scored, "phi", "predicted", "well_id")


def with_rings(cube: DataFrame, wells: Sequence[Well], first: int, rings: Sequence[DataFrame], state: int = State.EMPTY) -> DataFrame:
    """The cube after rings `first`, `first` + 1, ... have been filled with the points of `rings`.

    Which points those are is a closed form, so the cube is not joined and not written again: the filled ones are
    filtered out where it is read, and the rings are appended.
    """
    if not rings:
        return cube.select(*COLUMNS)
    out = cube
    for k in range(len(rings)):
        gone = (F.col("real") == int(state)) & (owner(wells, min(1, first + k))["ring"] == first + k)
        out = out.where(~F.coalesce(gone, F.lit(False)))
    out = out.select(*COLUMNS)
    for ring in rings:
        out = out.unionByName(ring.select(*COLUMNS))
    return out


def replay(
    cube: DataFrame, traces: DataFrame, wells: Sequence[Well], test_wells: Sequence[int], sets: Sequence[Sequence[Chosen]], shape: tuple[int, int, int],
    start: int = 1, p: gbdt.Params = gbdt.Params(), sample: Sampling | None = None,
) -> DataFrame:
    """The cube after one ring per feature set, for known sets, trained as in propagate_ring. Each ring is written once."""
    train = [w for w in wells if w[0] not in test_wells]
    rings: list[DataFrame] = []
    now = cube
    for i, chosen in enumerate(sets):
        rings.append(cut(propagate_ring(now, traces, wells, test_wells, chosen, shape, start + i, p, sample=sample)[0]))
        now = with_rings(cube, train, start, rings)
    return now


def canal_errors(
    cube: DataFrame, traces: DataFrame, wells: Sequence[Well], chosen: Sequence[Chosen], shape: tuple[int, int, int], rings: Sequence[int], model: gbdt.Model,
) -> DataFrame:
    """ring, rmse, mae, n of a model on canal points, whose truth is known, by the ring that reaches them; every
    displacement is from the point itself, values stay in the order of the chosen features."""
    names = [f"f{i}" for i in range(len(chosen))]
    canal = assign_rings(cube.drop("ring", "well_id").where(F.col("real") == int(State.CANAL)), wells).where(F.col("ring").isin(*rings))
    e = predict(with_features(canal, traces, chosen, shape), names, model, "predicted").withColumn("e", F.col("predicted") - F.col("phi"))
    return e.groupBy("ring").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.count(F.lit(1)).alias("n"))


def save_model(spark: SparkSession, model: gbdt.Model, chosen: Sequence[Chosen], path: str, it: int) -> None:
    """The model of iteration `it` and the features it takes, as one row under `path`; written again it is replaced."""
    row = (it, model.dumps(), [(f, *d) for f, d in chosen])
    kinds = "it int, model string, chosen array<struct<feature:string,dx:int,dy:int,dz:int>>"
    spark.createDataFrame([row], kinds).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("it").parquet(path)


def load_model(spark: SparkSession, path: str, it: int | None = None) -> tuple[gbdt.Model, list[Chosen]]:
    """The saved model of iteration `it`, or of the last one saved, with its features."""
    m = spark.read.parquet(path)
    r = (m if it is None else m.where(F.col("it") == it)).orderBy(F.desc("it")).first()
    if r is None:
        raise LookupError(f"no model of iteration {it} in {path}")
    return gbdt.Model.loads(r["model"]), [(c["feature"], (c["dx"], c["dy"], c["dz"])) for c in r["chosen"]]


def against_key(predicted: DataFrame, key: DataFrame) -> DataFrame:
    """x, y, z, phi, key_phi, diff of predicted points against an answer key; a point missing there counts as 0."""
    k = key.groupBy("x", "y", "z").agg(F.min("phi").alias("k"))
    j = predicted.join(k, ["x", "y", "z"], "left").withColumn("key_phi", F.coalesce("k", F.lit(0.0)))
    return j.select("x", "y", "z", "phi", "key_phi", (F.col("phi") - F.col("key_phi")).alias("diff"))

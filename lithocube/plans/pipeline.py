"""A whole run: per iteration, select features on what is known, predict the next ring, append it.

python -m lithocube.plans.pipeline --config run.yaml --cube DIR --features DIR [--it N --nits N --nf N --ntf N ...]
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from lithocube.operators.cube import COLUMNS, summary, write_ring
from lithocube.operators.lookup import candidates
from lithocube.operators.predicates import SELECTION
from lithocube.operators.propagate import against_key, load_model, propagate_ring, replay, ring_model, save_model, with_rings
from lithocube.operators.sampling import last_rings, sampled
from lithocube.operators.selection import Chosen, forward_selection
from lithocube.operators.stencil import cube_shape
from lithocube.plans.config import Config, Save, Selection, load
from lithocube.session import cut, ship
from lithocube.sources.io import read_feature_sets


@dataclass
class Iteration:
    it: int
    chosen: list[Chosen]
    errors: list[dict] = field(default_factory=list)
    points: int = 0
    seconds: float = 0.0
    #: Why the run ended with this iteration, if it did.
    ended: str | None = None


def due(c: Config, it: int, last: int) -> bool:
    """Whether the model of iteration `it` is saved, `last` being the run's last one."""
    if c.save_models_on is Save.LAST:
        return it == last
    if c.save_models_on is Save.EVERY_N:
        return it % (c.save_every or 1) == 0
    return c.save_models_on is Save.ALL or it in c.save_list


def run(cube: DataFrame, traces: DataFrame, c: Config, path: str | None = None, models: str | None = None) -> tuple[DataFrame, list[Iteration]]:
    """The cube after the run's iterations, and what each did.

    With `path` every ring is written there as a partition, so a run goes on from the last ring written; the cube itself
    is never written again. Selection uses the training wells' points of the rings before (of the last so many, and a
    sample, by the settings); the ring's model all known points, or a sample if the settings have max_points. With
    `models` the models that the settings ask for are saved there (the last one whenever the run ends, if only the last
    is asked for). An iteration that can choose nothing, or fill nothing, ends the run, with its reason in `ended`.
    """
    spark = cube.sparkSession
    ship(spark)
    shape = cube_shape(traces)
    ids = [w for w, _, _ in c.train_wells]
    aside = [*c.test_only_wells, *c.validation_only_wells]
    done: list[Iteration] = []
    began = time.time()
    rings: list[DataFrame] = []
    first, now, last = (c.it - 1) * c.layers_to_predict + 1, cube, c.it + c.num_its - 1
    model, chosen = None, []
    for it in range(c.it, last + 1):
        if 0 < c.max_exec_time < time.time() - began:
            if done:
                done[-1].ended = "time is over"
            break
        start = time.time()
        known = cut(sampled(last_rings(SELECTION.wells(ids).of(now), it, c.sampling.layers), c.sampling))
        chunks = c.n_training_chunks if c.max_points_per_chunk < 0 else max(c.n_training_chunks, -(-known.count() // c.max_points_per_chunk))
        if c.feature_selection is Selection.FORWARD:
            picked, _ = forward_selection(known, traces, c.window, shape, c.max_num_features, c.params, c.first_candidates, c.only_z, chunks, c.first_features)
        else:
            listed = candidates(traces.select("feature"), 0, first_features=c.max_num_features).orderBy("feature").limit(c.max_num_features).collect()
            picked = [(r["feature"], (0, 0, 0)) for r in listed]
        if not picked:
            done.append(Iteration(it, [], seconds=time.time() - start, ended="no candidate could be trained: two wells with real points are needed"))
            break
        chosen, errors, n = picked, [], 0
        for ring in range((it - 1) * c.layers_to_predict + 1, it * c.layers_to_predict + 1):
            model = ring_model(now, traces, aside, chosen, shape, ring, c.params, c.sampling)
            filled, metrics = propagate_ring(now, traces, c.wells, aside, chosen, shape, ring, c.params, model=model)
            filled = cut(filled)
            n += filled.count()
            errors = [r.asDict() for r in metrics.collect()]
            if path:
                write_ring(filled, path)
            rings.append(filled)
            now = with_rings(cube, c.train_wells, first, rings)
        done.append(Iteration(it, chosen, errors, n, time.time() - start, None if n else "nothing left to fill"))
        if models and (due(c, it, last) or (not n and c.save_models_on is Save.LAST)):
            save_model(spark, model, chosen, models, it)
        if c.output_path and c.save_cube_every > 0 and it % c.save_cube_every == 0:
            now.write.mode("overwrite").parquet(f"{c.output_path.rstrip('/')}/it={it}")
        if not n:
            break
    return now, done


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(description="fill a porosity cube ring by ring")
    a.add_argument("--config", required=True)
    a.add_argument("--cube", required=True, help="Parquet cube, partitioned by ring")
    a.add_argument("--features", required=True, help="Parquet traces, partitioned by feature")
    a.add_argument("--it", type=int), a.add_argument("--nits", type=int), a.add_argument("--nf", type=int), a.add_argument("--nsf", type=int)
    a.add_argument("--ntf", type=int), a.add_argument("--tr-chunk", type=int), a.add_argument("--max-points", type=int), a.add_argument("--layers", type=int)
    a.add_argument("--models", help="folder for saved models"), a.add_argument("--max-time", type=float), a.add_argument("--seed", type=int)
    a.add_argument("--sets", help="file of feature sets: propagate with them, select nothing"), a.add_argument("--with-model", type=int, help="propagate with the saved model of this iteration")
    a.add_argument("--key", help="Parquet point list to hold the result against"), a.add_argument("--output", help="Parquet folder for the whole cube at the end")
    a.add_argument("--only-z", action="store_true"), a.add_argument("--info", action="store_true", help="report on the cube and end")
    return a


def main(argv: list[str] | None = None) -> None:
    g = arguments().parse_args(argv)
    c = load(g.config)
    for name, v in (("it", g.it), ("num_its", g.nits), ("first_features", g.nf), ("max_num_features", g.nsf), ("first_candidates", g.ntf), ("n_training_chunks", g.tr_chunk)):
        if v is not None:
            setattr(c, name, v)
    if g.max_points is not None:
        c.sampling.max_points = g.max_points
    if g.layers is not None:
        c.sampling.layers = g.layers
    c.only_z = g.only_z
    if g.max_time is not None:
        c.max_exec_time = g.max_time
    if g.seed is not None:
        c.sampling.seed = g.seed
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    cube, traces = spark.read.parquet(g.cube).select(*COLUMNS), spark.read.parquet(g.features)
    if g.info:
        summary(cube).orderBy("kind", "key").show(1000, False)
        return
    aside = [*c.test_only_wells, *c.validation_only_wells]
    if g.sets:
        rows = read_feature_sets(spark, g.sets).orderBy("set", "rank").collect()
        sets = [[(r["feature"], (r["dx"], r["dy"], r["dz"])) for r in rows if r["set"] == s] for s in sorted({r["set"] for r in rows})]
        now = replay(cube, traces, c.wells, aside, sets[: c.num_its], cube_shape(traces), c.it, c.params, c.sampling)
    elif g.with_model is not None:
        model, chosen = load_model(spark, g.models, g.with_model)
        filled, _ = propagate_ring(cube, traces, c.wells, aside, chosen, cube_shape(traces), c.it, c.params, model=model)
        now = with_rings(cube, c.train_wells, c.it, [cut(filled)])
    else:
        now, done = run(cube, traces, c, g.cube, g.models)
        for i in done:
            print(f"[it{i.it}] {i.chosen} points {i.points} errors {i.errors} seconds {i.seconds:.2f}{f' ended: {i.ended}' if i.ended else ''}")
    if g.key:
        against_key(now.where("ring >= 0").select("x", "y", "z", "phi"), spark.read.parquet(g.key)).selectExpr("sqrt(avg(diff * diff)) as rmse", "avg(abs(diff)) as mae", "count(1) as n").show()
    if g.output:
        now.write.mode("overwrite").parquet(g.output)


if __name__ == "__main__":
    main()

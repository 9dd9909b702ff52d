"""Queries of the cube, log, attribute, geometry and modelling operators, each with the SQL that says the same.

Names begin with the operator's number in the inventory. Queries without SQL are iterative or numerical (eigenvalues,
Fourier transforms, boosting) and are tested against brute force.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.functions import curvature, scalars
from lithocube.operators import attributes, compare, cube as cubes, gbdt, geometry, logs, lookup, predicates, propagate, sampling, selection, stats, stencil
from lithocube.operators.missing import FIELDS, is_missing
from lithocube.plans.fixtures import CUBE, FILLED, NX, NZ, OWN, PREDICTIONS, SHAPE, STATE, TEST, TRAIN, WELL_ROWS, WELLS, WITH_STATE
from lithocube.plans.fixtures import cube as cube_of
from lithocube.plans.fixtures import predictions, state, traces
from lithocube.plans.problem_queries import _missing
from lithocube.plans.registry import query
from lithocube.session import cut, read, shared_dir, small
from lithocube.sources import io
from lithocube.sources.io import run_metrics
from lithocube.streaming import progress

# Rounded so that the order of a sum does not show, and minus zero is zero. Means of decimal numbers are shifted off the
# ties of rounding first.
r6 = lambda c: F.round(c, 6) + F.lit(0.0)
r5 = lambda c: F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 5)
WITH_CUBE = f"WITH {CUBE}, {SHAPE} "
STATE_COLUMNS = "x, y, z, phi, real, ring, well_id"


def _state_query(name: str, where: str, take) -> None:
    @query(name, f"{WITH_STATE} SELECT {STATE_COLUMNS} FROM state WHERE {where}")
    def q(spark: SparkSession, d: str) -> DataFrame:
        return take(state(spark, d))


# Sources and shapes.


@query("s3_empty_cube", "SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(0 AS DOUBLE) AS phi, 5 AS real, -1 AS ring, -1 AS well_id FROM range(20) a(x), range(25) b(y), range(64) c(z)")
def s3(spark, d):
    return cubes.empty_cube(spark, geometry.Box(20, 25, 64))


@query("s8_cube_shape", f"{WITH_CUBE} SELECT nx, ny, nz FROM shape")
def s8(spark, d):
    return traces(spark, d).agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"), F.max(F.size("amp")).alias("nz"))


@query("s23_well_columns", f"{WITH_STATE} SELECT w.well_id, s.x, s.y, s.z, s.phi FROM state s JOIN wells w ON s.x = w.wx AND s.y = w.wy")
def s23(spark, d):
    w = spark.createDataFrame(WELLS, "well_id int, x int, y int")
    return state(spark, d).drop("well_id").join(small(w), ["x", "y"]).select("well_id", "x", "y", "z", "phi")


_RUN = "'[1,0]<stdout>:[manager] [it' || iteration || '] Iteration best features: [' || features || '] with errors: MAE ' || mae || ' RMSE ' || rmse"


@query("s24_run_metrics", "SELECT DISTINCT iteration, '[' || features || ']' AS features, mae, rmse FROM expected_errors WHERE features IS NOT NULL AND mae IS NOT NULL AND rmse IS NOT NULL AND NOT isnan(mae) AND NOT isnan(rmse)")
def s24(spark, d):
    e = read(spark, d, "expected_errors").where("features is not null and mae is not null and rmse is not null and not isnan(mae) and not isnan(rmse)")
    return run_metrics(e.select(F.expr(_RUN).alias("value")), "expected")


@query("s17_feature_sets", r"""SELECT config_name, iteration, CAST(i - 1 AS INTEGER) AS rank, split_part(f, ' ', 1) AS feature, CAST(split_part(f, ' ', 2) AS INTEGER) AS dx,
  CAST(split_part(f, ' ', 3) AS INTEGER) AS dy, CAST(split_part(f, ' ', 4) AS INTEGER) AS dz
  FROM (SELECT DISTINCT config_name, iteration, features, unnest(string_split(features, ', ')) AS f, generate_subscripts(string_split(features, ', '), 1) AS i FROM expected_errors WHERE features IS NOT NULL)""")
def s17(spark, d):
    e = read(spark, d, "expected_errors").where("features is not null").select("config_name", "iteration", "features").distinct()
    p = e.select("config_name", "iteration", F.posexplode(F.split("features", ", ")).alias("rank", "f"))
    t = F.split("f", " ")
    return p.select("config_name", "iteration", "rank", F.get(t, F.lit(0)).alias("feature"), *[F.get(t, F.lit(i)).cast("int").alias(n) for i, n in ((1, "dx"), (2, "dy"), (3, "dz"))])


# Predicates.

P = predicates.Points()
_state_query("f3_min_ring", "ring >= 2", lambda c: P.from_ring(2).of(c))
_state_query("f4_in_wells", "well_id IN (0, 3)", lambda c: P.wells([0, 3]).of(c))
_state_query("f5_not_in_wells", "well_id NOT IN (0, 3)", lambda c: P.without_wells([0, 3]).of(c))
_state_query("f6_at_coords", "(x, y) IN ((4, 5), (8, 15))", lambda c: P.at_coords([(4, 5), (8, 15)]).of(c))
_state_query("f7_prediction_points", "real IN (0, 1)", lambda c: predicates.PREDICTION.of(c))
_state_query("f8_selection_points", "real IN (0, 3, 1)", lambda c: predicates.SELECTION.of(c))
_state_query("f10_wells_at_ring", "well_id IN (0, 1) AND ring = 3", lambda c: P.wells([0, 1]).at_ring(2).at_ring(3).of(c))
_state_query("f12_validation_points", "real = 0 AND well_id = 1", lambda c: predicates.VALIDATION.wells([1]).of(c))
_state_query("f15_area", "x BETWEEN 3 AND 12 AND y BETWEEN 4 AND 15", lambda c: predicates.inside_area(c, 3, 12, 4, 15))
_state_query("f22_area_half_open", "x >= 3 AND x < 12 AND y >= 4 AND y < 15", lambda c: predicates.inside_area(c, 3, 12, 4, 15, half_open=True))
_state_query("d7_last_rings", "ring >= 2 AND ring < 4", lambda c: sampling.last_rings(c, 4, 2))
_state_query("f1_all_points", "true", lambda c: P.of(c))


@query("f2_counts", f"{WITH_STATE} SELECT count(*) AS n FROM state WHERE ring >= 1 AND well_id IN (0, 2)")
def f2(spark, d):
    return P.from_ring(1).wells([0, 2]).count(state(spark, d))


@query("f13_leave_one_out", f"""{WITH_STATE} SELECT fold, fold = well_id AS is_val, count(*) AS n FROM state, (VALUES (-1), (0), (1), (2)) f(fold)
  WHERE well_id IN (0, 1, 2) AND (fold <> well_id OR real = 0) GROUP BY ALL""")
def f13(spark, d):
    return predicates.leave_one_out(state(spark, d), [0, 1, 2]).groupBy("fold", "is_val").agg(F.count(F.lit(1)).alias("n"))


@query("f16_well_slices", f"WITH {CUBE}, {WELL_ROWS} SELECT well_id, x, y, z * 5 AS z, amp FROM embeddings_cube JOIN wells ON x = wx AND y = wy WHERE z BETWEEN 42 // 5 AND 198 // 5")
def f16(spark, d):
    w = spark.createDataFrame(WELLS, "well_id int, x int, y int")
    part = F.slice("amp", 42 // 5 + 1, 198 // 5 - 42 // 5 + 1)
    t = traces(spark, d).join(small(w), ["x", "y"]).select("well_id", "x", "y", F.posexplode(part).alias("k", "amp"))
    return t.select("well_id", "x", "y", ((F.col("k") + 42 // 5) * 5).alias("z"), "amp")


@query("f17_depth_interval", "SELECT DISTINCT log_id, depth FROM well_logs WHERE depth BETWEEN 2500 AND 2600")
def f17(spark, d):
    return logs.between_depths(read(spark, d, "well_logs").select("log_id", "depth"), 2500, 2600).distinct()


@query("f18_after_start", """WITH starts AS (SELECT well_id, min(min_y) / 2.0 + 500 AS start FROM wells_info_completed GROUP BY well_id)
  SELECT DISTINCT log_id, time_ms FROM well_logs LEFT JOIN starts USING (well_id) WHERE time_ms >= coalesce(start, 2000)""")
def f18(spark, d):
    starts = read(spark, d, "wells_info_completed").select("well_id", (F.col("min_y") / 2.0 + 500).alias("start"))
    return logs.after_start(read(spark, d, "well_logs").select("log_id", "well_id", "time_ms"), starts, "well_id", "time_ms", 2000.0).select("log_id", "time_ms").distinct()


@query("f19_depth_window", f"WITH {CUBE} SELECT x, y, z, CAST(z * 5.0 + 1000 AS DOUBLE) AS depth, amp FROM embeddings_cube WHERE z BETWEEN 10 AND 31")
def f19(spark, d):
    return logs.window_slice(traces(spark, d), 1052.0, 1153.0, 1000.0, 5.0, NZ)


@query("f20_drop_missing", f"SELECT DISTINCT log_id, density_por FROM well_logs WHERE NOT {_missing('density_por')}")
def f20(spark, d):
    return read(spark, d, "well_logs").where(~is_missing(F.col("density_por"))).select("log_id", "density_por").distinct()


@query("f21_depth_multiple", "SELECT DISTINCT log_id, depth FROM well_logs WHERE depth % 5 = 0")
def f21(spark, d):
    return logs.every_nth_depth(read(spark, d, "well_logs").select("log_id", "depth"), 5.0).distinct()


@query("f23_labels", f"{WITH_STATE} SELECT x, y, CASE WHEN min(well_id) IN (0, 1, 2) THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM state WHERE ring = 0 GROUP BY x, y")
def f23(spark, d):
    train = spark.createDataFrame(TRAIN, "w int, x int, y int").withColumn("role", F.lit("train"))
    p = P.at_ring(0).of(state(spark, d)).join(small(train), ["x", "y"], "left")
    return p.groupBy("x", "y", F.coalesce("role", F.lit("test")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("f24_iterations", "SELECT DISTINCT config_name, iteration, seconds FROM iteration_times WHERE iteration <= 10 AND NOT isnan(seconds)")
def f24(spark, d):
    return read(spark, d, "iteration_times").where("iteration <= 10 and seconds is not null and not isnan(seconds)").distinct()


@query("f25_well_or_canal", f"WITH {CUBE}, {WELL_ROWS} SELECT x, y, z, coalesce(w.well_id, -1) AS well_id, CASE WHEN w.well_id IS NULL THEN 2 ELSE 0 END AS real FROM embeddings_cube LEFT JOIN wells w ON x = wx AND y = wy")
def f25(spark, d):
    w = spark.createDataFrame(WELLS, "w int, x int, y int")
    p = cube_of(spark, d).join(small(w), ["x", "y"], "left")
    return p.select("x", "y", "z", F.coalesce("w", F.lit(-1)).alias("well_id"), F.when(F.col("w").isNull(), 2).otherwise(0).alias("real"))


# Joins.

_CLAMP = "least(greatest({0}, 0), {1} - 1)"


def _look(dx: int, dy: int, dz: int, name: str) -> str:
    return (f"JOIN embeddings_cube {name} ON {name}.x = {_CLAMP.format(f's.x + {dx}', 'nx')} AND {name}.y = {_CLAMP.format(f's.y + {dy}', 'ny')} "
            f"AND {name}.z = {_CLAMP.format(f's.z + {dz}', 'nz')}")


@query("j1_displaced_lookup", f"{WITH_STATE}, {SHAPE} SELECT s.x, s.y, s.z, a.amp AS f0 FROM state s, shape {_look(1, -2, 3, 'a')} WHERE s.real = 0")
def j1(spark, d):
    t = traces(spark, d)
    p = P.of_state(0).of(state(spark, d)).select("x", "y", "z")
    return lookup.displaced(p, t, 1, -2, 3, stencil.cube_shape(t))


_CHOSEN = [("amp", (1, -2, 3)), ("amp", (0, 3, -1)), ("amp", (1, -2, -3))]


@query("j2_feature_columns", f"""{WITH_STATE}, {SHAPE} SELECT s.x, s.y, s.z, a.amp AS f0, b.amp AS f1, c.amp AS f2 FROM state s, shape
  {_look(1, -2, 3, 'a')} {_look(0, 3, -1, 'b')} {_look(1, -2, -3, 'c')} WHERE s.ring >= 0""")
def j2(spark, d):
    t = traces(spark, d)
    p = P.from_ring(0).of(state(spark, d)).select("x", "y", "z")
    return lookup.with_features(p, t.withColumn("feature", F.lit("amp")), _CHOSEN, stencil.cube_shape(t))


@query("j14_minicube", f"""{WITH_STATE}, {SHAPE} SELECT s.x, s.y, s.z, CAST(count(*) AS INTEGER) AS n, round(sum(a.amp * (9 * (dx + 1) + 3 * (dy + 1) + dz + 2)), 6) + 0.0 AS weighted FROM state s, shape, range(-1, 2) p(dx), range(-1, 2) q(dy), range(-1, 2) r(dz)
  JOIN embeddings_cube a ON a.x = {_CLAMP.format('s.x + dx', 'nx')} AND a.y = {_CLAMP.format('s.y + dy', 'ny')} AND a.z = {_CLAMP.format('s.z + dz', 'nz')}
  WHERE s.real = 0 GROUP BY ALL""")
def j14(spark, d):
    t = traces(spark, d)
    m = lookup.minicube(P.of_state(0).of(state(spark, d)), t, 1, stencil.cube_shape(t))
    weighted = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return m.select("x", "y", "z", F.size("values").alias("n"), r6(weighted).alias("weighted"))


@query("j3_answer_key", f"WITH {PREDICTIONS} SELECT x, y, z, a.phi, coalesce(b.phi, 0) AS key_phi, a.phi - coalesce(b.phi, 0) AS diff FROM pred_a a LEFT JOIN pred_b b USING (x, y, z)")
def j3(spark, d):
    return propagate.against_key(*predictions(spark, d))


@query("j4_left_only", f"WITH {PREDICTIONS} SELECT * FROM pred_a ANTI JOIN pred_b USING (x, y, z)")
def j4(spark, d):
    return compare.left_compare(*predictions(spark, d))[0]


@query("j5_full_compare", f"""WITH {PREDICTIONS} SELECT x, y, z, a.phi AS phi_x, b.phi AS phi_y,
  CASE WHEN b.phi IS NULL THEN 'left_only' WHEN a.phi IS NULL THEN 'right_only' ELSE 'both' END AS merge FROM pred_a a FULL JOIN pred_b b USING (x, y, z)""")
def j5(spark, d):
    return compare.full_compare(*predictions(spark, d))


@query("j6_intersection", f"WITH {PREDICTIONS} SELECT x, y, z, a.phi AS phi_x, b.phi AS phi_y FROM pred_a a JOIN pred_b b USING (x, y, z)")
def j6(spark, d):
    return compare.intersection(*predictions(spark, d))


@query("j7_errors", f"WITH {PREDICTIONS} SELECT round(sqrt(avg((a.phi - b.phi) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(a.phi - b.phi)), 6) + 0.0 AS mae, count(b.phi) AS n FROM pred_a a LEFT JOIN pred_b b USING (x, y, z)")
def j7(spark, d):
    e = compare.checked_errors(*predictions(spark, d), strict=False)
    return e.select(r6("rmse").alias("rmse"), r6("mae").alias("mae"), "n")


@query("j8_log_with_wells", """SELECT run_id, l.well_id, x_coord, y_coord, count(DISTINCT log_id) AS n FROM well_logs l JOIN (SELECT DISTINCT well_id, x_coord, y_coord FROM wells_info_completed) w ON l.well_id = w.well_id GROUP BY ALL""")
def j8(spark, d):
    w = read(spark, d, "wells_info_completed").select("well_id", "x_coord", "y_coord").distinct()
    l = read(spark, d, "well_logs").select("run_id", "well_id", "log_id")
    per_run = l.groupBy("run_id", "well_id").agg(F.countDistinct("log_id").alias("n"))
    return per_run.join(small(w), "well_id").groupBy("run_id", "well_id", "x_coord", "y_coord").agg(F.sum("n").alias("n"))


@query("j9_wells_in_areas", """SELECT well_id, area, x_coord - min_x AS area_x, y_coord - min_y AS area_y FROM (SELECT DISTINCT well_id, x_coord, y_coord FROM wells_info_completed)
  JOIN areas_coords a ON x_coord BETWEEN min_x AND a.max_x AND y_coord BETWEEN a.min_y AND a.max_y""")
def j9(spark, d):
    w = read(spark, d, "wells_info_completed").select("well_id", "x_coord", "y_coord").distinct()
    return logs.wells_in_areas(w, read(spark, d, "areas_coords"))


@query("j10_first_area", """SELECT well_id, arg_min(area, area_id) AS area FROM (SELECT DISTINCT well_id, x_coord, y_coord FROM wells_info_completed) w
  LEFT JOIN areas_coords a ON x_coord BETWEEN a.min_x AND a.max_x AND y_coord BETWEEN a.min_y AND a.max_y GROUP BY well_id""")
def j10(spark, d):
    w = read(spark, d, "wells_info_completed").select("well_id", "x_coord", "y_coord").distinct()
    return logs.first_area(w, read(spark, d, "areas_coords"))


@query("j12_merge_with_traces", f"""WITH {CUBE}, log AS (SELECT log_id, CAST(run_id % 20 AS INTEGER) AS x, CAST(run_id % 5 AS INTEGER) AS y, depth, min(depth) OVER (PARTITION BY run_id) AS start
    FROM (SELECT DISTINCT log_id, run_id, depth FROM well_logs WHERE depth IS NOT NULL)),
  placed AS (SELECT *, CAST(floor(depth / 2.0) - floor(start / 2.0) AS INTEGER) AS i FROM log)
  SELECT log_id, depth, amp FROM placed LEFT JOIN embeddings_cube e ON e.x = placed.x AND e.y = placed.y AND e.z = i""")
def j12(spark, d):
    l = read(spark, d, "well_logs").where("depth is not null").select("log_id", "run_id", "depth").distinct()
    starts = l.groupBy("run_id").agg(F.min("depth").alias("start"))
    l = l.join(starts, "run_id").select("log_id", F.pmod("run_id", F.lit(20)).cast("int").alias("x"), F.pmod("run_id", F.lit(5)).cast("int").alias("y"), "depth", "start")
    return logs.merge_with_traces(l, traces(spark, d), 2.0).select("log_id", "depth", "amp")


@query("j13_well_of_points", """SELECT point_id, min(well_id) AS well_id FROM (SELECT DISTINCT point_id, CAST(round(x) AS BIGINT) AS sx, CAST(round(y) AS BIGINT) AS sy FROM por_test WHERE NOT isnan(x) AND NOT isnan(y))
  JOIN wells_info_completed ON x_coord = sx AND y_coord = sy GROUP BY point_id""")
def j13(spark, d):
    p = read(spark, d, "por_test").where("not isnan(x) and not isnan(y)").select("point_id", F.round("x").cast("long").alias("sx"), F.round("y").cast("long").alias("sy")).distinct()
    w = read(spark, d, "wells_info_completed").where("x_coord is not null and y_coord is not null").groupBy(F.col("x_coord").cast("long").alias("sx"), F.col("y_coord").cast("long").alias("sy")).agg(F.min("well_id").alias("well_id"))
    return p.join(w, ["sx", "sy"]).groupBy("point_id").agg(F.min("well_id").alias("well_id"))


_PLACED = "placed AS (SELECT DISTINCT well_id, x_coord AS x, y_coord AS y FROM wells_info_completed WHERE x_coord >= 0 AND y_coord >= 0), box AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny FROM placed)"
_OVERLAP = "least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1", "least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1"


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, geometry.Box]:
    """All wells of known place, and the box that holds them."""
    w = read(spark, d, "wells_info_completed").where("x_coord >= 0 and y_coord >= 0").select("well_id", F.col("x_coord").alias("x"), F.col("y_coord").alias("y")).distinct()
    nx, ny = w.agg(F.max("x"), F.max("y")).first()
    return w, geometry.Box((nx or 0) + 1, (ny or 0) + 1, NZ)


@query("j16_well_overlaps", f"""WITH {_PLACED}, squares AS (SELECT well_id, greatest(x - 5, 0) AS x0, least(x + 5, nx - 1) AS x1, greatest(y - 5, 0) AS y0, least(y + 5, ny - 1) AS y1 FROM placed, box)
  SELECT a.well_id AS a, b.well_id AS b, {_OVERLAP[0]} AS width, {_OVERLAP[1]} AS height FROM squares a JOIN squares b ON a.well_id < b.well_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 WHERE a.y0 <= b.y1 AND b.y0 <= a.y1""")
def j16(spark, d):
    w, box = _placed(spark, d)
    return geometry.overlaps(geometry.extents(w, box, F.lit(5)), box).select("a", "b", "width", "height")


@query("j17_tiles_of_rings", f"""WITH {CUBE}, tiles AS (SELECT DISTINCT x // 5 AS tx, y // 5 AS ty FROM embeddings_cube), w(w, wx, wy) AS (VALUES (0, 4, 5), (1, 12, 10), (2, 17, 20))
  SELECT DISTINCT tx, ty FROM tiles, w WHERE greatest(0, tx * 5 - wx, wx - tx * 5 - 4, ty * 5 - wy, wy - ty * 5 - 4) <= 7
    AND greatest(abs(tx * 5 - wx), abs(tx * 5 + 4 - wx), abs(ty * 5 - wy), abs(ty * 5 + 4 - wy)) >= 6""")
def j17(spark, d):
    t = traces(spark, d).select(F.floor(F.col("x") / 5).cast("int").alias("tx"), F.floor(F.col("y") / 5).cast("int").alias("ty")).distinct()
    return t.where(geometry.touches(TRAIN, 6, 7, 5))


@query("j18_wells_without_log", "SELECT DISTINCT well_id, well FROM wells_info_completed WHERE well_id NOT IN (SELECT well_id FROM well_logs WHERE well_id IS NOT NULL)")
def j18(spark, d):
    w = read(spark, d, "wells_info_completed").select("well_id", "well").distinct()
    return w.join(read(spark, d, "well_logs").select("well_id"), "well_id", "left_anti")


# Aggregations.


@query("a1_counts_by_state", f"{WITH_STATE} SELECT real, count(*) AS n FROM state GROUP BY real")
def a1(spark, d):
    return state(spark, d).groupBy("real").agg(F.count(F.lit(1)).alias("n"))


@query("a2_cube_summary", f"""{WITH_STATE} SELECT kind, key, points, round(points / (SELECT count(*) FROM state), 6) + 0.0 AS share FROM (
    SELECT 'state' AS kind, real AS key, count(*) AS points FROM state GROUP BY real UNION ALL SELECT 'ring', ring, count(*) FROM state GROUP BY ring
    UNION ALL SELECT 'well', well_id, count(*) FROM state GROUP BY well_id UNION ALL SELECT 'all', NULL, count(*) FROM state)""")
def a2(spark, d):
    return cubes.summary(state(spark, d)).withColumn("share", r6("share"))


@query("a3_sum_of_points", f"{WITH_STATE} SELECT round(sum(phi), 6) + 0.0 AS total, count(*) AS n FROM state")
def a3(spark, d):
    return state(spark, d).agg(r6(F.sum("phi")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("a5_errors", f"""{WITH_STATE} SELECT well_id, round(sqrt(avg((phi - z) ** 2)), 6) + 0.0 AS rmse, round(avg(abs(phi - z)), 6) + 0.0 AS mae, count(*) AS n FROM state WHERE ring >= 0 GROUP BY GROUPING SETS ((well_id), ())""")
def a5(spark, d):
    e = compare.error_metrics(P.from_ring(0).of(state(spark, d)).withColumn("p", F.col("z").cast("double")), "phi", "p")
    return e.select("well_id", r6("rmse").alias("rmse"), r6("mae").alias("mae"), "n")


@query("a7_mean_of_folds", f"""{WITH_STATE} SELECT round(avg(rmse), 6) + 0.0 AS rmse, round(avg(mae), 6) + 0.0 AS mae, count(*) AS folds FROM (
  SELECT well_id, sqrt(avg((phi - z) ** 2)) AS rmse, avg(abs(phi - z)) AS mae FROM state WHERE ring >= 0 GROUP BY well_id)""")
def a7(spark, d):
    m = compare.mean_of_folds(compare.error_metrics(P.from_ring(0).of(state(spark, d)).withColumn("p", F.col("z").cast("double")), "phi", "p"))
    return m.select(r6("rmse").alias("rmse"), r6("mae").alias("mae"), "folds")


_CLEAN = "clean AS (SELECT log_id, any_value(run_id) AS run_id, any_value(campaign) AS campaign, any_value(depth) AS depth, any_value(density_por) AS por FROM well_logs WHERE depth IS NOT NULL AND NOT " + _missing("density_por") + " GROUP BY log_id)"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    """Readings with depth and density_por, each once; repeats of a reading are equal."""
    l = read(spark, d, "well_logs").where(F.col("depth").isNotNull() & ~is_missing(F.col("density_por")))
    return l.select("log_id", "run_id", "campaign", "depth", F.col("density_por").alias("por")).dropDuplicates(["log_id"])


@query("a8_mean_n_metres", f"""WITH {_CLEAN} SELECT run_id, CAST(floor(depth / n_meters) AS BIGINT) AS step, round(avg(depth) + 1e-7, 5) AS depth, round(avg(por) + 1e-7, 5) AS por
  FROM clean JOIN aggregation_params USING (campaign) GROUP BY run_id, step""")
def a8(spark, d):
    l = _clean(spark, d).join(small(read(spark, d, "aggregation_params")), "campaign")
    m = logs.mean_every(l, ["run_id"], F.col("n_meters"), ["por"])
    return m.select("run_id", "step", r5("depth").alias("depth"), r5("por").alias("por"))


@query("a9_mean_whole_depth", f"WITH {_CLEAN} SELECT run_id, CAST(trunc(depth) AS BIGINT) AS whole_depth, round(avg(por) + 1e-7, 5) AS por FROM clean GROUP BY run_id, whole_depth")
def a9(spark, d):
    return logs.mean_by_whole_depth(_clean(spark, d), ["run_id"], ["por"]).withColumn("por", r5("por"))


@query("a10_value_counts", "SELECT x_coord, y_coord, count(*) AS n FROM wells_info_completed GROUP BY ALL")
def a10(spark, d):
    return logs.value_counts(read(spark, d, "wells_info_completed"), "x_coord", "y_coord")


@query("a11_densest_well", f"WITH {_CLEAN} SELECT run_id, count(*) AS n FROM clean GROUP BY run_id ORDER BY n DESC, run_id LIMIT 1")
def a11(spark, d):
    return logs.densest(_clean(spark, d), "run_id")


@query("a12_ranges", "SELECT run_id, min(depth) AS min_depth, max(depth) AS max_depth, min(time_ms) AS min_time_ms, max(time_ms) AS max_time_ms FROM (SELECT run_id, CASE WHEN NOT isnan(depth) THEN depth END AS depth, CASE WHEN NOT isnan(time_ms) THEN time_ms END AS time_ms FROM well_logs) GROUP BY run_id")
def a12(spark, d):
    return logs.ranges(read(spark, d, "well_logs").select("run_id", "depth", "time_ms"), "run_id", "depth", "time_ms")


@query("a13_distinct_depths", "SELECT DISTINCT z FROM por_test WHERE z IS NOT NULL AND NOT isnan(z)")
def a13(spark, d):
    return read(spark, d, "por_test").where("z is not null and not isnan(z)").select("z").distinct()


@query("a14_ring_sizes", f"{WITH_STATE} SELECT ring, well_id, count(*) AS n FROM state GROUP BY ring, well_id")
def a14(spark, d):
    return state(spark, d).groupBy("ring", "well_id").agg(F.count(F.lit(1)).alias("n"))


@query("a15_total_difference", f"WITH {PREDICTIONS} SELECT round(sum(a.phi - b.phi), 4) + 0.0 AS diff, abs(sum(a.phi - b.phi)) <= 1e-8 AS same FROM pred_a a JOIN pred_b b USING (x, y, z)")
def a15(spark, d):
    return compare.total_difference(*predictions(spark, d)).withColumn("diff", F.round("diff", 4))


_COVER = """cover AS (SELECT x, y, CASE WHEN bool_or(x = wx AND y = wy) THEN 0 ELSE CAST(count_if(greatest(abs(x - wx), abs(y - wy)) <= 6) AS INTEGER) END AS n FROM cols, wells GROUP BY x, y)"""


@query("a16_coverage", f"WITH {CUBE}, {WELL_ROWS}, {OWN}, {_COVER} SELECT x, y, n FROM cover")
def a16(spark, d):
    return geometry.coverage(traces(spark, d), WELLS, 6)


@query("a17_a18_volumes", f"WITH {CUBE}, {WELL_ROWS}, {OWN}, {_COVER} SELECT CAST(count_if(n > 0) * 64 AS BIGINT) AS predicted, CAST(count_if(n > 1) * 64 AS BIGINT) AS overlap FROM cover")
def a17(spark, d):
    v = geometry.covered_volumes(traces(spark, d), WELLS, 6, NZ)
    return v.select(F.col("predicted").cast("long").alias("predicted"), F.col("overlap").cast("long").alias("overlap"))


@query("a19_mean_and_deviation", f"WITH {_CLEAN} SELECT run_id, round(avg(por) + 1e-7, 5) AS mean, round(stddev_samp(por) + 1e-7, 5) AS std, count(*) AS n FROM clean GROUP BY run_id HAVING count(*) > 1")
def a19(spark, d):
    m = stats.mean_and_deviation(_clean(spark, d), "por", "run_id").where("n > 1")
    return m.select("run_id", r5("mean").alias("mean"), r5("std").alias("std"), "n")


@query("a20_histogram", f"WITH {_CLEAN} SELECT least(CAST(floor(por / 100 * 19) AS BIGINT) + 1, 19) AS bin, count(*) AS n FROM clean WHERE por BETWEEN 0 AND 100 GROUP BY bin")
def a20(spark, d):
    return stats.histogram(_clean(spark, d), "por", 0.0, 100.0, 19)


@query("a21_z_statistic", f"""{WITH_STATE} SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) + 0.0 AS z FROM (SELECT avg(phi) AS m, var_pop(phi) AS v, count(*) AS n FROM state WHERE well_id = 0) a, (SELECT avg(phi) AS m, var_pop(phi) AS v, count(*) AS n FROM state WHERE well_id = 3) b""")
def a21(spark, d):
    c = state(spark, d)
    return stats.z_statistic(c.where("well_id = 0"), c.where("well_id = 3"), "phi").select(r6("z").alias("z"))


@query("a21_bootstrap")
def a21b(spark, d):
    c = P.from_ring(0).of(state(spark, d)).withColumn("train", ~F.col("well_id").isin(*TEST)).withColumn("key", scalars.linear_index(F.col("x"), F.col("y"), F.col("z"), 1000, NZ))
    return stats.bootstrap_z(c, "phi", "train", "key", n=50, reps=100)


@query("a22_extremes", "SELECT max(greatest(rmse, mae)) AS most, min(least(rmse, mae)) AS least FROM expected_errors WHERE NOT isnan(rmse) AND NOT isnan(mae)")
def a22(spark, d):
    e = read(spark, d, "expected_errors").where("not isnan(rmse) and not isnan(mae)")
    return e.agg(F.max(F.greatest("rmse", "mae")).alias("most"), F.min(F.least("rmse", "mae")).alias("least"))


@query("a23_feature_ranks", """SELECT prefix, count(*) AS n, list_aggregate(list_sort(list(DISTINCT iteration * 1000 + rank)), 'string_agg', ',') AS ranks FROM (
  SELECT iteration, split_part(trim(f), '_', 1) AS prefix, i - 1 AS rank FROM (SELECT iteration, unnest(regexp_split_to_array(features, ',\\s*')) AS f, generate_subscripts(regexp_split_to_array(features, ',\\s*'), 1) AS i
  FROM expected_errors WHERE features IS NOT NULL)) GROUP BY prefix""")
def a23(spark, d):
    r = stats.feature_ranks(read(spark, d, "expected_errors"))
    return r.select("prefix", "n", F.array_join(F.transform("ranks", lambda s: (s["iteration"] * 1000 + s["rank"]).cast("string")), ",").alias("ranks"))


_NULLS = ("log_id", "depth", *FIELDS, "area_x")


@query("a24_null_counts", "SELECT " + ", ".join(f"CAST(count_if({c} IS NULL" + ("" if c == "log_id" else f" OR isnan({c})") + f") AS BIGINT) AS {c}" for c in _NULLS) + " FROM well_logs")
def a24(spark, d):
    n = stats.null_counts(read(spark, d, "well_logs").select(*_NULLS))
    return n


@query("a25_explained_variance")
def a25(spark, d):
    t = traces(spark, d)
    p = t.select(*[F.get("amp", F.lit(i)).alias(f"a{i}") for i in range(NZ)])
    return stats.explained_variance(p, p.columns)


@query("a26_points_per_tile", f"{WITH_STATE} SELECT CAST(x // 5 AS BIGINT) AS tx, CAST(y // 5 AS BIGINT) AS ty, CAST(count_if(well_id IN (0, 1, 2)) AS BIGINT) AS train, CAST(count_if(well_id = 3) AS BIGINT) AS test FROM state GROUP BY tx, ty")
def a26(spark, d):
    return stats.points_per_tile(state(spark, d), [0, 1, 2], TEST, 5)


# Windows and stencils.


@query("w1_rolling_mean", f"WITH {_CLEAN} SELECT log_id, round(avg(por) OVER (PARTITION BY run_id ORDER BY depth, log_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + 1e-7, 5) AS por FROM clean")
def w1(spark, d):
    return logs.rolling_mean(_clean(spark, d), ["run_id"], ["depth", "log_id"], 5, ["por"]).select("log_id", r5("por").alias("por"))


_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END"


def _stencil_sql(select: str, window: tuple[int, int, int]) -> str:
    h = [w // 2 for w in window]
    at = [_MIRROR.format(f"(c.{a} + d{a})", f"n{a}") for a in "xyz"]
    steps = ", ".join(f"range({-h[i]}, {window[i] - h[i]}) r{a}(d{a})" for i, a in enumerate("xyz"))
    return f"{WITH_CUBE} SELECT c.x, c.y, CAST(c.z AS BIGINT) AS z, {select} FROM embeddings_cube c, shape, {steps} JOIN embeddings_cube s ON s.x = {at[0]} AND s.y = {at[1]} AND s.z = {at[2]} GROUP BY c.x, c.y, c.z"


for _name, _how, _sql in (("w3_moving_mean", "mean", "avg"), ("w4_moving_sum", "sum", "sum"), ("w5_moving_min", "min", "min"), ("w6_moving_max", "max", "max"), ("w7_moving_median", "median", "median")):

    def _moving(spark, d, how=_how):
        m = stencil.moving_window(traces(spark, d), (3, 3, 3), how)
        return stencil.points(m, "value").select("x", "y", "z", r6("value").alias("value"))

    query(_name, _stencil_sql(f"round({_sql}(s.amp), 6) + 0.0 AS value", (3, 3, 3)))(_moving)


@query("w2_moving_function", _stencil_sql("round(max(s.amp) - min(s.amp), 6) + 0.0 AS value", (3, 3, 1)))
def w2(spark, d):
    m = stencil.moving_window(traces(spark, d), (3, 3, 1), lambda v, axis: v.max(axis=axis) - v.min(axis=axis))
    return stencil.points(m, "value").select("x", "y", "z", r6("value").alias("value"))


@query("w8_rms", _stencil_sql("round(sqrt(greatest(sum(sin(pi() * (dz + 3) / 5) * s.amp * s.amp), 0) / 5), 6) + 0.0 AS value", (1, 1, 5)))
def w8(spark, d):
    t = traces(spark, d)
    m = stencil.on_tiles(t, stencil.cube_shape(t), (0, 0, 2), {"value": stencil.rms_kernel(5)})
    return stencil.points(m, "value").select("x", "y", "z", r6("value").alias("value"))


@query("w12_semblance", f"""{WITH_CUBE}, win AS (SELECT c.x, c.y, c.z, dz, sum(s.amp) AS stack, sum(s.amp * s.amp) AS energy FROM embeddings_cube c, shape, range(-1, 2) rx(dx), range(-1, 2) ry(dy), range(-4, 5) rz(dz)
    JOIN embeddings_cube s ON s.x = {_MIRROR.format('(c.x + dx)', 'nx')} AND s.y = {_MIRROR.format('(c.y + dy)', 'ny')} AND s.z = {_MIRROR.format('(c.z + dz)', 'nz')} GROUP BY c.x, c.y, c.z, dz)
  SELECT x, y, CAST(z AS BIGINT) AS z, round(sum(stack * stack) / sum(energy) / 9, 6) + 0.0 AS value FROM win GROUP BY x, y, z""")
def w12(spark, d):
    t = traces(spark, d)
    m = stencil.on_tiles(t, stencil.cube_shape(t), (1, 1, 4), {"value": attributes.semblance_kernel((3, 3, 9))})
    return stencil.points(m, "value").select("x", "y", "z", r6("value").alias("value"))


def _squared(k: int) -> str:
    """The matrix of the step before times itself, scaled to trace 1: powers of it end at the largest eigenvalue's projector."""
    trace = "list_sum([m[i][i] FOR i IN range(1, 10)])"
    return f"q{k} AS (SELECT x, y, z, c, [[list_dot_product(a, b) FOR b IN n] FOR a IN n] AS m FROM (SELECT x, y, z, c, [[v / t FOR v IN a] FOR a IN m] AS n FROM (SELECT *, {trace} AS t FROM q{k - 1})))"


_EIGEN = f"""e AS (SELECT x, y, list(amp ORDER BY z) AS v FROM embeddings_cube GROUP BY x, y),
  p AS (SELECT x, y, list_concat(list_reverse(v[1:DEPTH]), v, list_reverse(v[-DEPTH:])) AS v FROM e),
  n AS (SELECT e.x, e.y, list(p.v ORDER BY dx, dy) AS ps FROM e, shape, range(-1, 2) rx(dx), range(-1, 2) ry(dy) JOIN p ON p.x = {_MIRROR.format('(e.x + dx)', 'nx')} AND p.y = {_MIRROR.format('(e.y + dy)', 'ny')} GROUP BY e.x, e.y),
  w AS (SELECT x, y, z, [p[z + 1 : z + 2 * DEPTH + 1] FOR p IN ps] AS w FROM n, range(64) r(z)),
  q0 AS (SELECT x, y, z, [[list_dot_product(a, b) FOR b IN w] FOR a IN w] AS c, c AS m FROM w), {', '.join(map(_squared, range(1, 21)))},
  core AS (SELECT x, y, z, list_sum([list_dot_product(c[i], m[i]) FOR i IN range(1, 10)]) / list_sum([m[i][i] FOR i IN range(1, 10)]) / list_sum([c[i][i] FOR i IN range(1, 10)]) AS value FROM q20)"""


@query("w13_eigen_coherence", f"{WITH_CUBE}, {_EIGEN.replace('DEPTH', '4')} SELECT x, y, CAST(z AS BIGINT) AS z, round(value + 1e-8, 6) AS value FROM core")
def w13(spark, d):
    t = traces(spark, d)
    m = stencil.on_tiles(t, stencil.cube_shape(t), (1, 1, 4), {"value": attributes.eigen_kernel((3, 3, 9))})
    return stencil.points(m, "value").withColumn("value", F.round(F.col("value") + 1e-8, 6))


_STEP = "-1, 2"
_SIDE = {a: f"CASE WHEN c.{a} + d{a} < 0 OR c.{a} + d{a} >= n{a} THEN -1 ELSE 1 END" for a in "xy"}


def _slope(axis: str) -> str:
    """The derivative along one axis: weighted samples of the line through each point."""
    on = " AND ".join(f"s.{a} = " + (_MIRROR.format(f"(c.{a} + d)", f"n{a}") if a == axis else f"c.{a}") for a in "xyz")
    return f"slope_{axis} AS (SELECT c.x, c.y, c.z, sum(weight * s.amp) AS g{axis} FROM embeddings_cube c, shape, k JOIN embeddings_cube s ON {on} GROUP BY c.x, c.y, c.z)"


@query("w14_structure_tensor", f"""{WITH_CUBE}, k AS (SELECT d, d * exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS weight FROM range(-4, 5) r(d)),
  {', '.join(map(_slope, 'xyz'))}, g AS (SELECT * FROM slope_x JOIN slope_y USING (x, y, z) JOIN slope_z USING (x, y, z)),
  s AS (SELECT c.x, c.y, c.z, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gz * gz) AS zz, sum(gx * gy * sx * sy) AS xy, sum(gx * gz * sx) AS xz, sum(gy * gz * sy) AS yz
    FROM (SELECT c.x, c.y, c.z, {_MIRROR.format('(c.x + dx)', 'nx')} AS ax, {_MIRROR.format('(c.y + dy)', 'ny')} AS ay, abs(CASE WHEN c.z + dz >= nz THEN 2 * nz - 2 - (c.z + dz) ELSE c.z + dz END) AS az,
      {_SIDE['x']} AS sx, {_SIDE['y']} AS sy FROM embeddings_cube c, shape, range({_STEP}) rx(dx), range({_STEP}) ry(dy), range({_STEP}) rz(dz)) c JOIN g ON g.x = ax AND g.y = ay AND g.z = az GROUP BY c.x, c.y, c.z),
  m AS (SELECT *, (xx + yy + zz) / 3 AS q FROM s), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM m),
  r AS (SELECT *, greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / p ** 3 / 2)) AS r FROM p),
  l AS (SELECT x, y, z, q, q + 2 * p * cos(acos(r) / 3) AS l0, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l2 FROM r)
  SELECT x, y, CAST(z AS BIGINT) AS z, round((l0 - (3 * q - l0 - l2)) / (l0 + (3 * q - l0 - l2)) + 1e-7, 5) AS gst FROM l""")
def w14(spark, d):
    return stencil.points(attributes.structure_tensor_coherence(traces(spark, d), (3, 3, 3)), "gst").withColumn("gst", r5("gst"))


@query("w15_sobel_coherence", f"""{WITH_CUBE}, {_EIGEN.replace('DEPTH', '2')},
  s AS (SELECT c.x, c.y, c.z, sum(dx * (2 - abs(dy)) * (2 - abs(dz)) * s.value) AS gx, sum(dy * (2 - abs(dx)) * (2 - abs(dz)) * s.value) AS gy, sum(dz * (2 - abs(dx)) * (2 - abs(dy)) * s.value) AS gz
    FROM core c, shape, range({_STEP}) rx(dx), range({_STEP}) ry(dy), range({_STEP}) rz(dz)
    JOIN core s ON s.x = {_MIRROR.format('(c.x + dx)', 'nx')} AND s.y = {_MIRROR.format('(c.y + dy)', 'ny')} AND s.z = {_MIRROR.format('(c.z + dz)', 'nz')} GROUP BY c.x, c.y, c.z)
  SELECT x, y, CAST(z AS BIGINT) AS z, round(sqrt(gx * gx + gy * gy + gz * gz) + 1e-7, 5) AS sobel FROM s""")
def w15(spark, d):
    return stencil.points(attributes.sobel_coherence(traces(spark, d), (3, 3, 5)), "sobel").withColumn("sobel", r5("sobel"))


_DIFF = "CASE WHEN {a} = 0 THEN lead({v}) OVER {w} - {v} WHEN {a} = {n} - 1 THEN {v} - lag({v}) OVER {w} ELSE (lead({v}) OVER {w} - lag({v}) OVER {w}) / 2 END"
_ALONG = {"x": "(PARTITION BY y, z ORDER BY x)", "y": "(PARTITION BY x, z ORDER BY y)"}
_diff = lambda v, a: _DIFF.format(a=a, v=v, n=f"n{a}", w=_ALONG[a])
_SURFACE = f"""{WITH_CUBE}, first AS (SELECT x, y, z, nx, ny, {_diff('amp', 'x')} AS zx, {_diff('amp', 'y')} AS zy FROM embeddings_cube, shape),
  par AS (SELECT x, y, CAST(z AS BIGINT) AS z, {_diff('zx', 'x')} / 2 AS a, {_diff('zy', 'y')} / 2 AS b, {_diff('zx', 'y')} AS c, zx AS d, zy AS e FROM first)"""


@query("w9_surface_parameters", f"{_SURFACE} SELECT x, y, z, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(d, 6) + 0.0 AS d, round(e, 6) + 0.0 AS e FROM par")
def w9(spark, d):
    p = attributes.surface_parameters(traces(spark, d))
    return p.select("x", "y", "z", *[r6(c).alias(c) for c in "abcde"])


_ATTRIBUTES = """, m AS (SELECT *, 1 + d * d + e * e AS g FROM par), k AS (SELECT *, (a * (1 + e * e) - c * d * e + b * (1 + d * d)) / pow(g, 1.5) AS km, (4 * a * b - c * c) / (g * g) AS kg FROM m),
  q AS (SELECT *, CASE WHEN km * km - kg < 0 THEN 'nan'::DOUBLE ELSE sqrt(km * km - kg) END AS off FROM k)"""


@query("c1_c12_surface_attributes", f"""{_SURFACE}{_ATTRIBUTES} SELECT x, y, z, round(atan(sqrt(d * d + e * e)), 5) + 0.0 AS dip_angle, round(atan(e / d), 5) + 0.0 AS azimuth, round(km, 5) + 0.0 AS mean_curvature, round(kg, 5) + 0.0 AS gaussian_curvature,
  round(a + b + sqrt((a - b) * (a - b) + c * c), 5) + 0.0 AS most_positive_curvature, round(a + b - sqrt((a - b) * (a - b) + c * c), 5) + 0.0 AS most_negative_curvature,
  round(2 * (a * e * e - c * d * e + b * d * d) / pow(g, 1.5), 5) + 0.0 AS contour_curvature, round(sqrt(((km + off) ** 2 + (km - off) ** 2) / 2), 5) + 0.0 AS curvedness FROM q WHERE NOT isnan(off) AND abs(d) > 1e-9""")
def c1(spark, d):
    names = ("dip_angle", "azimuth", "mean_curvature", "gaussian_curvature", "most_positive_curvature", "most_negative_curvature", "contour_curvature", "curvedness")
    p = curvature.with_shared(attributes.surface_parameters(traces(spark, d)).where(F.abs("d") > 1e-9)).where(~F.isnan("_off"))
    every = curvature.attributes()
    return p.select("x", "y", "z", *[(F.round(every[n], 5) + F.lit(0.0)).alias(n) for n in names])


@query("c5_c9_principal_curvatures", f"""{_SURFACE}{_ATTRIBUTES} SELECT x, y, z, round(km + off, 5) + 0.0 AS max_curvature, round(km - off, 5) + 0.0 AS min_curvature, round(2 / pi() * atan(2 * km / (2 * off)), 4) + 0.0 AS shape_index,
  round(2 * (a * e * e - c * d * e + b * d * d) / (sqrt(g) * (d * d + e * e)), 4) + 0.0 AS dip_curvature FROM q WHERE off > 1e-6 AND d * d + e * e > 1e-6""")
def c5(spark, d):
    p = curvature.with_shared(attributes.surface_parameters(traces(spark, d)).where(F.col("d") * F.col("d") + F.col("e") * F.col("e") > 1e-6))
    p = p.where(~F.isnan("_off") & (F.col("_off") > 1e-6))
    every, digits = curvature.attributes(), {"max_curvature": 5, "min_curvature": 5, "shape_index": 4, "dip_curvature": 4}
    return p.select("x", "y", "z", *[(F.round(every[n], k) + F.lit(0.0)).alias(n) for n, k in digits.items()])


@query("c13_complex_trace", """WITH t AS (SELECT CAST(vec_id % 20 AS INTEGER) AS x, CAST(vec_id // 20 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings),
  k AS (SELECT n, i, [CASE WHEN (i - j) % 2 = 0 THEN 0 ELSE 2.0 / n * cot(pi() * (i - j) / n) END FOR j IN range(n)] AS h FROM (SELECT DISTINCT n, unnest(range(n)) AS i FROM t)),
  s AS (SELECT x, y, i, t.n, e[i + 1] AS re, list_dot_product(e, h) AS im FROM t JOIN k USING (n)),
  a AS (SELECT *, atan2(im, re) AS angle, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY x, y ORDER BY i) AS d FROM s),
  u AS (SELECT *, first_value(angle) OVER w + coalesce(sum(d - 2 * pi() * floor((d + pi()) / (2 * pi()))) OVER w, 0) AS phase FROM a WINDOW w AS (PARTITION BY x, y ORDER BY i)),
  f AS (SELECT *, (lead(phase) OVER (PARTITION BY x, y ORDER BY i) - phase) / (2 * pi()) * n AS up, (phase - lag(phase) OVER (PARTITION BY x, y ORDER BY i)) / (2 * pi()) * n AS down FROM u)
  SELECT x, y, CAST(i AS BIGINT) AS z, round(sqrt(re * re + im * im), 6) + 0.0 AS envelope, round(phase, 6) + 0.0 AS phase, round(coalesce(up, down), 6) + 0.0 AS frequency FROM f""")
def c13(spark, d):
    p = stencil.points(attributes.complex_trace(traces(spark, d)), "envelope", "phase", "frequency")
    return p.select("x", "y", "z", *[r6(c).alias(c) for c in ("envelope", "phase", "frequency")])


@query("w10_one_resolution", f"""WITH {_CLEAN}, long AS (SELECT run_id FROM clean GROUP BY run_id ORDER BY count(*) DESC, run_id LIMIT 1),
  target AS (SELECT DISTINCT depth AS t FROM clean JOIN long USING (run_id)), r AS (SELECT run_id, depth, avg(por) AS por FROM clean GROUP BY ALL),
  runs AS (SELECT DISTINCT run_id FROM clean), ask AS (SELECT run_id, t FROM runs, target),
  lo AS (SELECT a.run_id, t, r.depth AS d0, r.por AS v0 FROM ask a ASOF LEFT JOIN r ON a.run_id = r.run_id AND a.t >= r.depth),
  hi AS (SELECT a.run_id, t, r.depth AS d1, r.por AS v1 FROM ask a ASOF LEFT JOIN r ON a.run_id = r.run_id AND a.t <= r.depth)
  SELECT run_id, t AS depth, round(CASE WHEN d0 IS NULL THEN v1 WHEN d1 IS NULL OR d1 = d0 THEN v0 ELSE v0 + (t - d0) * (v1 - v0) / (d1 - d0) END + 1e-7, 5) AS por FROM lo JOIN hi USING (run_id, t)""")
def w10(spark, d):
    l = cut(_clean(spark, d))
    targets = l.join(small(logs.densest(l, "run_id").select("run_id")), "run_id").select("depth")
    return logs.interpolated(l, ["run_id"], targets, ["por"]).withColumn("por", r5("por"))


@query("w11_resampled_traces", """WITH t AS (SELECT CAST(vec_id % 20 AS INTEGER) AS x, CAST(vec_id // 20 AS INTEGER) AS y, embedding AS e FROM embeddings),
  k AS (SELECT x, y, e, CAST(unnest(range(127)) AS BIGINT) AS z FROM t)
  SELECT x, y, z, round(e[z // 2 + 1]::DOUBLE + (z / 2.0 - z // 2) * (e[(z + 1) // 2 + 1]::DOUBLE - e[z // 2 + 1]::DOUBLE), 6) + 0.0 AS amp FROM k""")
def w11(spark, d):
    m = logs.resample_traces(traces(spark, d), range(NZ), [i / 2 for i in range(2 * NZ - 1)])
    return stencil.points(m, "amp").withColumn("amp", r6("amp"))


@query("w16_differences", "SELECT config_name, iteration, seconds - lag(seconds) OVER (PARTITION BY config_name ORDER BY iteration) AS difference FROM (SELECT DISTINCT * FROM iteration_times WHERE NOT isnan(seconds))")
def w16(spark, d):
    from pyspark.sql import Window

    t = read(spark, d, "iteration_times").where("seconds is not null and not isnan(seconds)").distinct()
    return t.select("config_name", "iteration", (F.col("seconds") - F.lag("seconds").over(Window.partitionBy("config_name").orderBy("iteration"))).alias("difference"))


@query("w18_displacements", "SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(dz AS INTEGER) AS dz FROM range(-3, 4) a(dx), range(-3, 4) b(dy), range(-3, 4) c(dz)")
def w18(spark, d):
    return lookup.displacements(spark, 3)


# Order and limits.


@query("o3_best_candidate", "SELECT config_name, iteration, rmse FROM expected_errors WHERE NOT isnan(rmse) ORDER BY rmse, config_name, iteration LIMIT 1")
def o3(spark, d):
    return read(spark, d, "expected_errors").where("rmse is not null and not isnan(rmse)").select("config_name", "iteration", "rmse").orderBy("rmse", "config_name", "iteration").limit(1)


_NAMES = "names AS (SELECT DISTINCT split_part(trim(f), ' ', 1) AS feature FROM (SELECT unnest(string_split(features, ',')) AS f FROM expected_errors WHERE features IS NOT NULL))"


def _names(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "expected_errors").where("features is not null").select(F.explode(F.split("features", ",")).alias("f"))
    return e.select(F.split_part(F.trim("f"), F.lit(" "), F.lit(1)).alias("feature")).distinct()


@query("o5_o6_first_candidates", f"""WITH {_NAMES}, few AS (SELECT feature FROM names ORDER BY feature LIMIT 3)
  SELECT feature, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, CAST(dz AS INTEGER) AS dz FROM few, range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz) ORDER BY ALL LIMIT 50""")
def o5(spark, d):
    return lookup.candidates(_names(spark, d), 1, first_features=3, first=50)


@query("o7_wells_reaching", f"""WITH {CUBE}, {WELL_ROWS}, cols AS (SELECT DISTINCT x, y FROM embeddings_cube)
  SELECT x, y, string_agg(well_id, ',' ORDER BY greatest(abs(x - wx), abs(y - wy)), well_id) AS wells FROM cols, wells WHERE greatest(abs(x - wx), abs(y - wy)) <= 8 GROUP BY x, y""")
def o7(spark, d):
    r = geometry.reached(traces(spark, d).select("x", "y"), WELLS, 8)
    return r.select("x", "y", F.array_join(F.transform("wells", lambda s: s["well_id"].cast("string")), ",").alias("wells"))


@query("o8_first_to_reach", f"""WITH {CUBE}, {WELL_ROWS}, cols AS (SELECT DISTINCT x, y FROM embeddings_cube)
  SELECT x, y, CAST(min(greatest(abs(x - wx), abs(y - wy))) AS INTEGER) AS its, arg_min(well_id, greatest(abs(x - wx), abs(y - wy)) * 100 + well_id) AS well_id FROM cols, wells GROUP BY x, y""")
def o8(spark, d):
    return geometry.first_to_reach(traces(spark, d).select("x", "y"), WELLS)


@query("o9_features_by_size", f"WITH {_CLEAN} SELECT run_id, round(avg(por) + 1e-7, 5) AS mean FROM clean GROUP BY run_id ORDER BY abs(avg(por)) DESC, run_id LIMIT 20")
def o9(spark, d):
    return _clean(spark, d).groupBy("run_id").agg(F.avg("por").alias("m")).orderBy(F.desc(F.abs("m")), "run_id").limit(20).select("run_id", r5("m").alias("mean"))


# Sets.


@query("u1_union_by_name", "SELECT config_name, iteration, rmse, CAST(NULL AS DOUBLE) AS seconds FROM expected_errors UNION ALL SELECT config_name, iteration, NULL, seconds FROM iteration_times")
def u1(spark, d):
    return read(spark, d, "expected_errors").select("config_name", "iteration", "rmse").unionByName(read(spark, d, "iteration_times"), allowMissingColumns=True)


@query("u3_repeats", "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT x, y, z, porosity FROM por_test)) AS BIGINT) AS repeats FROM por_test")
def u3(spark, d):
    return compare.without_repeats(read(spark, d, "por_test").select("x", "y", "z", F.col("porosity").alias("phi")))[1]


@query("u4_only_in_first", f"WITH {PREDICTIONS} SELECT x, y, z FROM pred_a EXCEPT SELECT x, y, z FROM pred_b")
def u4(spark, d):
    a, b = predictions(spark, d)
    return a.select("x", "y", "z").exceptAll(b.select("x", "y", "z"))


# Scalars.


@query("c18_well_types", "SELECT DISTINCT well_id, CASE WHEN max_y - min_y >= 2000 THEN 'complete' WHEN max_y < 4000 THEN 'top' ELSE 'bottom' END AS kind FROM wells_info_completed WHERE min_y IS NOT NULL AND max_y IS NOT NULL")
def c18(spark, d):
    w = read(spark, d, "wells_info_completed").where("min_y is not null and max_y is not null")
    return w.select("well_id", scalars.well_type(F.col("min_y"), F.col("max_y")).alias("kind")).distinct()


@query("c19_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 2) AS v FROM lineitem")
def c19(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_half_even(F.col("l_extendedprice") / 7, 2).alias("v"))


@query("c22_linear_index", f"WITH {CUBE} SELECT x, y, z, (CAST(x AS BIGINT) * 1000 + y) * 64 + z AS i FROM embeddings_cube")
def c22(spark, d):
    c = cube_of(spark, d).withColumn("i", scalars.linear_index(F.col("x"), F.col("y"), F.col("z"), 1000, NZ))
    x, y, z = scalars.from_linear(F.col("i"), 1000, NZ)
    return c.select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"), "i")


@query("c23_file_names", "SELECT DISTINCT log_file, upper(split_part(regexp_replace(log_file, '\\.[^.]*$', ''), '_', 1)) AS name FROM run_log_lines")
def c23(spark, d):
    return read(spark, d, "run_log_lines").select("log_file").distinct().select("log_file", scalars.name_of_file(F.col("log_file")).alias("name"))


@query("c24_c25_feature_text", f"WITH {_NAMES} SELECT feature, split_part(feature, '_', 1) AS prefix, feature || '/' || -1 || ',' || 2 || ',' || 0 AS text FROM names")
def c24(spark, d):
    n = _names(spark, d)
    return n.select("feature", scalars.feature_prefix(F.col("feature")).alias("prefix"), scalars.feature_text(F.col("feature"), F.lit(-1), F.lit(2), F.lit(0)).alias("text"))


@query("c27_header_lines", """SELECT DISTINCT raw_line, len(list_filter(regexp_split_to_array(trim(raw_line), '[\\s,;]+'), lambda t: regexp_full_match(t, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?'))) = 0 AS header
  FROM (SELECT DISTINCT p_brand || ' ' || p_type || CASE WHEN p_size > 25 THEN ' ' || p_size ELSE '' END AS raw_line FROM part)""")
def c27(spark, d):
    p = read(spark, d, "part")
    line = F.concat("p_brand", F.lit(" "), "p_type", F.when(F.col("p_size") > 25, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(""))
    return p.select(line.alias("raw_line")).distinct().select("raw_line", scalars.is_header(F.col("raw_line")).alias("header"))


@query("c29_beta_density", "SELECT CAST(i AS BIGINT) AS id, round(CASE WHEN i > 0 THEN 30 * pow(i / 100.0, 1) * pow(1 - i / 100.0, 4) ELSE 0 END, 6) + 0.0 AS density FROM range(100) r(i)")
def c29(spark, d):
    return spark.range(100).select("id", r6(scalars.beta_density(F.col("id") / 100.0, 2.0, 5.0)).alias("density"))


# Rings.


@query("g2_frontier", f"{WITH_STATE} SELECT s.x, s.y, s.z, CAST(o.ring AS INTEGER) AS ring, o.well_id FROM state s JOIN own o USING (x, y) WHERE s.real = 5 AND o.ring = {FILLED + 1}")
def g2(spark, d):
    return geometry.frontier(state(spark, d), TRAIN, FILLED + 1).select("x", "y", "z", "ring", "well_id")


@query("g3_ring_assignment", f"WITH {CUBE}, {WELL_ROWS}, {OWN} SELECT x, y, CAST(ring AS INTEGER) AS ring, well_id FROM own")
def g3(spark, d):
    return geometry.assign_rings(traces(spark, d).select("x", "y"), TRAIN)


@query("g8_ring_counts", f"WITH {CUBE}, {WELL_ROWS}, {OWN} SELECT CAST(ring AS INTEGER) AS ring, well_id, count(*) * 64 AS points FROM own WHERE ring BETWEEN 6 AND 8 GROUP BY ring, well_id")
def g8(spark, d):
    r = geometry.rings_of_iteration(2, 3)
    a = geometry.assign_rings(traces(spark, d).select("x", "y"), TRAIN).where(F.col("ring").between(r[0], r[-1]))
    return a.groupBy("ring", "well_id").agg((F.count(F.lit(1)) * NZ).alias("points"))


@query("g13_iterations_to_predict", f"""WITH {CUBE}, {WELL_ROWS}, cols AS (SELECT DISTINCT x, y FROM embeddings_cube),
  rings AS (SELECT ring, count(*) * 64 AS n FROM (SELECT x, y, min(greatest(abs(x - wx), abs(y - wy))) AS ring FROM cols, wells GROUP BY x, y) WHERE ring > 0 GROUP BY ring)
  SELECT CAST(min(ring) AS INTEGER) AS its FROM (SELECT ring, sum(n) OVER (ORDER BY ring) AS upto FROM rings) WHERE upto >= 10000""")
def g13(spark, d):
    return geometry.iterations_to_predict(traces(spark, d), WELLS, NZ, 10_000)


@query("g14_most_predictable", f"WITH {CUBE}, {SHAPE} SELECT CAST((nx * ny - 4) * nz AS BIGINT) AS points FROM shape")
def g14(spark, d):
    s = traces(spark, d).agg(F.countDistinct("x", "y").alias("n"), F.max(F.size("amp")).alias("nz"))
    return s.select(((F.col("n") - len(WELLS)) * F.col("nz")).alias("points"))


# Changing cubes.

_state_query("x0_state", "real <> 6", lambda c: c)


@query("x1_update_where", f"{WITH_STATE} SELECT x, y, z, CASE WHEN ring = 2 THEN phi + 1 ELSE phi END AS phi, CASE WHEN ring = 2 THEN 4 ELSE real END AS real, ring, well_id FROM state")
def x1(spark, d):
    return cubes.update_where(state(spark, d), F.col("ring") == 2, phi=F.col("phi") + 1, real=4)


@query("x3_clear_after", f"{WITH_STATE} SELECT x, y, z, CASE WHEN ring > 2 THEN 0 ELSE phi END AS phi, CASE WHEN ring > 2 THEN 5 ELSE real END AS real, CASE WHEN ring > 2 THEN -1 ELSE ring END AS ring, CASE WHEN ring > 2 THEN -1 ELSE well_id END AS well_id FROM state")
def x3(spark, d):
    return cubes.clear_after(state(spark, d), 2)


@query("x4_fill_rings", f"{WITH_STATE} SELECT s.x, s.y, s.z, CASE WHEN s.real = 5 AND o.ring <= 7 THEN 1 ELSE s.real END AS real, CAST(CASE WHEN s.real = 5 AND o.ring <= 7 THEN o.ring ELSE s.ring END AS INTEGER) AS ring, CASE WHEN s.real = 5 AND o.ring <= 7 THEN o.well_id ELSE s.well_id END AS well_id FROM state s JOIN own o USING (x, y)")
def x4(spark, d):
    return cubes.fill_rings(state(spark, d), TRAIN, 7).drop("phi")


@query("x5_zero_wells", f"{WITH_STATE} SELECT x, y, z, CASE WHEN h THEN 0 ELSE phi END AS phi, CASE WHEN h THEN 5 ELSE real END AS real, CASE WHEN h THEN -1 ELSE ring END AS ring, CASE WHEN h THEN -1 ELSE well_id END AS well_id FROM (SELECT *, (x, y) IN ((4, 5), (8, 15)) AS h FROM state)")
def x5(spark, d):
    return cubes.zero_wells(state(spark, d), [(4, 5), (8, 15)])


_LOGGED = "logged AS (SELECT CAST(w.wx AS INTEGER) AS x, CAST(w.wy AS INTEGER) AS y, CAST(l_linenumber AS INTEGER) AS z, min(l_discount) AS phi, w.well_id FROM lineitem, wells w WHERE l_suppkey % 4 = w.well_id GROUP BY ALL)"


@query("x7_initial_cube", f"WITH {WELL_ROWS}, {_LOGGED} SELECT CAST(a.x AS INTEGER) AS x, CAST(b.y AS INTEGER) AS y, CAST(c.z AS INTEGER) AS z, coalesce(l.phi, 0) AS phi, CASE WHEN l.phi IS NULL THEN 5 ELSE 0 END AS real, CASE WHEN l.phi IS NULL THEN -1 ELSE 0 END AS ring, coalesce(l.well_id, -1) AS well_id FROM range(20) a(x), range(25) b(y), range(8) c(z) LEFT JOIN logged l ON l.x = a.x AND l.y = b.y AND l.z = c.z")
def x7(spark, d):
    w = spark.createDataFrame(WELLS, "well_id int, x int, y int")
    l = read(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(4)).cast("int").alias("well_id"), F.col("l_linenumber").alias("z"), F.col("l_discount").alias("phi"))
    l = l.join(small(w), "well_id").groupBy("x", "y", "z", "well_id").agg(F.min("phi").alias("phi"))
    return cubes.overlay(cubes.empty_cube(spark, geometry.Box(20, 25, 8)), l)


@query("x9_tiled_cube", f"{WITH_STATE} SELECT CAST(x + 20 * i AS INTEGER) AS x, CAST(y + 200 * j AS INTEGER) AS y, z, phi, real, ring, CAST(CASE WHEN real = 0 THEN well_id + 4 * (i * 2 + j) ELSE -1 END AS INTEGER) AS well_id FROM state, range(2) a(i), range(2) b(j)")
def x9(spark, d):
    return cubes.tile(state(spark, d), geometry.Box(20, 200, NZ), (2, 2, 1), wells=4)


# Samples and chunks.

_RINGS = f"{WITH_STATE}, known AS (SELECT * FROM state WHERE ring >= 0), total AS (SELECT count(*) AS total FROM known)"


@query("d2_ring_quotas", f"{_RINGS} SELECT ring, count(*) AS n, CAST(ceil(count(*) / any_value(total) * 3000) AS BIGINT) AS quota FROM known, total GROUP BY ring")
def d2(spark, d):
    return sampling.ring_quotas(P.from_ring(0).of(state(spark, d)), 3000)


# A ring's quota as units: every well has its rounded-up share of them, the lowest levels are kept.
_QUOTAS = f"""{_RINGS}, wells_n AS (SELECT ring, well_id, count(*) AS n FROM known GROUP BY ring, well_id),
  rings_n AS (SELECT ring, sum(n) AS ring_n, CAST(ceil(sum(n) / any_value(total) * 3000) AS BIGINT) AS ring_quota FROM wells_n, total GROUP BY ring),
  units AS (SELECT ring, well_id, n, ring_quota, unnest(range(1, CAST(ceil(n / ring_n * ring_quota) AS BIGINT) + 1)) AS u FROM wells_n JOIN rings_n USING (ring)),
  kept AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY u, well_id DESC) <= ring_quota AS k FROM units),
  quotas AS (SELECT ring, well_id, any_value(n) AS n, greatest(1, count_if(k)) AS quota FROM kept GROUP BY ring, well_id)"""


@query("d3_well_quotas", f"{_QUOTAS} SELECT ring, well_id, n, CAST(quota AS BIGINT) AS quota FROM quotas")
def d3(spark, d):
    return sampling.well_quotas(P.from_ring(0).of(state(spark, d)), 3000)


@query("d4_sample", f"""{_QUOTAS} SELECT x, y, z, phi, real, ring, well_id FROM (SELECT k.*, quota,
    row_number() OVER (PARTITION BY ring, well_id ORDER BY (CAST('0x' || substr(md5('42|' || x || '|' || y || '|' || z), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0, x, y, z) AS rn
  FROM known k JOIN quotas USING (ring, well_id)) WHERE rn <= quota""")
def d4(spark, d):
    return sampling.sample_points(P.from_ring(0).of(state(spark, d)), 3000)


@query("d5_weighted_sample")
def d5(spark, d):
    return sampling.sample_points(P.from_ring(0).of(state(spark, d)), 3000, alpha=1.0, beta=3.0, by_ring=True)


@query("m6_chunks", f"{_RINGS} SELECT x, y, z, CAST(floor((row_number() OVER (PARTITION BY ring, well_id ORDER BY x, y, z) - 1) / ceil(count(*) OVER (PARTITION BY ring, well_id) / 3)) AS INTEGER) AS chunk FROM known")
def m6(spark, d):
    return sampling.chunks(P.from_ring(0).of(state(spark, d)), 3).select("x", "y", "z", "chunk")


@query("m7_sequential_chunks", f"{_RINGS} SELECT x, y, z, CAST(floor((row_number() OVER (ORDER BY ring, well_id, x, y, z) - 1) / ceil(any_value(total) OVER () / 4)) AS INTEGER) AS chunk FROM known, total")
def m7(spark, d):
    return sampling.sequential_chunks(P.from_ring(0).of(state(spark, d)), 4).select("x", "y", "z", "chunk")


# Modelling.

_QUICK = gbdt.Params(rounds=20, min_data=5, num_leaves=8, early_stop=5)


def _two_features(spark: SparkSession, d: str) -> DataFrame:
    t = traces(spark, d)
    smooth = stencil.moving_window(t, (3, 3, 3), "mean", "amp")
    return cut(t.withColumn("feature", F.lit("AMP")).unionByName(smooth.withColumn("feature", F.lit("SMOOTH"))))


@query("m4_trials")
def m4(spark, d):
    f = _two_features(spark, d)
    points = predicates.SELECTION.wells([w[0] for w in TRAIN]).of(state(spark, d))
    _, results = selection.forward_selection(cut(points), f, 1, stencil.cube_shape(f), 1, _QUICK)
    return results


@query("m10_forward_selection")
def m10(spark, d):
    f = _two_features(spark, d)
    points = predicates.SELECTION.wells([w[0] for w in TRAIN]).of(state(spark, d))
    chosen, _ = selection.forward_selection(cut(points), f, 1, stencil.cube_shape(f), 2, _QUICK)
    return spark.createDataFrame([(i, n, *s) for i, (n, s) in enumerate(chosen)], "rank int, feature string, dx int, dy int, dz int")


@query("g4_propagate_ring")
def g4(spark, d):
    f = _two_features(spark, d)
    return propagate.propagate_ring(cut(state(spark, d)), f, WELLS, TEST, [("SMOOTH", (0, 0, 0)), ("AMP", (0, 0, 1))], stencil.cube_shape(f), FILLED + 1, _QUICK)[0]


@query("m9_test_errors")
def m9(spark, d):
    f = _two_features(spark, d)
    return propagate.propagate_ring(cut(state(spark, d)), f, WELLS, TEST, [("SMOOTH", (0, 0, 0)), ("AMP", (0, 0, 1))], stencil.cube_shape(f), FILLED + 1, _QUICK)[1]


@query("m13_replay")
def m13(spark, d):
    f = _two_features(spark, d)
    return propagate.replay(cut(state(spark, d)), f, WELLS, TEST, [[("AMP", (0, 0, 0))], [("SMOOTH", (0, 0, 0))]], stencil.cube_shape(f), FILLED + 1, _QUICK)


@query("h1_parameter_search")
def h1(spark, d):
    f = _two_features(spark, d)
    points = predicates.SELECTION.wells([w[0] for w in TRAIN]).of(state(spark, d))
    p = lookup.with_features(points, f, [("AMP", (0, 0, 1)), ("SMOOTH", (0, 0, 0))], stencil.cube_shape(f))
    return selection.parameter_search(cut(p), ["f0", "f1"], selection.random_space(spark, 4), _QUICK)


# Further operators of the inventory, each on its own.

_state_query("f9_wells", "well_id IN (1, 2)", lambda c: P.wells((1, 2)).of(c))


@query("f14_feature_matrix", f"""{WITH_STATE}, {SHAPE} SELECT s.x, s.y, s.z, s.phi AS label, round(a.amp + 10 * b.amp, 6) + 0.0 AS row_sum FROM state s, shape
  {_look(0, 0, 1, 'a')} {_look(1, 0, 0, 'b')} WHERE s.real IN (0, 1)""")
def f14(spark, d):
    t = traces(spark, d)
    p = lookup.with_features(predicates.PREDICTION.of(state(spark, d)), t.withColumn("feature", F.lit("amp")), [("amp", (0, 0, 1)), ("amp", (1, 0, 0))], stencil.cube_shape(t))
    m = p.select("x", "y", "z", F.col("phi").alias("label"), F.array("f0", "f1").alias("row"))
    return m.select("x", "y", "z", "label", r6(F.get("row", F.lit(0)) + 10 * F.get("row", F.lit(1))).alias("row_sum"))


@query("c14_ring_distance", f"WITH {CUBE}, {WELL_ROWS} SELECT DISTINCT x, y, well_id, CAST(greatest(abs(x - wx), abs(y - wy)) AS INTEGER) AS ring FROM embeddings_cube, wells")
def c14(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("well_id"), scalars.ring_distance(F.col("x"), F.col("y"), wx, wy).cast("int").alias("ring")) for w, wx, wy in WELLS]))
    return traces(spark, d).select("x", "y").distinct().select("x", "y", each.alias("r")).select("x", "y", "r.well_id", "r.ring")


_ITS = "its(it) AS (SELECT CAST(i AS INTEGER) FROM range(0, 9) r(i))"
_EXTENTS = f"""{_PLACED}, {_ITS}, squares AS (SELECT it, well_id, x, y, greatest(x - it, 0) AS x0, least(x + it, nx - 1) AS x1, greatest(y - it, 0) AS y0, least(y + it, ny - 1) AS y1 FROM placed, box, its)"""


@query("c15_c16_extents", f"WITH {_EXTENTS} SELECT *, ((x1 - x0 + 1) * (y1 - y0 + 1) - 1) * 64 AS predicted FROM squares")
def c15(spark, d):
    w, box = _placed(spark, d)
    return geometry.extents(w.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(8)))), box, F.col("it"))


@query("c17_overlap_volumes", f"""WITH {_EXTENTS} SELECT it, a.well_id AS a, b.well_id AS b, ({_OVERLAP[0]}) * ({_OVERLAP[1]}) * 64 AS points
  FROM squares a JOIN squares b USING (it) WHERE a.well_id < b.well_id AND it > 0 AND b.x0 BETWEEN a.x0 - 17 AND a.x1 AND a.x1 >= b.x0 AND b.x1 >= a.x0 AND a.y1 >= b.y0 AND b.y1 >= a.y0""")
def c17(spark, d):
    return geometry.overlap_volumes(*_placed(spark, d), 8)


@query("c20_depth_index", f"WITH {_CLEAN} SELECT log_id, CAST(floor(depth / 5.0) - floor(start / 5.0) AS INTEGER) AS i FROM (SELECT log_id, depth, min(depth) OVER (PARTITION BY run_id) AS start FROM clean)")
def c20(spark, d):
    l = cut(_clean(spark, d))
    starts = l.groupBy("run_id").agg(F.min("depth").alias("start"))
    return l.join(starts, "run_id").select("log_id", scalars.depth_index(F.col("depth"), 5.0, F.col("start")).alias("i"))


@query("d8_tile_quotas", f"{_RINGS} SELECT CAST(x // 5 AS BIGINT) AS tx, CAST(y // 5 AS BIGINT) AS ty, count(*) AS n, CAST(ceil(count(*) / any_value(total) * 3000) AS BIGINT) AS quota FROM known, total GROUP BY tx, ty")
def d8(spark, d):
    return sampling.tile_quotas(P.from_ring(0).of(state(spark, d)), 3000, 5)


@query("j11_well_of_coords", """SELECT DISTINCT run_id, w.well, w.min_y FROM well_logs l JOIN (SELECT x_coord, y_coord, min(well) AS well, min(min_y) AS min_y FROM wells_info_completed GROUP BY ALL) w
  ON l.global_x = w.x_coord AND l.global_y = w.y_coord""")
def j11(spark, d):
    w = read(spark, d, "wells_info_completed").where("x_coord is not null and y_coord is not null").groupBy(F.col("x_coord").cast("double").alias("global_x"), F.col("y_coord").cast("double").alias("global_y")).agg(F.min("well").alias("well"), F.min("min_y").alias("min_y"))
    l = read(spark, d, "well_logs").select("run_id", "global_x", "global_y").distinct()
    return l.join(small(w), ["global_x", "global_y"]).select("run_id", "well", "min_y").distinct()


@query("j15_nearest_well", f"WITH {CUBE}, {WELL_ROWS}, cols AS (SELECT DISTINCT x, y FROM embeddings_cube) SELECT arg_min(well_id, greatest(abs(x - wx), abs(y - wy)) * 100 + well_id) AS well_id, x, y FROM cols, wells GROUP BY x, y")
def j15(spark, d):
    return geometry.first_to_reach(traces(spark, d).select("x", "y"), WELLS).select("well_id", "x", "y")


@query("o1_sorted_log", "SELECT log_id, area_x, area_y, depth FROM well_logs WHERE depth IS NOT NULL AND NOT isnan(area_x) AND NOT isnan(area_y)")
def o1(spark, d):
    l = read(spark, d, "well_logs").select("log_id", "area_x", "area_y", "depth").where("depth is not null and area_x is not null and area_y is not null and not isnan(area_x) and not isnan(area_y)")
    return l.orderBy("area_x", "area_y", "depth")


@query("o2_sorted_predictions", f"WITH {PREDICTIONS} SELECT x, y, z, phi FROM pred_a")
def o2(spark, d):
    return predictions(spark, d)[0].orderBy("x", "y", "z")


@query("u2_blocks_together", f"{WITH_STATE} SELECT ring, well_id, x, y, z FROM state WHERE (ring = 1 AND well_id = 0) OR (ring = 2 AND well_id = 1)")
def u2(spark, d):
    c = state(spark, d)
    return P.wells([0]).at_ring(1).of(c).unionByName(P.wells([1]).at_ring(2).of(c)).select("ring", "well_id", "x", "y", "z")


@query("u5_well_set", "SELECT DISTINCT x_coord, y_coord FROM wells_info_completed WHERE x_coord >= 0 AND y_coord >= 0 EXCEPT SELECT max_x, max_y FROM areas_coords")
def u5(spark, d):
    w = read(spark, d, "wells_info_completed").where("x_coord >= 0 and y_coord >= 0").select("x_coord", "y_coord").dropDuplicates()
    gone = read(spark, d, "areas_coords").select(F.col("max_x").alias("x_coord"), F.col("max_y").alias("y_coord"))
    return w.join(small(gone), ["x_coord", "y_coord"], "left_anti")


@query("u6_ring_walls", f"WITH {CUBE}, cols AS (SELECT DISTINCT x, y FROM embeddings_cube) SELECT x, y FROM cols WHERE greatest(abs(x - 12), abs(y - 10)) = 4")
def u6(spark, d):
    c = traces(spark, d).select("x", "y")
    return c.where(scalars.ring_distance(F.col("x"), F.col("y"), 12, 10) == 4)


@query("x6_halo", f"""{WITH_CUBE} SELECT CAST(i + 2 AS INTEGER) AS x, CAST(j + 2 AS INTEGER) AS y, CAST(k + 2 AS BIGINT) AS z, amp FROM shape, range(-2, 22) a(i), range(-2, 102) b(j), range(-2, 66) c(k)
  JOIN embeddings_cube e ON e.x = {_CLAMP.format('i', 'nx')} AND e.y = {_CLAMP.format('j', 'ny')} AND e.z = {_CLAMP.format('k', 'nz')} WHERE j < ny + 2""")
def x6(spark, d):
    t = traces(spark, d)
    return stencil.points(cubes.with_halo(t, geometry.Box(*stencil.cube_shape(t)), 2), "amp")


@query("x10_canal_cube", f"""WITH {WELL_ROWS}, {CUBE}, {SHAPE}, pts AS (SELECT x, y, z, amp, well_id FROM embeddings_cube LEFT JOIN wells ON x = wx AND y = wy WHERE well_id IS NOT NULL OR amp > 0.1),
  xs AS (SELECT unnest(range(nx)) AS x FROM shape), ys AS (SELECT unnest(range(ny)) AS y FROM shape), zs AS (SELECT unnest(range(nz)) AS z FROM shape)
  SELECT CAST(xs.x AS INTEGER) AS x, CAST(ys.y AS INTEGER) AS y, CAST(zs.z AS INTEGER) AS z, coalesce(p.amp, 0) AS phi, CASE WHEN p.well_id IS NOT NULL THEN 0 WHEN p.amp IS NOT NULL THEN 2 ELSE 5 END AS real,
  CASE WHEN p.well_id IS NOT NULL THEN 0 ELSE -1 END AS ring, coalesce(p.well_id, -1) AS well_id FROM xs, ys, zs LEFT JOIN pts p ON p.x = xs.x AND p.y = ys.y AND p.z = zs.z""")
def x10(spark, d):
    w = spark.createDataFrame(WELLS, "well_id int, x int, y int")
    box = geometry.Box(*stencil.cube_shape(traces(spark, d)))
    p = cube_of(spark, d).join(small(w), ["x", "y"], "left").where("well_id is not null or amp > 0.1")
    return cubes.overlay(cubes.empty_cube(spark, box), p.withColumnRenamed("amp", "phi"), others=2)


# Sources and sinks: tables are written and read again. SQL states the table itself.


def _file(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share; as a plain path, for files written in place."""
    folder = shared_dir(spark).replace("file://", "", 1).rstrip("/") + f"/sources-{uuid.uuid4().hex}"
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}"


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path


_SAMPLES = f"WITH {CUBE} SELECT x, y, CAST(z AS BIGINT) AS z, amp FROM embeddings_cube"


@query("s10_segy", _SAMPLES)
def s10(spark, d):
    t = traces(spark, d)
    shape = stencil.cube_shape(t)
    path = _file(spark, "cube.sgy")
    io.write_segy(t, path, shape)
    return stencil.points(io.read_segy(spark, _uri(path), shape[1], 1 << 16), "amp").select("x", "y", "z", "amp")


@query("s21_s22_npy", _SAMPLES)
def s21(spark, d):
    t = traces(spark, d)
    path = _file(spark, "AMP_cube.npy")
    io.write_npy(t, path, stencil.cube_shape(t))
    return stencil.points(io.read_npy(spark, _uri(path), 1 << 16), "amp").select("x", "y", "z", "amp")


@query("s4_s9_feature_store", f"WITH {CUBE} SELECT x, y, CAST(z AS BIGINT) AS z, round(amp * 2, 6) + 0.0 AS amp FROM embeddings_cube")
def s4(spark, d):
    t = traces(spark, d).withColumn("feature", F.lit("AMP"))
    twice = t.withColumn("feature", F.lit("TWICE")).withColumn("amp", F.transform("amp", lambda v: v * 2))
    path = _uri(_file(spark, "features"))
    io.write_features(t.unionByName(twice), path)
    return stencil.points(io.read_features(spark, path, "TWICE"), "amp").select("x", "y", "z", r6("amp").alias("amp"))


@query("s12_s20_csv", "SELECT well_id, well, x_coord, y_coord, CASE WHEN isnan(test_area) THEN NULL ELSE test_area END AS test_area FROM wells_info_completed")
def s12(spark, d):
    w = read(spark, d, "wells_info_completed").select("well_id", "well", "x_coord", "y_coord", "test_area")
    path = _uri(_file(spark, "wells"))
    io.write_csv(w, path)
    return logs.no_nan(io.read_csv(spark, path, "well_id long, well string, x_coord int, y_coord int, test_area double"))


@query("s14_plain_log", f"WITH {_CLEAN} SELECT log_id, depth, por FROM clean")
def s14(spark, d):
    path = _uri(_file(spark, "plain"))
    _clean(spark, d).select(F.concat_ws(" ", "log_id", "depth", "por").alias("value")).write.text(path)
    return io.read_plain(spark, path, "log_id long, depth double, por double")


@query("s15_las", f"WITH {_CLEAN} SELECT run_id, min(depth) AS first, max(depth) AS last, count(*) AS n FROM clean GROUP BY run_id")
def s15(spark, d):
    path = _uri(_file(spark, "las"))
    line = F.concat_ws(" ", F.format_string("%.17g", "depth"), F.format_string("%.17g", "por"))
    head = F.concat(F.lit("~W\nNULL. -999.25 : none\n~A DEPTH POR\n"), F.array_join(F.array_agg(line), "\n"))
    _clean(spark, d).groupBy("run_id").agg(head.alias("value")).write.partitionBy("run_id").text(path)
    las = io.read_las(spark, path + "/*/*.txt").withColumn("run_id", F.regexp_extract("file", r"run_id=(\d+)", 1).cast("long"))
    return las.groupBy("run_id").agg(F.min(F.get("values", F.lit(0))).alias("first"), F.max(F.get("values", F.lit(0))).alias("last"), F.count(F.lit(1)).alias("n"))


@query("s18_training_dump", f"{WITH_STATE} SELECT phi, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM state WHERE real IN (0, 1)")
def s18(spark, d):
    path = _uri(_file(spark, "dump"))
    io.write_training_dump(predicates.PREDICTION.of(state(spark, d)), path, "phi", "x", "y", "z")
    return io.read_training_dump(spark, path, ["phi", "x", "y", "z"])


@query("s19_points_around_wells", f"WITH {CUBE}, {WELL_ROWS} SELECT well_id, x, y, z, amp AS phi FROM embeddings_cube JOIN wells ON abs(x - wx) <= 2 AND abs(y - wy) <= 2")
def s19(spark, d):
    path = _uri(_file(spark, "points"))
    cube_of(spark, d).select(F.concat_ws(" ", "x", "y", "z", "amp").alias("value")).write.text(path)
    p = io.read_numbers(spark, path, ["x", "y", "z", "phi"])
    p = p.select(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "z")], "phi")
    return io.around_wells(p, WELLS, 2).select("well_id", "x", "y", "z", "phi")


# Further operators.


@query("x8_random_wells", f"{WITH_CUBE} SELECT CAST(nx * ny // 4 AS BIGINT) AS wells, CAST(nx * ny // 4 AS BIGINT) AS places, CAST(nx * ny // 4 * nz AS BIGINT) AS points, true AS inside FROM shape")
def x8(spark, d):
    box = geometry.Box(*stencil.cube_shape(traces(spark, d)))
    w = cubes.random_wells(spark, box, box.nx * box.ny // 4)
    inside = F.bool_and(F.col("x").between(0, box.nx - 1) & F.col("y").between(0, box.ny - 1) & F.col("z").between(0, box.nz - 1) & F.col("phi").between(0, 30))
    return w.agg(F.countDistinct("well_id").alias("wells"), F.countDistinct("x", "y").alias("places"), F.count(F.lit(1)).alias("points"), inside.alias("inside"))


@query("x12_scratch_sets", f"{WITH_STATE} SELECT CASE WHEN well_id IN (3) THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM state WHERE real IN (0, 1) AND (well_id NOT IN (3) OR real = 0) GROUP BY part")
def x12(spark, d):
    train, test = cubes.scratch_sets(state(spark, d), TEST)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("m13_rings", f"{WITH_STATE} SELECT real, CASE WHEN real = 5 AND o.ring IN (5, 6) THEN o.ring ELSE s.ring END AS ring, CASE WHEN real = 5 AND o.ring IN (5, 6) THEN o.well_id ELSE s.well_id END AS well_id, count(*) AS points, true AS in_range FROM state s JOIN own o USING (x, y) GROUP BY ALL".replace("SELECT real,", "SELECT CASE WHEN real = 5 AND o.ring IN (5, 6) THEN 1 ELSE real END AS real,"))
def m13_rings(spark, d):
    """The replayed cube by state, ring and well, and whether predictions stay within what was known."""
    low, high = state(spark, d).where("real in (0, 1)").agg(F.min("phi"), F.max("phi")).first()
    within = F.bool_and(~(F.col("real") == 1) | F.col("phi").between(low - 1e-6, high + 1e-6))
    return m13(spark, d).groupBy("real", "ring", "well_id").agg(F.count(F.lit(1)).alias("points"), within.alias("in_range"))


@query("g4_ring", f"{WITH_STATE} SELECT o.well_id, o.ring, count(*) AS points, 1 AS real, true AS in_range FROM state s JOIN own o USING (x, y) WHERE real = 5 AND o.ring = 5 GROUP BY ALL")
def g4_ring(spark, d):
    """The next ring's points by well, and whether predictions stay within what was known."""
    low, high = state(spark, d).where("real in (0, 1)").agg(F.min("phi"), F.max("phi")).first()
    g = g4(spark, d).groupBy("well_id", "ring", "real").agg(F.count(F.lit(1)).alias("points"), F.bool_and(F.col("phi").between(low - 1e-6, high + 1e-6)).alias("in_range"))
    return g.select("well_id", "ring", "points", "real", "in_range")


@query("m4_bounds", "SELECT feature, 27 AS tried, 3 AS folds, true AS ordered, true AS useful FROM (VALUES ('AMP'), ('SMOOTH')) f(feature)")
def m4_bounds(spark, d):
    """Candidates of the first round by feature: all displacements tried in all folds, MAE at most RMSE, and the best no worse than a constant."""
    spread = predicates.SELECTION.wells([w[0] for w in TRAIN]).of(state(spark, d)).where("real = 0").agg(F.max(F.abs("phi")).alias("most"))
    m = m4(spark, d).crossJoin(F.broadcast(spread))  # one row
    return m.groupBy("feature").agg(
        F.count(F.lit(1)).cast("int").alias("tried"), F.min("folds").alias("folds"), F.bool_and(F.col("mae") <= F.col("rmse") + 1e-9).alias("ordered"), (F.min("rmse") <= F.max("most")).alias("useful")
    )


@query("d5_sample_sizes", f"{_RINGS}, q AS (SELECT ring, well_id, count(*) AS n FROM known GROUP BY ALL) SELECT ring, well_id, true AS within FROM q")
def d5_sizes(spark, d):
    """The weighted sample holds of every ring and well what its quota says."""
    points = P.from_ring(0).of(state(spark, d))
    got = d5(spark, d).groupBy("ring", "well_id").agg(F.count(F.lit(1)).alias("drawn"))
    quotas = sampling.well_quotas(points, 3000).join(got, ["ring", "well_id"], "left")
    return quotas.select("ring", "well_id", (F.coalesce("drawn", F.lit(0)) == F.col("quota")).alias("within"))


@query("g7_canal_errors", f"""WITH {CUBE}, {WELL_ROWS}, {OWN}, canal AS (SELECT x, y, ring FROM own JOIN embeddings_cube USING (x, y) LEFT JOIN wells w ON x = wx AND y = wy WHERE w.well_id IS NULL AND amp > 0.1)
  SELECT CAST(ring AS INTEGER) AS ring, count(*) AS n, true AS better_than_nothing FROM canal WHERE ring BETWEEN 1 AND 3 GROUP BY ring""")
def g7(spark, d):
    """Errors on canal points of three rings: fewer than those of no prediction at all."""
    w = spark.createDataFrame(WELLS, "w int, x int, y int")
    c = cube_of(spark, d).join(small(w), ["x", "y"], "left")
    c = c.select("x", "y", "z", F.col("amp").alias("phi"), F.when(F.col("w").isNotNull(), 0).otherwise(F.when(F.col("amp") > 0.1, 2).otherwise(5)).alias("real"),
                 F.when(F.col("w").isNotNull(), 0).otherwise(-1).alias("ring"), F.coalesce("w", F.lit(-1)).alias("well_id"))
    f = _two_features(spark, d)
    shape, chosen = stencil.cube_shape(f), [("AMP", (0, 0, 0))]
    c = cut(c)
    model = propagate.ring_model(c, f, TEST, chosen, shape, 1, _QUICK)
    e = propagate.canal_errors(c, f, TRAIN, chosen, shape, [1, 2, 3], model)
    return e.select("ring", "n", (F.col("rmse") < 0.25).alias("better_than_nothing"))


@query("o4_best_of_all_sets", "SELECT true AS least, 1 AS n")
def o4(spark, d):
    """The best set of all rounds: no candidate of any round is better."""
    f = _two_features(spark, d)
    points = cut(predicates.SELECTION.wells([w[0] for w in TRAIN]).of(state(spark, d)))
    _, first = selection.forward_selection(points, f, 0, stencil.cube_shape(f), 1, _QUICK)
    _, second = selection.forward_selection(points, f, 0, stencil.cube_shape(f), 2, _QUICK)
    best = selection.best_of_all([first, second])
    every = first.select("rmse").unionAll(second.select("rmse")).agg(F.min("rmse").alias("most"))
    return best.crossJoin(F.broadcast(every)).agg(F.bool_and(F.col("rmse") == F.col("most")).alias("least"), F.count(F.lit(1)).cast("int").alias("n"))


@query("h2_guided_search", "SELECT * FROM (VALUES (0, 6, 4), (1, 2, 8), (2, 1, 16)) t(stage, trials, rounds)")
def h2(spark, d):
    """Trials and boosting rounds of every stage of a guided search."""
    f = _two_features(spark, d)
    points = predicates.SELECTION.wells([w[0] for w in TRAIN]).of(state(spark, d))
    p = lookup.with_features(points, f, [("AMP", (0, 0, 1)), ("SMOOTH", (0, 0, 0))], stencil.cube_shape(f))
    g = selection.guided_search(cut(p), ["f0", "f1"], selection.random_space(spark, 6), _QUICK, (4, 8, 16))
    return g.groupBy("stage").agg(F.count(F.lit(1)).cast("int").alias("trials"), F.max("rounds").alias("rounds"))


@query("s1_s2_ring_partitions", f"{WITH_STATE} SELECT {STATE_COLUMNS} FROM state WHERE ring IN (1, 2)")
def s1(spark, d):
    """The cube written by rings; of it the two rings before the third, other partitions unread."""
    path = _uri(_file(spark, "cube"))
    cubes.write_ring(state(spark, d), path)
    return cubes.known_before(spark, path, 3, 2).select(*cubes.COLUMNS)


_CANAL = f"""canal AS (SELECT e.x, e.y, e.z, amp, CASE WHEN w.well_id IS NOT NULL THEN 0 WHEN amp > 0.1 THEN 2 ELSE 5 END AS real FROM embeddings_cube e LEFT JOIN wells w ON e.x = w.wx AND e.y = w.wy)"""


def _canal(spark: SparkSession, d: str) -> DataFrame:
    w = spark.createDataFrame(WELLS, "w int, x int, y int")
    c = cube_of(spark, d).join(small(w), ["x", "y"], "left")
    real = F.when(F.col("w").isNotNull(), 0).otherwise(F.when(F.col("amp") > 0.1, 2).otherwise(5))
    return c.select("x", "y", "z", F.col("amp").alias("phi"), real.alias("real"), F.lit(-1).alias("ring"), F.lit(-1).alias("well_id"))


@query("g6_canal_ring", f"WITH {CUBE}, {WELL_ROWS}, {OWN}, {_CANAL} SELECT x, y, z, amp AS phi, CAST(ring AS INTEGER) AS ring, well_id FROM canal JOIN own USING (x, y) WHERE real = 2 AND ring = 2")
def g6(spark, d):
    return geometry.frontier(_canal(spark, d), TRAIN, 2, 2).select("x", "y", "z", "phi", "ring", "well_id")


@query("g9_expanded", f"WITH {CUBE}, {WELL_ROWS}, {OWN}, {_CANAL} SELECT x, y, z, real, CAST(ring AS INTEGER) AS ring, well_id FROM canal JOIN own USING (x, y) WHERE real IN (2, 5) AND ring BETWEEN 1 AND 3")
def g9(spark, d):
    """Empty and canal points of the next three rings, each with its ring and well."""
    open_ = _canal(spark, d).where("real in (2, 5)").drop("ring", "well_id")
    return geometry.assign_rings(open_, TRAIN, 1).where("ring between 1 and 3").select("x", "y", "z", "real", "ring", "well_id")


@query("m9_counts", f"{WITH_STATE} SELECT well_id, count(*) AS n, true AS ordered FROM state WHERE well_id IN (3) AND real = 0 GROUP BY GROUPING SETS ((well_id), ())")
def m9_counts(spark, d):
    """Test points of every test well and of all, and whether MAE is at most RMSE."""
    return m9(spark, d).select("well_id", "n", (F.col("mae") <= F.col("rmse") + 1e-9).alias("ordered"))


@query("k13_progress", r"""WITH m AS (SELECT try_cast(regexp_extract(raw_line, '(?i)\b(?:iteration|iter|it|iteracao)\W{0,3}(\d+)', 1) AS INTEGER) AS iteration,
    try_cast(regexp_extract(raw_line, '(?i)\brmse\W{0,3}([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)', 1) AS DOUBLE) AS rmse,
    try_cast(regexp_extract(raw_line, '(?i)\b(?:seconds|took|time\(s\))\W{0,3}([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)', 1) AS DOUBLE) AS seconds FROM run_log_lines)
  SELECT iteration, min(rmse) AS rmse, round(sum(seconds), 3) AS seconds, count(*) AS lines FROM m WHERE iteration IS NOT NULL GROUP BY iteration""")
def k13(spark, d):
    return progress.latest(progress.metrics(read(spark, d, "run_log_lines"), "raw_line")).withColumn("seconds", F.round("seconds", 3))


@query("s13_user_aggregate", f"WITH {_CLEAN} SELECT run_id, round(median(por), 5) AS por, count(*) AS n FROM clean GROUP BY run_id")
def s13_user(spark, d):
    """A function of the user's own on every series."""
    middle = lambda pdf: pdf.groupby("run_id", as_index=False).agg(por=("por", "median"), n=("por", "size"))
    return logs.by_well(_clean(spark, d).select("run_id", "por"), ["run_id"], middle, "run_id long, por double, n long").withColumn("por", F.round("por", 5))


@query("s21_apply_and_save", "SELECT * FROM (VALUES ('MEAN', true, 0), ('WRONG', false, 0), ('TWICE', true, 0)) t(feature, written, left_out)")
def s21_apply(spark, d):
    """Attributes written one by one; the one that fails is skipped and reported."""
    path = _uri(_file(spark, "attributes"))
    t = traces(spark, d)
    made = attributes.apply_and_save(t, {
        "MEAN": lambda v: stencil.moving_window(v, (3, 3, 3), "mean", "amp"), "WRONG": lambda v: v.select("nothing"), "TWICE": lambda v: v.withColumn("amp", F.transform("amp", lambda a: a * 2)),
    }, path)
    n = t.count()
    there = io.read_features(spark, path).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    j = made.join(there, "feature", "left")
    return j.select("feature", F.col("error").isNull().alias("written"), F.when(F.col("n").isNull(), 0).otherwise(n - F.col("n")).cast("int").alias("left_out"))

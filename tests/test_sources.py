import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lithocube.operators.stencil import cube_shape
from lithocube.plans import config
from lithocube.plans.pipeline import run
from lithocube.sources import io
from lithocube.streaming.progress import follow, latest


def test_npy_and_features(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    np.save(tmp_path / "CUBE_a.npy", a)
    t = io.read_npy(spark, str(tmp_path / "*.npy"))
    assert t.count() == 6 and t.where("x = 1 and y = 2").first().amp == [20, 21, 22, 23] and t.first().feature == "CUBE_a"
    assert [r.feature for r in io.feature_catalog(spark, str(tmp_path / "*.npy"), 1).collect()] == ["CUBE_a"]
    io.write_features(t, str(tmp_path / "features"))
    assert rows(io.read_features(spark, str(tmp_path / "features"), "CUBE_a").select("x", "y", "amp")) == rows(t.select("x", "y", "amp"))
    np.save(tmp_path / "points.npy", np.array([[1, 2, 3, 0.5]]))
    assert rows(io.read_points_npy(spark, str(tmp_path / "points.npy"))) == [(1, 2, 3, 0.5)]


def test_segy(spark, tmp_path):
    n, traces = 5, 6
    a = np.arange(traces * n, dtype=">f4").reshape(traces, n)
    head = bytearray(3600)
    head[3220:3222], head[3224:3226] = n.to_bytes(2, "big"), (5).to_bytes(2, "big")
    (tmp_path / "s.sgy").write_bytes(bytes(head) + b"".join(b"\0" * 240 + r.tobytes() for r in a))
    t = io.read_segy(spark, str(tmp_path / "s.sgy"), 3)
    assert cube_shape(t) == (2, 3, 5) and t.where("x = 1 and y = 0").first().amp == [15, 16, 17, 18, 19]
    with pytest.raises(Exception, match="whole lines"):
        io.read_segy(spark, str(tmp_path / "s.sgy"), 4).count()
    assert io.ibm_floats(np.array([0xC276A000, 0x41100000, 0])).tolist() == [-118.625, 1.0, 0.0]


def test_files_are_read_in_stretches(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(7, 9, 11)).astype("f4")
    np.save(tmp_path / "A_x.npy", a)
    t = io.read_npy(spark, str(tmp_path / "A_x.npy"), 1000)
    whole = {(x, y): a[x, y].astype(float).tolist() for x in range(7) for y in range(9)}
    assert {(r.x, r.y): r.amp for r in t.collect()} == whole and t.count() == 63
    io.write_npy(t, str(tmp_path / "B_x.npy"), (7, 9, 11), "<f4")
    assert (np.load(tmp_path / "B_x.npy") == a).all()
    io.write_segy(t, str(tmp_path / "c.sgy"), (7, 9, 11))
    s = io.read_segy(spark, str(tmp_path / "c.sgy"), 9, 700)
    assert {(r.x, r.y): r.amp for r in s.collect()} == whole and s.count() == 63
    np.save(tmp_path / "flat.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="not a cube"):
        io.read_npy(spark, str(tmp_path / "flat.npy")).count()
    np.save(tmp_path / "none.npy", np.zeros((0, 3, 4)))
    assert io.read_npy(spark, str(tmp_path / "none.npy")).count() == 0


def test_dump_and_points_around_wells(spark, tmp_path):
    p = spark.createDataFrame([(0.5, 1, 2, None), (1.5, 3, 4, 2.5)], "phi double, x int, y int, f double")
    io.write_training_dump(p.fillna(0.0), str(tmp_path / "dump"), "phi", "x", "f")
    assert rows(io.read_training_dump(spark, str(tmp_path / "dump"), ["phi", "x", "f"])) == [(0.5, 1.0, 0.0), (1.5, 3.0, 2.5)]
    assert rows(io.around_wells(p.select("x", "y"), [(0, 1, 1), (1, 2, 3)], 1)) == [(1, 2, 0), (1, 2, 1), (3, 4, 1)]


def test_text_formats(spark, tmp_path):
    (tmp_path / "WELL1_log.csv").write_text("depth,por\n1.5,NaN\n2.5,20.0\n")
    (tmp_path / "OTHER_log.csv").write_text("depth,por\n1.5,1\n")
    wells = spark.createDataFrame([("well1",)], "well string")
    got = io.read_logs_of(spark, str(tmp_path / "*_log.csv"), "depth double, por double", wells)
    assert got.count() == 2 and got.select("well").distinct().collect()[0][0] == "WELL1"
    (tmp_path / "plain.txt").write_text("1 2.5\n3 4.5\n")
    assert rows(io.read_plain(spark, str(tmp_path / "plain.txt"), "a int, b double")) == [(1, 2.5), (3, 4.5)]
    (tmp_path / "w.las").write_text("~W\nNULL. -999.25 : none\n~A DEPTH POR\n 10.0 0.2\n 10.5 -999.25\n")
    las = io.read_las(spark, str(tmp_path / "w.las"))
    assert [r["values"] for r in las.orderBy("line").collect()] == [[10.0, 0.2], [10.5, None]]
    assert tuple(io.depth_range(las).first())[1:] == (10.0, 10.5)
    (tmp_path / "n.txt").write_text("x y z\n1 2 3\n\n4;5;6\n")
    assert rows(io.read_numbers(spark, str(tmp_path / "n.txt"), ["x", "y", "z"])) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "sets.txt").write_text("[('Norte_gst', (3, 0, 0)), ('Serra_azimuth', (-1, 0, 1))]\n[('Morro_rms-5', (0, 0, 0))]\n")
    assert rows(io.read_feature_sets(spark, str(tmp_path / "sets.txt"))) == [(0, 0, "Norte_gst", 3, 0, 0), (0, 1, "Serra_azimuth", -1, 0, 1), (1, 0, "Morro_rms-5", 0, 0, 0)]
    io.write_csv(spark.createDataFrame([(2, 1, 1, 0.5), (1, 1, 1, 0.25)], "x int, y int, z int, phi double"), str(tmp_path / "out"))
    assert io.read_csv(spark, str(tmp_path / "out"), "x int, y int, z int, phi double").count() == 2


def test_run_metrics(spark):
    lines = ["[1,1]<stdout>:[manager] [it3] Iteration best features: [('A', 1)] with errors: MAE 0.5 RMSE 0.75", "[1,0]<stdout>:[propagation] [it3] Test errors: RMSE: 8.25 MAE: 7.5",
             "[1,0]<stdout>:[propagation] [it3] Test errors: RMSE: 8.25 MAE: 7.5", "[1,0]<stdout>:[worker0] [it3] Iteration total time(s): 12.5"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(io.run_metrics(df, "expected")) == [(3, "[('A', 1)]", 0.5, 0.75)]
    assert rows(io.run_metrics(df, "test")) == [(3, 8.25, 7.5)] and rows(io.run_metrics(df, "times")) == [(3, 12.5)]


def test_config():
    c = config.load({"wells": {"coords": {"a": [1, 2], "b": [3, 4]}, "window": 2}, "alg": {"num_its": 3, "test_only_wells": [1], "save_models_on": "every_5", "generate_porosity_cube": "no"}}, {"alg": {"num_its": 7}})
    assert c.wells == [(0, 1, 2), (1, 3, 4)] and c.num_its == 7 and c.train_wells == [(0, 1, 2)] and c.test_wells == [(1, 3, 4)]
    assert c.save_every == 5 and not c.generate_porosity_cube and c.window == 2 and c.well_at(3, 4) == 1 and c.coords(0) == (1, 2)
    assert config.load("alg:\n  sampling:\n    max_points: 5\n").sampling.max_points == 5
    for bad in ({"alg": {"num_its": 0}}, {"alg": {"test_only_wells": [4]}}, {"wells": {"coords": [[1, 1], [1, 1]]}}, {"wells": {"coords": [[-1, 1]]}}):
        with pytest.raises(ValueError):
            config.load(bad)
        config.load(bad, check=False)
    with pytest.raises(TypeError):
        config.load({"alg": {"num_its": "x"}})
    c2 = config.load({"wells": {"coords": [{"x": "1", "y": 2}, {"x": 3, "y": 4}]}, "alg": {"starting_it": 7, "save_cube_every_n_its": 2, "parallel": {"max_points_per_chunk": 100}, "save_models_on": [1, 3]}})
    assert c2.wells == [(0, 1, 2), (1, 3, 4)] and c2.it == 7 and c2.save_cube_every == 2 and c2.max_points_per_chunk == 100 and c2.save_list == [1, 3]
    for bad in ({"alg": {"starting_iteration": 3}}, {"colour": 1}, {"alg": {"sampling": {"beta_dist": {"gamma": 2}}}}, {"alg": {"parallel": {"max_points_per_chunk": 0}}}):
        with pytest.raises(ValueError):
            config.load(bad)
    for bad in ([{"x": 1}], [[1]], 5):
        with pytest.raises(TypeError):
            config.load({"wells": {"coords": bad}})
    with pytest.raises(KeyError):
        c.well_at(9, 9)


def test_whole_run_and_resume(spark, tmp_path):
    from lithocube.operators import cube as cubes
    from lithocube.operators import gbdt, propagate
    from lithocube.operators.geometry import Box

    a = np.random.default_rng(1).normal(size=(9, 8, 5))
    wells = [(0, 2, 7), (1, 4, 2), (2, 7, 6)]
    p = spark.createDataFrame([(x, y, z, float(a[x, y, z] * 2), w) for w, x, y in wells for z in range(5)], "x int, y int, z int, phi double, well_id int")
    cube = cubes.overlay(cubes.empty_cube(spark, Box(9, 8, 5)), p)
    path = str(tmp_path / "cube")
    for ring in (0, -1):
        cubes.write_ring(cube.where(F.col("ring") == ring), path)
    t = spark.createDataFrame([("A", x, y, a[x, y].tolist()) for x in range(9) for y in range(8)], "feature string, x int, y int, amp array<double>")
    c = config.Config(wells=wells, test_only_wells=[2], window=0, num_its=2, params=gbdt.Params(rounds=10, min_data=1))
    done, its = run(cube, t, c, path)
    assert [i.points for i in its] == [65, 125] and all(i.chosen == [("A", (0, 0, 0))] for i in its) and its[0].errors
    assert {r.well_id: r["count"] for r in done.where("ring >= 0").groupBy("well_id").count().collect()} == {0: 75, 1: 125, 2: 5}
    assert spark.read.parquet(path).where("ring = 2").count() == 125
    c.it, c.num_its, c.sampling.max_points = 3, 1, 50
    assert run(done, t, c)[1][0].points > 0
    # Rings are appended: the cube is as if every point had been rewritten, and a saved model repeats its ring.
    assert done.count() == 360 and done.select("x", "y", "z").distinct().count() == 360 and done.where("real = 5").count() == 360 - 205
    c = config.Config(wells=wells, test_only_wells=[2], window=0, num_its=3, params=gbdt.Params(rounds=10, min_data=1), save_models_on=config.Save.EVERY_N, save_every=2, max_points_per_chunk=4)
    models = str(tmp_path / "models")
    now, its = run(cube, t, c, models=models)
    assert [r.it for r in spark.read.parquet(models).select("it").collect()] == [2]
    model, chosen = propagate.load_model(spark, models)
    ring, _ = propagate.propagate_ring(now.where("ring < 2"), t, wells, [2], chosen, (9, 8, 5), 2, model=model)
    assert ring.count() == 0  # nothing empty is left without the cube's empty points
    base = cubes.update_where(now, F.col("ring") >= 2, real=5, ring=-1, well_id=-1, phi=0.0)
    again, _ = propagate.propagate_ring(base, t, wells, [2], chosen, (9, 8, 5), 2, model=model)
    assert rows(again.select("x", "y", "z", "phi")) == rows(now.where("ring = 2").select("x", "y", "z", "phi"))
    assert propagate.load_model(spark, models, 2)[1] == chosen
    with pytest.raises(LookupError):
        propagate.load_model(spark, models, 1)
    c.wells = wells[:1]
    assert run(cube, t, c)[1][-1].ended.startswith("no candidate")


def test_ring_model_is_trained_on_the_sample(spark, monkeypatch):
    from lithocube.operators import cube as cubes
    from lithocube.operators import gbdt, propagate
    from lithocube.operators.geometry import Box

    wells = [(0, 2, 7), (1, 4, 2), (2, 7, 6)]
    p = spark.createDataFrame([(x, y, z, float(x + z), w) for w, x, y in wells for z in range(20)], "x int, y int, z int, phi double, well_id int")
    cube = cubes.overlay(cubes.empty_cube(spark, Box(9, 8, 20)), p)
    t = spark.createDataFrame([("A", x, y, [float(x + z) for z in range(20)]) for x in range(9) for y in range(8)], "feature string, x int, y int, amp array<double>")
    inner, sizes = propagate.fit, []
    monkeypatch.setattr(propagate, "fit", lambda points, *a: sizes.append(points.count()) or inner(points, *a, most=15))
    c = config.Config(wells=wells, window=0, num_its=1, params=gbdt.Params(rounds=5, min_data=1))
    c.sampling.max_points = 12
    assert run(cube, t, c)[1][0].points > 0 and sizes == [12]
    c.sampling.max_points = -1
    with pytest.raises(ValueError):
        run(cube, t, c)
    assert sizes == [12, 60]


def test_following_a_log(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("[it1] step done - seconds=12.5\niteration 1: validation - RMSE: 3.5\nnothing here\n(iter 2) took 4 s\n")
    q = latest(follow(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.table("progress")) == [(1, 3.5, 12.5, 2), (2, None, 4.0, 1)]

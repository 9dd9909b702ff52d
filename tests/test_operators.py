"""Cube, geometry, sampling, attribute and modelling operators against small worked examples and brute force."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lithocube.functions import curvature, scalars
from lithocube.operators import attributes, compare, cube, gbdt, geometry, logs, lookup, predicates, propagate, sampling, selection, stats, stencil
from lithocube.schema import CUBE, State

BOX = geometry.Box(9, 8, 5)
WELLS = [(0, 2, 7), (1, 4, 2), (2, 7, 6)]


def columns(spark, box=BOX):
    return cube.empty_cube(spark, box)


def logged(spark, box=BOX, wells=WELLS):
    p = [(x, y, k, float((x + 2) * (y + 2) * (k + 2) * 10), w) for w, x, y in wells for k in range(box.nz)]
    return cube.overlay(columns(spark, box), spark.createDataFrame(p, "x int, y int, z int, phi double, well_id int"))


def as_traces(spark, a, name="a"):
    nx, ny, _ = a.shape
    return spark.createDataFrame([(name, x, y, a[x, y].tolist()) for x in range(nx) for y in range(ny)], "feature string, x int, y int, amp array<double>")


def as_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.x, r.y] = r[name]
    return out


# Rings: columns per well after iterations 1, 2, 4 and 5 on a 9 by 8 volume; the third well only tests.


@pytest.mark.parametrize(("it", "want"), [(1, (6, 9)), (2, (15, 25)), (4, (23, 46)), (5, (24, 47))])
def test_columns_owned(spark, it, want):
    c = logged(spark)
    train = WELLS[:2]
    for ring in range(1, it + 1):
        got = geometry.frontier(c, train, ring)
        new = got.select("x", "y", "z", F.lit(1.0).alias("phi"), F.lit(1).alias("real"), "ring", "well_id")
        c = c.join(new.select("x", "y", "z"), ["x", "y", "z"], "left_anti").unionByName(new)
    n = {r.well_id: r.n for r in c.where("ring >= 0").groupBy("well_id").agg(F.count("*").alias("n")).collect()}
    assert (n[0], n[1], n[2]) == (want[0] * 5, want[1] * 5, 5)


def test_two_single_rings_are_one_double_ring_and_state_none_matches_nothing(spark):
    c = columns(spark)
    both = geometry.assign_rings(c.drop("ring", "well_id"), WELLS, 1).where("ring <= 2").count()
    assert geometry.frontier(c, WELLS, 1).count() + geometry.frontier(c, WELLS, 2).count() == both
    assert geometry.frontier(c, WELLS, 1, State.NONE).count() == 0


def test_single_well_geometry():
    assert geometry.predicted_by((0, 1, 1), 1, geometry.Box(4, 4, 30)) == 240
    assert geometry.predicted_by((0, 2, 2), 10, geometry.Box(10, 10, 10)) == 990
    box = geometry.Box(10, 10, 10)
    for a, b, it, want in (((0, 0, 0), (1, 2, 2), 0, 0), ((0, 0, 0), (1, 2, 2), 1, 10), ((0, 1, 1), (1, 3, 1), 1, 30), ((0, 1, 1), (1, 4, 4), 2, 40)):
        assert geometry.overlap_volume(a, b, it, box) == want
    with pytest.raises(TypeError):
        geometry.extent((0, 1, 1), 1.5, box)
    with pytest.raises(ValueError):
        geometry.checked([(0, 10, 1)], box)
    with pytest.raises(TypeError):
        geometry.Box(1.0, 2, 3)
    assert geometry.checked([(0, 1, 1), (1, 1, 1)], box) == [(0, 1, 1)]


def test_volumes_of_sets(spark):
    c = columns(spark, geometry.Box(10, 10, 10))
    v = geometry.covered_volumes(c, [(0, 1, 1), (1, 3, 3)], 2, 10).first()
    assert v.overlap == 70
    for wells, want in (([(0, 1, 1), (1, 5, 5)], 160), ([(0, 1, 1), (1, 3, 3)], 150)):
        assert geometry.covered_volumes(c, wells, 1, 10).first().predicted == want
    assert geometry.iterations_to_predict(c, [(0, 1, 1)], 10, 80).first().its == 1
    assert geometry.iterations_to_predict(c, [(0, 1, 1)], 10, 81).first().its == 2
    assert geometry.iterations_to_predict(c, [(0, 1, 1)], 10, 0).first().its == 0
    assert geometry.iterations_to_predict(c, [(0, 1, 1)], 10, 10**6).first().its is None
    assert list(geometry.rings_of_iteration(2, 3)) == [6, 7, 8]


def test_tiles_that_rings_touch(spark):
    box, tile = geometry.Box(30, 30, 1), 5
    tiles = spark.range(36).select((F.col("id") % 6).cast("int").alias("tx"), F.floor(F.col("id") / 6).cast("int").alias("ty"))
    well = [(0, 12, 17)]
    for ring in (0, 1, 4, 9):
        got = set(map(tuple, tiles.where(geometry.touches(well, ring, ring, tile)).collect()))
        want = {(x // tile, y // tile) for x in range(box.nx) for y in range(box.ny) if max(abs(x - 12), abs(y - 17)) == ring}
        assert want == got


# Predicates and cube.


def test_predicates(spark):
    c = logged(spark)
    p = predicates.Points()
    assert len(p) == 0 and p.of(c).count() == 360 and len(p.wells([])) == 0
    assert p.at_ring(0).of(c).count() == 15 and p.wells([0]).at_ring(3).at_ring(0).of(c).count() == 5
    assert str(p.wells([1]).from_ring(0)) == "min_ring and in_wells"
    for bad in (-1, 1.0, True):
        with pytest.raises(ValueError):
            p.from_ring(bad)
    with pytest.raises(TypeError):
        p.wells(3)


def test_overlay_canal_clear_zero_write(spark, tmp_path):
    pts = [(0, 0, 0, 5.0, 0), (1, 1, 1, 6.0, None), (2, 2, 2, float("nan"), 1), (0, 0, 0, 5.0, 0)]
    c = cube.overlay(cube.empty_cube(spark, geometry.Box(3, 3, 3)), spark.createDataFrame(pts, "x int, y int, z int, phi double, well_id int"), others=State.CANAL, other_ring=0)
    s = {(r.x, r.y, r.z): r for r in c.where("real <> 5").collect()}
    assert len(s) == 2 and s[0, 0, 0].real == 0 and s[1, 1, 1].real == 2 and s[1, 1, 1].well_id == -1 and s[1, 1, 1].ring == 0
    full = cube.fill_rings(logged(spark), WELLS, 3)
    assert cube.clear_after(full, 0).where("real = 1").count() == 0 and full.where("real = 1").count() > 0
    assert cube.zero_wells(logged(spark), [(2, 7)]).where("ring = 0").count() == 10
    path = str(tmp_path / "cube")
    cube.write_ring(logged(spark).where("ring = 0"), path)
    cube.write_ring(full.where("ring = 1"), path)
    cube.write_ring(full.where("ring = 1"), path)
    assert cube.known_before(spark, path, 2).count() == full.where("ring in (0, 1)").count()
    assert cube.known_before(spark, path, 2, 1).select("ring").distinct().collect()[0][0] == 1
    assert spark.createDataFrame([], CUBE).count() == 0


# Logs.


def test_means_and_interpolation(spark):
    d = np.arange(0, 5, 0.3)
    log = spark.createDataFrame([("w", float(x), float(x)) for x in d], "well string, depth double, por double")
    got = [round(r.por, 6) for r in logs.rolling_mean(log, ["well"], ["depth"], 5, ["por"]).orderBy("depth").collect()]
    want = [float(np.mean(d[max(0, i - 2) : i + 3])) for i in range(len(d))]
    assert got == [round(v, 6) for v in want] and got[:3] == [0.3, 0.45, 0.6] and got[-2:] == [4.35, 4.5][-2:]
    for n, want in ((1, [0.45, 1.5, 2.4, 3.45, 4.5]), (2, [0.9, 3.0, 4.5])):
        m = [r.por for r in logs.mean_every(log, ["well"], float(n), ["por"]).orderBy("step").collect()]
        assert np.allclose(m, want, atol=0.16)
    t = as_traces(spark, np.arange(1, 13, dtype=float).reshape(2, 2, 3))
    r = logs.resample_traces(t, [1, 2, 3], [1, 1.5, 2, 2.5, 3]).where("x = 0 and y = 0").first()
    assert r.amp == [1, 1.5, 2, 2.5, 3]
    a = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0), ("b", 5.0, 7.0), ("b", None, 1.0), ("b", 6.0, None)], "k string, depth double, v double")
    q = spark.createDataFrame([(-1.0,), (5.0,), (20.0,)], "depth double")
    assert rows(logs.interpolated(a, ["k"], q, ["v"])) == [("a", -1.0, 1.0), ("a", 20.0, 3.0), ("a", 5.0, 2.0), ("b", -1.0, 7.0), ("b", 20.0, 7.0), ("b", 5.0, 7.0)]


# Stencils and attributes, over two tiles.


@pytest.fixture(scope="module")
def block():
    return np.random.default_rng(5).normal(size=(37, 5, 7))


def brute(a, window, f):
    h = [w // 2 for w in window]
    p = np.pad(a, [(x, x) for x in h], mode="symmetric")
    return np.array([[[f(p[i : i + window[0], j : j + window[1], k : k + window[2]]) for k in range(a.shape[2])] for j in range(a.shape[1])] for i in range(a.shape[0])])


@pytest.mark.parametrize("how", ["mean", "median", "max"])
def test_moving(spark, block, how):
    got = as_array(stencil.moving_window(as_traces(spark, block), (3, 3, 5), how), "value", block.shape)
    assert np.allclose(got, brute(block, (3, 3, 5), stencil.REDUCTIONS[how]))


def test_even_window_and_parameters(spark, block):
    f = lambda v, axis, q: np.quantile(v, q, axis=axis)
    got = as_array(stencil.param_moving_window(as_traces(spark, block), (1, 1, 4), f, q=0.25), "value", block.shape)
    assert np.allclose(got, brute(block, (1, 1, 4), lambda v: np.quantile(v, 0.25)))


def test_coherences(spark, block):
    t, w = as_traces(spark, block), (3, 3, 5)
    flat = lambda v: v.reshape(-1, v.shape[-1])
    eig = lambda v: (lambda e: e.max() / e.sum())(np.linalg.eigvalsh(flat(v) @ flat(v).T))
    sem = lambda v: (flat(v) @ flat(v).T).sum() / np.trace(flat(v) @ flat(v).T) / 9
    k = {"eig": attributes.eigen_kernel(w), "sem": attributes.semblance_kernel(w), "rms": stencil.rms_kernel(5)}
    got = stencil.on_tiles(t, block.shape, (1, 1, 2), k).cache()
    want = brute(block, w, eig)
    assert np.allclose(as_array(got, "eig", block.shape), want) and np.allclose(as_array(got, "sem", block.shape), brute(block, w, sem))
    s = np.pad(want, 1, mode="symmetric")
    grads = []
    for axis in range(3):
        g = s
        for a in range(3):
            g = np.lib.stride_tricks.sliding_window_view(g, 3, axis=a) @ np.array([-1, 0, 1] if a == axis else [1, 2, 1])
        grads.append(g)
    assert np.allclose(as_array(attributes.sobel_coherence(t, w), "sobel", block.shape), np.sqrt(sum(g * g for g in grads)))
    c = as_array(attributes.structure_tensor_coherence(t, (3, 3, 3)), "gst", block.shape)
    assert np.all((c >= -1e-9) & (c <= 1 + 1e-9))


def test_structure_tensor_of_layers_is_one(spark):
    a = np.broadcast_to(np.sin(np.arange(16) / 2.0), (12, 12, 16)).copy()
    c = as_array(attributes.structure_tensor_coherence(as_traces(spark, a), (3, 3, 3)), "gst", a.shape)
    assert np.nanmin(c[:, :, 3:-3]) > 0.999


def test_surface_parameters(spark, block):
    p = attributes.surface_parameters(as_traces(spark, block)).toPandas().sort_values(["x", "y", "z"])
    zx, zy = np.gradient(block, axis=(0, 1))
    zxx, zxy = np.gradient(zx, axis=(0, 1))
    for c, v in zip("abcde", (zxx / 2, np.gradient(zy, axis=1) / 2, zxy, zx, zy)):
        assert np.allclose(p[c], v.ravel())


def test_surface_attributes_by_definition(spark):
    vals = [(0.3, -0.2, 0.1, 0.5, -0.4), (0.0, 0.0, 0.0, 0.0, 0.0), (0.2, 0.2, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(vals, "a double, b double, c double, d double, e double")
    got = [r.asDict() for r in curvature.with_shared(df).select(*[v.alias(n) for n, v in curvature.attributes().items()]).collect()]
    a, b, c, d, e = vals[0]
    km = (a * (1 + e * e) - c * d * e + b * (1 + d * d)) / (1 + d * d + e * e) ** 1.5
    kg = (4 * a * b - c * c) / (1 + d * d + e * e) ** 2
    assert math.isclose(got[0]["max_curvature"], km + math.sqrt(km * km - kg)) and math.isclose(got[0]["azimuth"], math.atan(e / d))
    assert math.isnan(got[1]["azimuth"]) and math.isnan(got[1]["shape_index"]) and math.isclose(got[2]["azimuth"], math.pi / 2)


def test_complex_trace(spark):
    n = 64
    a = np.cos(2 * np.pi * 4 * np.arange(n) / n)[None, None, :] * 3
    r = attributes.complex_trace(as_traces(spark, a)).first()
    assert np.allclose(r.envelope, 3) and np.allclose(r.frequency, 4) and np.allclose(np.diff(r.phase), 2 * np.pi * 4 / n)
    t = spark.createDataFrame([(0, 0, [1.0]), (0, 1, None)], "x int, y int, amp array<double>")
    assert [x.frequency for x in attributes.complex_trace(t).collect()] == [None, None]


# Lookup.


def test_gather(spark):
    i, j, k = np.indices((3, 4, 5))
    t = as_traces(spark, (i * j * k).astype(float))
    p = spark.createDataFrame([(1, 1, 1), (2, 3, 4), (2, 1, 2), (0, 0, 0)], "x int, y int, z int")
    assert {(r.x, r.y, r.z): r.f0 for r in lookup.displaced(p, t, 0, 0, 0, (3, 4, 5)).collect()} == {(1, 1, 1): 1, (2, 3, 4): 24, (2, 1, 2): 4, (0, 0, 0): 0}
    assert lookup.displaced(p, t, 5, 5, 5, (3, 4, 5)).where("x = 0").first().f0 == 24
    m = {(r.x, r.y, r.z): r["values"] for r in lookup.minicube(p, t, 1, (3, 4, 5)).collect()}
    assert len(m[1, 1, 1]) == 27 and m[1, 1, 1][0] == 0 and m[1, 1, 1][26] == 8 and m[1, 1, 1][13] == 1
    assert lookup.displacements(spark, 3).count() == 343 and lookup.displacements(spark, 3, True).count() == 7
    f = lookup.with_features(p, t, [("a", (0, 0, 1)), ("a", (0, 0, -1))], (3, 4, 5)).where("x = 1").first()
    assert (f.f0, f.f1) == (2, 0)


# Sampling.


def brute_quota(sizes, quota):
    total = sum(sizes)
    q = [math.ceil(n / total * quota) for n in sizes]
    while sum(q) > quota:
        q[max(range(len(q)), key=lambda i: q[i])] -= 1
    return [max(1, v) for v in q]


def test_quotas(spark):
    rng = np.random.default_rng(6)
    for seed in range(6):
        sizes = {(r, w): int(rng.integers(1, 60)) for r in range(3) for w in range(5)}
        p = spark.createDataFrame([(r, w, i, 0, 0) for (r, w), n in sizes.items() for i in range(n)], "ring int, well_id int, x int, y int, z int")
        most = int(sum(sizes.values()) * 0.4)
        rings = {r.ring: (r.n, r.quota) for r in sampling.ring_quotas(p, most).collect()}
        got: dict = {}
        for r in sampling.well_quotas(p, most).orderBy("ring", "well_id").collect():
            got.setdefault(r.ring, []).append(r.quota)
        for ring, (n, quota) in rings.items():
            assert quota == math.ceil(n / sum(sizes.values()) * most)
            assert got[ring] == brute_quota([v for (r, _), v in sorted(sizes.items()) if r == ring], quota), seed
        s = sampling.sample_points(p, most)
        assert s.count() == sum(map(sum, got.values())) and s.distinct().count() == s.count()
    assert sampling.sample_points(p, 10**6).count() == p.count() and sampling.sample_points(p, -1).count() == p.count()
    early = sampling.sample_points(p, most, alpha=1.0, beta=3.0, by_ring=True)
    assert early.count() == s.count()
    assert sampling.sample_points(p.limit(0), 5).count() == 0


def test_chunks(spark):
    p = spark.createDataFrame([(r, w, i, 0, 0) for r in range(2) for w in range(2) for i in range(7)], "ring int, well_id int, x int, y int, z int")
    n = {(r.ring, r.well_id, r.chunk): r["count"] for r in sampling.chunks(p, 3).groupBy("ring", "well_id", "chunk").count().collect()}
    assert [n[0, 0, c] for c in range(3)] == [3, 3, 1]
    assert [r["count"] for r in sampling.sequential_chunks(p, 3).groupBy("chunk").count().orderBy("chunk").collect()] == [10, 10, 8]


# Models.


def test_boosting_learns_and_stops():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (3000, 3))
    y = np.sin(2 * x[:, 0]) + np.where(x[:, 1] > 0.3, 1.0, 0.0) + rng.normal(0, 0.1, 3000)
    m = gbdt.train(x[:2000], y[:2000], gbdt.Params(), x[2000:], y[2000:])
    assert np.abs(m.predict(x[2000:]) - y[2000:]).mean() < 0.12
    noise = gbdt.train(x[:2000], rng.normal(size=2000), gbdt.Params(), x[2000:], rng.normal(size=1000))
    assert len(noise.trees) < 100
    more = gbdt.train(x[:2000], y[:2000], gbdt.Params(rounds=5), start=gbdt.train(x[:2000], y[:2000], gbdt.Params(rounds=5)))
    assert len(more.trees) == 10
    holes = x.copy()
    holes[::5, 2] = np.nan
    assert np.isfinite(gbdt.train(holes, y, gbdt.Params(rounds=3)).predict(holes)).all()
    assert gbdt.train(x[:1], y[:1]).predict(x[:2]).tolist() == [y[0]] * 2


def test_leaves_respect_limits():
    x = np.random.default_rng(1).normal(size=(500, 2))
    m = gbdt.train(x, x[:, 0], gbdt.Params(rounds=3, num_leaves=5, min_data=50, max_depth=2))
    for t in m.trees:
        assert (t.feature < 0).sum() <= 4
        leaf = np.unique(t.predict(x), return_counts=True)[1]
        assert leaf.min() >= 50


@pytest.fixture(scope="module")
def volume():
    a = np.random.default_rng(2).normal(size=(9, 8, 5))
    return a, np.random.default_rng(3).normal(size=(9, 8, 5))


def known(spark, target, wells=WELLS):
    p = [(x, y, z, float(target[x, y, z]), w) for w, x, y in wells for z in range(5)]
    return cube.overlay(columns(spark), spark.createDataFrame(p, "x int, y int, z int, phi double, well_id int"))


def test_selection_finds_the_displaced_feature(spark, volume):
    a, b = volume
    target = np.pad(a, ((0, 0), (0, 0), (0, 1)), mode="edge")[:, :, 1:] * 4
    wells = [(i, x, y) for i, (x, y) in enumerate([(1, 1), (4, 2), (7, 6), (2, 5), (6, 1), (4, 6)])]
    c = known(spark, target, wells)
    t = as_traces(spark, a, "A").unionByName(as_traces(spark, b, "B"))
    p = gbdt.Params(rounds=60, min_data=2, num_leaves=8)
    chosen, results = selection.forward_selection(predicates.SELECTION.of(c), t, 1, (9, 8, 5), 2, p, only_z=True)
    assert chosen[0] == ("A", (0, 0, 1)) and len(chosen) == 2 and chosen[1] != chosen[0]
    assert results.count() == 5 and results.where("folds = 6").count() == 5
    one = selection.forward_selection(predicates.SELECTION.wells([0]).of(c), t, 1, (9, 8, 5), 1, p, only_z=True)
    assert one[0] == []


def test_ring_is_predicted_and_scored(spark, volume):
    a, _ = volume
    c = known(spark, a * 3)
    p = gbdt.Params(rounds=80, min_data=1, num_leaves=12)
    t = as_traces(spark, a, "A")
    ring, errors = propagate.propagate_ring(c, t, WELLS, [2], [("A", (0, 0, 0))], (9, 8, 5), 1, p)
    assert ring.count() == (6 + 9 - 2) * 5 and set(ring.columns) == set(c.columns)
    assert {r.well_id for r in errors.collect()} == {2, None}
    e = propagate.against_key(ring, spark.createDataFrame([(x, y, z, float(a[x, y, z] * 3)) for x in range(9) for y in range(8) for z in range(5)], "x int, y int, z int, phi double"))
    assert e.agg(F.avg(F.abs("diff"))).first()[0] < 1.5
    done = propagate.replay(c, t, WELLS, [2], [[("A", (0, 0, 0))]] * 2, (9, 8, 5), 1, p)
    n = {r.well_id: r["count"] for r in done.where("ring >= 0").groupBy("well_id").count().collect()}
    assert n == {0: 75, 1: 125, 2: 5} and done.count() == 360


def test_parameter_search(spark, volume):
    a, _ = volume
    pts = lookup.with_features(predicates.SELECTION.of(known(spark, a)), as_traces(spark, a, "A"), [("A", (0, 0, 0))], (9, 8, 5))
    out = selection.parameter_search(pts, ["f0"], selection.random_space(spark, 3), gbdt.Params(min_data=1))
    assert out.count() == 3 and out.where("folds = 3").count() == 3


# Comparisons and statistics.


def test_compare(spark):
    s = "x int, y int, z int, phi double"
    a, b = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 2, 3.0)], s), spark.createDataFrame([(1, 1, 1, 1.0), (5, 5, 5, 3.0)], s)
    assert {r["merge"] for r in compare.full_compare(a, b).collect()} == {"both", "left_only", "right_only"}
    left, both = compare.left_compare(a, b)
    assert left.count() == 1 and both.first().phi_y == 1.0 and not compare.total_difference(a, b).first().same
    with pytest.raises(Exception, match="missing in the truth"):
        compare.checked_errors(a, b).collect()
    assert compare.checked_errors(b.limit(1), a).first().rmse == 1.0
    assert compare.without_repeats(a.unionAll(a))[1].first().repeats == 2 and compare.without_repeats(a.limit(0))[1].first().repeats == 0


def test_bootstrap_and_variance(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2 == 0).alias("side"), F.when(F.col("id") % 2 == 0, F.rand(1)).otherwise(F.rand(2) + 0.5).alias("v"))
    z = [r.z for r in stats.bootstrap_z(df, "v", "side", "id", n=50, reps=40).collect()]
    assert len(z) == 40 and -12 < np.mean(z) < -6
    e = stats.explained_variance(df.select("v", (F.col("v") * 2).alias("w")), ["v", "w"]).collect()
    assert abs(e[0].share - 1) < 1e-9 and abs(e[1].cumulative - 1) < 1e-9


def test_scalars(spark):
    assert scalars.yes_or_no("On") and not scalars.yes_or_no("n")
    with pytest.raises(ValueError):
        scalars.yes_or_no("perhaps")
    r = spark.range(1).select(scalars.round_half_even(F.lit(0.00005), 4).alias("a"), scalars.name_of_file(F.lit("/d/abc_1.csv")).alias("b"), scalars.beta_density(F.lit(0.5), 1.0, 1.0).alias("c"),
                              scalars.well_type(F.lit(1), F.lit(2500)).alias("d"), scalars.is_header(F.lit("depth por")).alias("e"), scalars.depth_index(F.lit(12.0), 5.0, F.lit(7.0)).alias("f")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (0.0, "ABC", 1.0, "complete", True, 1)


def test_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    pts = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (80, 2)))]
    box = geometry.Box(60, 60, 2)
    for it in (0, 1, 5):
        s = geometry.extents(spark.createDataFrame(pts, "well_id int, x int, y int"), box, F.lit(it))
        want = []
        for i, a in enumerate(pts):
            for b in pts[i + 1 :]:
                if it and (v := geometry.overlap_volume(a, b, it, box)):
                    want.append((a[0], b[0], v))
        assert rows(geometry.overlaps(s, box), "a", "b", "points") == sorted(want, key=repr)


def test_overlap_volumes_of_each_iteration(spark):
    rng = np.random.default_rng(8)
    pts = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 40, (70, 2)))] + [(70, 0, 0), (71, 0, 0), (72, 39, 39)]
    for n, wells in ((40, pts), (1, [(0, 0, 0), (1, 0, 0)])):
        box = geometry.Box(n, n, 2)
        got = geometry.overlap_volumes(spark.createDataFrame(wells, "well_id int, x int, y int"), box, 5)
        want = [(it, a[0], b[0], v) for it in range(6) for i, a in enumerate(wells) for b in wells[i + 1 :] if (v := geometry.overlap_volume(a, b, it, box))]
        assert rows(got, "it", "a", "b", "points") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        geometry.overlap_volumes(spark.createDataFrame(pts, "well_id int, x int, y int"), box, 0)


def test_overlaps_broadcast_no_squares(spark, tmp_path):
    """Squares in their cells are many times the wells that the planner counts: only the widest width is broadcast."""
    rng = np.random.default_rng(9)
    pts = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (80, 2)))]
    spark.createDataFrame(pts, "well_id int, x int, y int").write.parquet(f"{tmp_path}/wells")
    w, box = spark.read.parquet(f"{tmp_path}/wells"), geometry.Box(60, 60, 2)
    for df in (geometry.overlaps(geometry.extents(w, box, F.lit(5)), box), geometry.overlap_volumes(w, box, 8)):
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_many_areas_meet_wells_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    w = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 5000, (60, 2)))] + [(90, None, 3), (91, 10**8, 10**8)], "well_id long, x_coord int, y_coord int")
    a = spark.createDataFrame([(i, f"a{i}", int(x), int(x + d), int(y), int(y + d)) for i, (x, y, d) in enumerate(rng.integers(0, 4000, (40, 3)))] + [(99, "all", 0, 2 * 10**8, 0, 2 * 10**8)], "area_id long, area string, min_x int, max_x int, min_y int, max_y int")
    few = rows(logs.wells_in_areas(w, a)), rows(logs.first_area(w, a))
    monkeypatch.setattr(logs, "_few", lambda df, rows=0: False)
    assert (rows(logs.wells_in_areas(w, a)), rows(logs.first_area(w, a))) == few and len(few[0]) > 60 and len(few[1]) == 62


def test_interpolation_of_many_values_is_linear(spark):
    log = spark.createDataFrame([(1, float(z), float(z) if z % 3 else None, float(2 * z)) for z in range(0, 40, 2)] + [(2, 5.0, 1.0, None)], "w int, depth double, a double, b double")
    t = spark.createDataFrame([(float(z),) for z in range(-2, 42)], "depth double")
    got = {(r.w, r.depth): (r.a, r.b) for r in logs.interpolated(log, ["w"], t, ["a", "b"]).collect()}
    for z in range(-2, 42):
        assert got[1, float(z)] == (min(max(z, 2), 38), 2 * min(max(z, 0), 38)) and got[2, float(z)] == (1.0, None)


def test_stencils_go_axis_by_axis(spark, monkeypatch):
    rng = np.random.default_rng(8)
    padded = rng.normal(size=(9, 10, 12))
    for window in ((3, 3, 3), (1, 5, 3), (2, 3, 4)):
        for how, f in stencil.REDUCTIONS.items():
            views = stencil._views(padded, window)
            want = f(views.reshape(*views.shape[:3], -1), axis=-1)
            assert np.allclose(stencil.reduction(window, how)(padded), want)
    monkeypatch.setattr(stencil, "COPY", 100)
    v = stencil._views(padded, (3, 3, 3))
    assert np.allclose(stencil.reduction((3, 3, 3), "median")(padded), np.median(v.reshape(*v.shape[:3], -1), axis=-1))


def test_bootstrap_draws_about_n_a_side(spark):
    d = spark.range(3000).select("id", (F.col("id") % 3 == 0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    for n in (50, 2000):
        z = [r.z for r in stats.bootstrap_z(d, "v", "side", "id", n=n, reps=60).collect()]
        assert len(z) == 60 and abs(np.mean(z)) < 3 and 0.6 < np.std(z) < 1.5


def test_guided_search_halves_and_goes_on(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 2))
    pts = [(i % 3, int(i), 0, 0, 0 if i % 2 else 1, float(2 * a + b), float(a), float(b)) for i, (a, b) in enumerate(x)]
    p = spark.createDataFrame(pts, "well_id int, x int, y int, z int, real int, phi double, f0 double, f1 double")
    base = gbdt.Params(min_data=2, num_leaves=4)
    space = selection.random_space(spark, 9)
    g = selection.guided_search(p, ["f0", "f1"], space, base, (2, 6, 12), path=str(tmp_path / "search"))
    assert sorted((r.stage, r["count"]) for r in g.groupBy("stage").count().collect()) == [(0, 9), (1, 3), (2, 1)]
    first = {r.trial: r.rmse for r in g.where("stage = 0").collect()}
    assert {r.trial for r in g.where("stage = 1").collect()} == set(sorted(first, key=lambda k: (first[k], k))[:3])
    calls = []
    inner = selection.parameter_search
    selection.parameter_search = lambda pts_, f, s, b: calls.append(s.count()) or inner(pts_, f, s, b)
    try:
        again = selection.guided_search(p, ["f0", "f1"], space, base, (2, 6, 12), done=spark.read.parquet(str(tmp_path / "search")).where("stage < 2"))
    finally:
        selection.parameter_search = inner
    assert calls == [0, 0, 1] and rows(again, "stage", "trial", "rmse") == rows(g, "stage", "trial", "rmse")


def test_best_of_all_may_be_an_earlier_set(spark):
    s = "feature string, dx int, dy int, dz int, rmse double, mae double, folds int"
    one, two = spark.createDataFrame([("A", 0, 0, 0, 0.5, 0.4, 2)], s), spark.createDataFrame([("B", 0, 0, 0, 0.6, 0.4, 2), ("C", 0, 0, 0, None, None, 0)], s)
    r = selection.best_of_all([one, two]).first()
    assert (r["feature"], r["round"]) == ("A", 0)


def test_models_are_written_and_read_exactly():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 3))
    m = gbdt.train(x, x[:, 0] * 2 + x[:, 1], gbdt.Params(rounds=20, min_data=5))
    assert (gbdt.Model.loads(m.dumps()).predict(x) == m.predict(x)).all()


def test_random_wells_and_scratch_sets(spark):
    box = geometry.Box(7, 5, 3)
    w = cube.random_wells(spark, box, 35, first_id=10)
    assert w.count() == 105 and w.select("x", "y").distinct().count() == 35 and w.agg(F.min("well_id")).first()[0] == 10
    with pytest.raises(ValueError):
        cube.random_wells(spark, box, 36)
    c = cube.overlay(cube.empty_cube(spark, box), w.where("well_id < 14"))
    train, test = cube.scratch_sets(c, [12])
    assert train.count() == 9 and test.count() == 3 and cube.scratch_sets(c, [], 0.0)[0].count() == 0


def test_functions_of_the_user(spark, tmp_path):
    log = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 7.0)], "w int, v double")
    got = logs.by_well(log, ["w"], lambda p: p.groupby("w", as_index=False, dropna=False).agg(v=("v", "sum")), "w int, v double")
    assert rows(got) == sorted([(1, 6.0), (None, 7.0)], key=repr)
    t = spark.createDataFrame([(x, y, [1.0, 2.0]) for x in range(3) for y in range(2)], "x int, y int, amp array<double>")
    made = attributes.apply_and_save(t, {"A": lambda v: v, "B": lambda v: 1 / 0, "C": lambda v: v.select("x", "y", F.expr("assert_true(x > 5)").alias("amp"))}, str(tmp_path / "f"))
    assert [(r.feature, r.error is None) for r in made.collect()] == [("A", True), ("B", False), ("C", False)]
    assert spark.read.parquet(str(tmp_path / "f")).where("feature = 'A'").count() == 6


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    from lithocube.session import small

    hint = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    d = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit(1)).alias("a"))
    assert hint(small(d)) and not hint(small(d, rows=49)) and not hint(small(d, bytes_=40_000)) and hint(small(d.select("id"), bytes_=0))
    assert hint(small(d.limit(0)))


def test_too_many_training_points_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_POINTS", 3)
    p = spark.range(4).select(F.col("id").cast("int").alias("x"))
    with pytest.raises(ValueError):
        selection.bounded(p)
    assert selection.bounded(p.limit(3)).count() == 3


def test_rolling_means_of_long_series_are_cut(spark):
    rng = np.random.default_rng(11)
    data = [(w, i, float(rng.normal()) if i % 7 else None, float(i)) for w, n in ((1, 900), (None, 400), (2, 30)) for i in range(n)]
    log = spark.createDataFrame(data, "w int, i int, v double, u double")
    for window in (1, 4, 5):
        whole, pieces = (rows(logs.rolling_mean(log, ["w"], ["i"], window, ["v", "u"], stretch=s).select("w", "i", F.round("v", 9), F.round("u", 9))) for s in (10_000, 50))
        assert whole == pieces and len(whole) == 1330

import numpy as np
import pytest
from conftest import rows

from lithocube.operators.regrid import _project, regular_grid, ssa_fill

SCHEMA = "log_id long, run_id long, campaign string, depth double, density_por double, bucket string, value int"
STEPS = "campaign string, n_meters int"


def grid(spark, data, steps=(("a", 1), ("b", 2))):
    return regular_grid(spark.createDataFrame([(*r, "", 0) for r in data], SCHEMA), spark.createDataFrame(list(steps), STEPS))


def test_ssa_restores_a_sine():
    t = np.arange(200)
    x = np.sin(t / 5.0) + 3
    y = x.copy()
    y[[20, 21, 22, 80, 81, 140]] = np.nan
    out = ssa_fill(y[None])[0]
    assert np.abs(out - x).max() < 0.1
    known = ~np.isnan(y)
    assert np.array_equal(out[known], x[known])


def test_ssa_short_constant_and_whole():
    assert ssa_fill(np.array([[1.0, np.nan, 3.0]])).tolist() == [[1.0, 2.0, 3.0]]
    assert ssa_fill(np.array([[5.0] + [np.nan] * 10 + [5.0]]))[0].tolist() == [5.0] * 12
    assert ssa_fill(np.arange(20.0)[None])[0].tolist() == list(range(20))


def test_steps_means_and_marks(spark):
    g = grid(spark, [(1, 1, "a", 10.2, 20.0), (2, 1, "a", 10.9, 22.0), (2, 1, "a", 10.9, 22.0), (3, 1, "a", 13.0, 25.0), (4, 2, "b", -1.0, 7.0), (5, 2, "b", 4.0, 9.0)])
    assert rows(g, "run_id", "bucket", "n_readings", "filled") == [
        (1, 10, 2, False), (1, 11, 0, True), (1, 12, 0, True), (1, 13, 1, False), (2, -1, 1, False), (2, 0, 0, True), (2, 1, 0, True), (2, 2, 1, False),
    ]
    v = {(r.run_id, r.bucket): r.density_por for r in g.collect()}
    assert v[1, 10] == 21.0 and 21 < v[1, 11] < v[1, 12] < 25


def test_missing_null_and_wrong_readings(spark):
    nan = float("nan")
    data = [(1, 1, "a", 1.0, 20.0), (2, 1, "a", 2.0, -999.25), (3, 1, "a", 3.0, nan), (4, 1, "a", None, 20.0), (5, 1, "a", nan, 20.0), (6, 1, "a", 4.0, -7.0),
            (7, None, "a", 9.0, 1.0), (8, 3, None, 9.0, 1.0), (9, 4, "zz", 9.0, 1.0), (None, 1, "a", 6.0, 21.0)]
    g = grid(spark, data)
    assert rows(g, "run_id", "bucket", "filled") == [(1, b, b in (2, 3, 5)) for b in range(1, 7)]


def test_long_holes_cross_blocks(spark):
    data = [(1, 1, "a", 5.0, 10.0), (2, 1, "a", 1305.0, 30.0), (3, 1, "a", 1306.0, 30.0)]
    g = {r.bucket: r for r in grid(spark, data).collect()}
    assert sorted(g) == list(range(5, 1307))
    v = [g[b].density_por for b in range(5, 1307)]
    assert all(x is not None and 9.9 <= x <= 30.1 for x in v)
    assert abs(v[650] - 20) < 2


def test_blocks_do_not_change_what_is_filled(spark):
    rng = np.random.default_rng(3)
    keep = np.sort(rng.choice(900, 500, replace=False))
    data = [(int(i), 1, "a", float(i) + 0.5, 20 + float(np.sin(i / 9))) for i in keep]
    g = grid(spark, data).collect()
    assert {r.bucket for r in g if not r.filled} == set(map(int, keep))
    assert max(abs(r.density_por - (20 + np.sin(r.bucket / 9))) for r in g) < 1.5


def test_empty(spark):
    assert grid(spark, []).count() == 0
    assert grid(spark, [(1, 1, "a", 1.0, 2.0)], ()).count() == 0


def test_ssa_goes_on_until_nothing_moves():
    rng = np.random.default_rng(0)
    x = 20 + np.cumsum(rng.normal(0, 0.5, (12, 320)), axis=1)
    gap = np.zeros(x.shape, bool)
    gap[:, 100:151] = True
    x[gap] = np.nan
    y, m = ssa_fill(x), np.nanmean(x, axis=1, keepdims=True)
    again = np.clip(_project(y - m, 12, 2) + m, np.nanmin(x, axis=1, keepdims=True), np.nanmax(x, axis=1, keepdims=True))
    moved = np.abs(again - y)[gap].reshape(12, -1).max(axis=1)
    assert (moved <= 1.01e-3 * np.nanstd(x, axis=1)).all()
    with pytest.raises(ValueError):
        ssa_fill(x, most=30)

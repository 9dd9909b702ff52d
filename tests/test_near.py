import numpy as np
import pytest
from conftest import rows

from lithocube.operators.near import inside_pairs, near_pairs, near_spots

POINTS = "well_id long, x_coord double, y_coord double, id string, cx int"
AREAS = "area_id long, min_x double, max_x double, min_y double, max_y double, rid string"


def points(spark, data):
    return spark.createDataFrame([(*r, "", 1) for r in data], POINTS)


def brute_near(data, d):
    ok = {(w, x, y) for w, x, y in data if w is not None and x is not None and y is not None and x >= 0 and y >= 0}
    return sorted({(min(a, b), max(a, b)) for a, ax, ay in ok for b, bx, by in ok if a != b and (ax - bx) ** 2 + (ay - by) ** 2 <= d * d})


@pytest.mark.parametrize(("seed", "scale"), [(0, 100), (1, 1000), (2, 20_000)])
def test_random_points(spark, seed, scale):
    rng = np.random.default_rng(seed)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, scale, (300, 2)).round())]
    assert rows(near_pairs(points(spark, data), 25)) == sorted(brute_near(data, 25), key=repr)


def test_rim_one_spot_unknown_and_repeats(spark):
    data = [(1, 0.0, 0.0), (2, 15.0, 20.0), (3, 15.0, 20.1), (4, 5000.0, 5000.0), (5, 5000.0, 5000.0), (5, 5000.0, 5000.0), (6, 5000.0, 5000.0),
            (7, None, 1.0), (8, -1.0, 0.0), (9, float("nan"), 0.0), (None, 0.0, 0.0), (10, 63.9, 0.0), (11, 64.1, 0.0)]
    assert rows(near_pairs(points(spark, data), 25)) == sorted([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6), (10, 11)], key=repr)


def test_crowded_spot_is_whole(spark):
    data = [(i, 10.0, 10.0) for i in range(120)] + [(1000 + i, 10.0 + i, 400.0) for i in range(40)]
    assert rows(near_pairs(points(spark, data), 25)) == sorted(brute_near(data, 25), key=repr)


def test_spots_stand_for_their_keys(spark):
    data = [(i, 10.0, 10.0) for i in range(50)] + [(100, 20.0, 10.0), (101, 20.0, 10.0), (101, 30.0, 10.0), (102, 500.0, 1.0), (103, None, 1.0), (None, 11.0, 10.0)]
    pairs, members = near_spots(points(spark, data), 12)
    assert rows(pairs) == [(10.0, 10.0, 20.0, 10.0), (20.0, 10.0, 30.0, 10.0)]
    m = rows(members)
    assert len(m) == 54
    spot = {(r.a_x, r.a_y, r.b_x, r.b_y) for r in pairs.collect()}
    near = {(a[0], b[0]) for a in m for b in m if a[0] < b[0] and (a[1:] == b[1:] or (*a[1:], *b[1:]) in spot or (*b[1:], *a[1:]) in spot)}
    assert near == set(brute_near(data, 12))


def test_regions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30_000, (400, 2)))] + [(900, 100.0, 200.0), (901, None, 3.0), (902, -5.0, 5.0)]
    areas = [(1, 0.0, 20_000.0, 0.0, 20_000.0), (2, 9000.0, 5000.0, 12_000.0, 4000.0), (3, 100.0, 100.0, 200.0, 200.0), (4, None, 9e9, 0.0, 9e9), (5, 25_000.0, 1e9, -1e9, 1e9),
             (6, 9e6, 9.1e6, 0.0, 5.0), (7, -50.0, -10.0, 0.0, 9e9), (1, 0.0, 20_000.0, 0.0, 20_000.0)]
    want = sorted({(a, p) for p, x, y in data if x is not None and x >= 0 for a, x0, x1, y0, y1 in areas if x0 is not None and min(x0, x1) <= x <= max(x0, x1) and min(y0, y1) <= y <= max(y0, y1)}, key=repr)
    got = rows(inside_pairs(points(spark, data), spark.createDataFrame([(*a, "") for a in areas], AREAS)))
    assert got == want and (3, 900) in got
    monkeypatch.setattr("lithocube.operators.near.BROADCAST_ROWS", 1)
    assert rows(inside_pairs(points(spark, data), spark.createDataFrame([(*a, "") for a in areas], AREAS))) == want
    far = [*data, (903, 9e14, 9e14)]
    wide = [(1, 0.0, 9.5e14, 0.0, 9.5e14, "")]
    monkeypatch.undo()
    assert len(rows(inside_pairs(points(spark, far), spark.createDataFrame(wide, AREAS)))) == 402


def test_empty(spark):
    none = points(spark, [])
    areas = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, "")], AREAS)
    assert near_pairs(none, 25).count() == 0 and inside_pairs(none, areas).count() == 0
    assert inside_pairs(points(spark, [(1, 0.5, 0.5)]), areas.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_pairs(none, 0)

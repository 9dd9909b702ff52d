from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("lithocube.llm")
from lithocube.llm.splits import component_table, point_groups, split_points  # noqa: E402

POINTS = "point_id long, x double, y double, component long, label string"
WELLS = "well_id long, x_coord int, y_coord int, test_area double, sx string"
TARGETS = "split_name string, target_share double"
SHARES = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def points(spark, data):
    return spark.createDataFrame([(*r, 1, "") for r in data], POINTS)


def wells(spark, data):
    return spark.createDataFrame([(i, *r, "") for i, r in enumerate(data)], WELLS)


def brute(pts, wls):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    placed = set()
    for p, x, y in pts:
        if p is not None and x is not None and y is not None and x == x and y == y:
            parent[find(("point", p))] = find(("spot", round(x), round(y)))
            placed.add(p)
    for x, y, a in wls:
        if x is not None and y is not None and x >= 0 and y >= 0 and a is not None and a == a:
            parent[find(("spot", x, y))] = find(("area", a))
    root = {p: find(("point", p)) for p in placed}
    return sorted((min(q for q in placed if root[q] == root[p]), p) for p in placed)


def groups(spark, pts, wls, existing=None):
    p = points(spark, pts)
    return sorted(map(tuple, point_groups(p, component_table(p, wells(spark, wls), existing)).collect()))


def test_random_links(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        pts = [(i, float(x) + rng.uniform(-0.4, 0.4), float(y)) for i, (x, y) in enumerate(rng.integers(0, 12, (60, 2)))]
        wls = [(int(x), int(y), float(a)) for x, y, a in zip(*rng.integers(0, 12, (2, 60)), rng.integers(0, 25, 60))]
        assert groups(spark, pts, wls) == brute(pts, wls)


def test_a_point_on_two_spots_links_them(spark):
    pts = [(1, 0.0, 0.0), (2, 0.0, 0.0), (2, 5.0, 5.0), (3, 5.0, 5.0), (4, 9.0, 9.0)]
    assert groups(spark, pts, []) == brute(pts, []) == [(1, 1), (1, 2), (1, 3), (4, 4)]
    out, _ = split_points(points(spark, pts), wells(spark, []), spark.createDataFrame(SHARES, TARGETS))
    assert len(out.collect()) == 4 and len({r.split for r in out.where("point_id < 4").collect()}) == 1


def test_chain_over_spots_without_points(spark):
    pts = [(1, 0.0, 0.0), (2, 50.0, 0.0)]
    wls = [(i + d, 0, float(i)) for i in range(50) for d in (0, 1)]
    assert groups(spark, pts, wls) == [(1, 1), (1, 2)]
    assert groups(spark, pts, wls[:60]) == [(1, 1), (2, 2)]


def test_points_on_no_spot_keep_their_split(spark):
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.5)], TARGETS)
    first, table = split_points(points(spark, [(i, None, 1.0) for i in range(40)] + [(100, 3.0, 3.0)]), wells(spark, []), targets)
    was = {r.point_id: r.split for r in first.collect()}
    assert len(was) == 41 and abs(sum(v == "a" for v in was.values()) - 20.5) < 8 and table.where("sx is null").count() == 40
    now = [(i, float(i), 5.0) for i in range(20)] + [(i, None, None) for i in range(20, 40)] + [(100, 3.0, 3.0), (200, None, None)]
    second, again = split_points(points(spark, now), wells(spark, []), spark.createDataFrame([("a", 0.9), ("b", 0.1)], TARGETS), table)
    got = {r.point_id: r for r in second.collect()}
    assert all(got[i].split == was[i] and got[i].state == "kept" for i in was) and got[200].state == "new"
    assert again.where("sx is null").count() == 21
    # Two such points of different splits on one spot are a conflict.
    i, j = next((a, b) for a in range(40) for b in range(40) if was[a] != was[b])
    third, _ = split_points(points(spark, [(i, 7.0, 7.0), (j, 7.0, 7.0)]), wells(spark, []), targets, table)
    assert {(r.split, r.state) for r in third.collect()} == {(None, "quarantined")}


def test_long_chain(spark):
    pts = [(100 - i, float(i), 0.0) for i in range(60)]
    wls = [(i + d, 0, float(i)) for i in range(59) for d in (0, 1)]
    assert {g for g, _ in groups(spark, pts, wls)} == {41}


def test_unknown_places_and_areas(spark):
    nan = float("nan")
    pts = [(1, 5.0, 5.0), (2, 9.0, 9.0), (3, None, 5.0), (4, nan, 5.0), (None, 5.0, 5.0), (6, 5.4, 4.6), (6, 5.4, 4.6), (7, 20.0, 20.0), (8, 30.0, 30.0)]
    wls = [(5, 5, None), (9, 9, None), (5, 5, nan), (9, 9, nan), (None, 9, 1.0), (20, 20, 2.0), (40, 40, 2.0), (40, 40, 3.0), (30, 30, 3.0)]
    assert groups(spark, pts, wls) == [(1, 1), (1, 6), (2, 2), (7, 7), (7, 8)]


def test_shares_and_whole_groups(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(rng.integers(0, 600)), 0.0) for i in range(4000)] + [(10_000 + i, -7.0, -7.0) for i in range(900)] + [(20_000, None, 1.0)]
    out, table = split_points(points(spark, pts), wells(spark, [(i, 0, float(i // 3)) for i in range(600)]), spark.createDataFrame(SHARES, TARGETS))
    got = out.collect()
    assert len(got) == 4901 and len({r.point_id for r in got}) == 4901
    assert all(len(s) == 1 for s in [{r.split for r in got if r.component == c} for c in {r.component for r in got} - {None}])
    n = {k: sum(r.split == k for r in got) / len(got) for k, _ in SHARES}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["test"] - 0.1) < 0.02
    assert all(r.state == "new" and r.split for r in got) and table.where("size(split) <> 1").count() == 0


def test_persisted_components_keep_grow_and_conflict(spark):
    pts = [(i, float(i), 0.0) for i in range(40)]
    targets = spark.createDataFrame(SHARES, TARGETS)
    first, table = split_points(points(spark, pts), wells(spark, []), targets)
    was = {r.point_id: r.split for r in first.collect()}
    same = next((a, b) for a in was for b in was if a < b and was[a] == was[b])
    other = next((a, b) for a in was for b in was if a not in same and b not in same and was[a] != was[b])
    more = [*pts, (100, float(same[0]), 0.0), (101, 500.0, 0.0)]
    links = [(same[0], 0, 1.0), (same[1], 0, 1.0), (other[0], 0, 2.0), (other[1], 0, 2.0)]
    second, again = split_points(points(spark, more), wells(spark, links), targets, table)
    now = {r.point_id: r for r in second.collect()}
    assert all(now[i].split == was[i] and now[i].state == "kept" for i in was if i not in other)
    assert all(now[i].split is None and now[i].state == "quarantined" for i in other)
    assert now[100].split == was[same[0]] and now[101].state == "new" and now[101].split
    # Links that are no longer stated do not part a component, and a conflict stays one.
    third = {r.point_id: r for r in split_points(points(spark, more), wells(spark, []), targets, again)[0].collect()}
    assert third[same[0]].component == third[same[1]].component and third[other[0]].state == "quarantined"
    # Points that are gone keep their component in the table.
    gone, kept = split_points(points(spark, more[-1:]), wells(spark, []), targets, again)
    assert gone.count() == 1 and kept.count() == again.count()


def test_empty(spark):
    targets = spark.createDataFrame(SHARES, TARGETS)
    out, table = split_points(points(spark, []), wells(spark, []), targets)
    assert out.count() == 0 and table.count() == 0
    out, _ = split_points(points(spark, [(1, 1.0, 1.0)]), wells(spark, []), targets.limit(0))
    assert [r.split for r in out.collect()] == [None]

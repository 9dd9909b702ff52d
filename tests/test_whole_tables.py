"""Queries that have to see all of their tables, not a part."""

from lithocube.plans import engine_queries as q
from lithocube.plans.fixtures import FILLED, NZ, TRAIN, state
from lithocube.plans.registry import QUERIES


def known(spark, data):
    return state(spark, data).where("real in (0, 1, 3)").where(f"well_id in ({', '.join(str(w[0]) for w in TRAIN)})").count()


def seen(monkeypatch, name):
    """Points that `selection.name` is called with."""
    inner, points = getattr(q.selection, name), []
    monkeypatch.setattr(q.selection, name, lambda p, *a, **k: points.append(p.select("ring", "x", "y", "z")) or inner(p, *a, **k))
    return points


def test_selection_takes_all_known_points_and_displacements(spark, data, monkeypatch):
    points = seen(monkeypatch, "forward_selection")
    results = QUERIES["m4_trials"](spark, data)
    assert results.select("feature", "dx", "dy", "dz").distinct().count() == 2 * 27
    QUERIES["m10_forward_selection"](spark, data)
    for p in points:
        assert p.count() == known(spark, data) and p.agg({"ring": "max"}).first()[0] == FILLED


def test_parameter_search_takes_all_known_points(spark, data, monkeypatch):
    points = seen(monkeypatch, "parameter_search")
    QUERIES["h1_parameter_search"](spark, data)
    assert points[0].count() == known(spark, data)


def test_explained_variance_of_all_samples(spark, data):
    e = QUERIES["a25_explained_variance"](spark, data).orderBy("component").collect()
    assert len(e) == NZ and abs(e[-1]["cumulative"] - 1) < 1e-9

import pytest

pytest.importorskip("lithocube.llm")
from lithocube.llm.mixing import mix_sources  # noqa: E402

DOCS = "doc_id long, text string, source string, h int, uses string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, counts, words=20):
    rows, i = [], 0
    for s, n in counts.items():
        for _ in range(n):
            rows.append((i, "ruling " * (1 + (i * 7919) % (2 * words)), s, 1, ""))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def run(spark, d, targets, **k):
    mixed, report = mix_sources(d, spark.createDataFrame(targets, TARGETS), **k)
    return mixed.collect(), {r.source: r for r in report.collect()}


def test_shares_are_met_and_repeats_capped(spark):
    d = docs(spark, {"a": 2000, "b": 500, "c": 100, "x": 50, None: 5})
    got, rep = run(spark, d, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("gone", 0.1, 3), ("x", None, 2)])
    whole = 0.9
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(rep[s].share_reached - share / whole) < 0.003
    assert rep["gone"].tokens_used == rep["x"].tokens_used == 0 and None not in rep
    caps = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.uses <= caps[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    assert max(r.uses for r in got if r.source == "c") == 4
    for s, r in rep.items():
        assert r.tokens_used == sum(g.n_tokens * g.uses for g in got if g.source == s)
    # One more token is not possible: some source is used to its cap.
    assert any(rep[s].tokens_used >= 0.99 * caps[s] * rep[s].tokens for s in caps)


def test_smaller_mixtures_are_nested(spark):
    d = docs(spark, {"a": 800, "b": 800})
    t = [("a", 0.7, 1), ("b", 0.3, 1)]
    small = {r.doc_id for r in run(spark, d, t, total=4000)[0]}
    large = {r.doc_id for r in run(spark, d, t, total=9000)[0]}
    assert small and small < large


def test_asked_for_more_than_there_is(spark):
    got, rep = run(spark, docs(spark, {"a": 20, "b": 300}), [("a", 0.5, 2), ("b", 0.5, 1)], total=5000)
    assert rep["a"].tokens_used == 2 * rep["a"].tokens and rep["a"].share_reached < 0.5
    assert abs(rep["b"].tokens_used - 2500) < 60


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "a", 0, ""), (2, "", "a", 0, ""), (3, "word " * 30_000, "a", 0, ""), (4, "word", "b", 0, ""), (None, "word", "b", 0, ""), (5, "x", None, 0, "")], DOCS)
    got, rep = run(spark, d, [("a", 0.5, 1), ("a", 0.5, 1), ("b", 0.5, 100_000), (None, 0.5, 1), ("c", float("nan"), 1), ("d", -1.0, 1), ("e", 0.5, 0)])
    assert {r.doc_id for r in got} >= {3, 4} and 1 not in {r.doc_id for r in got} and abs(rep["a"].share_reached - 0.5) < 0.01
    assert rep["c"].tokens_used == 0


def test_empty(spark):
    got, rep = run(spark, docs(spark, {}), [("a", 1.0, 1)])
    assert got == [] and rep["a"].share_reached == 0
    got, rep = run(spark, docs(spark, {"a": 3}), [("b", 1.0, 1)])
    assert got == [] and rep["a"].tokens > 0

import numpy as np
from conftest import rows

from lithocube.operators.segments import nth, ranked, segmented


def test_places_at_one_depth_and_far_off(spark):
    data = [(1, 5.0, i) for i in range(500)] + [(1, 1e300, 7), (1, float("inf"), 8), (2, 1.0, 1)]
    got = ranked(spark.createDataFrame(data[::-1], "k long, depth double, id long"), "k", ["depth", "id"])
    assert rows(got) == sorted([(*r, i if r[0] == 1 else 0) for i, r in enumerate(data)], key=repr)


def test_halo_reaches_over_short_segments(spark):
    got = segmented(spark.range(10).withColumnRenamed("id", "rank"), 2, 3)
    own = {r["rank"]: r["seg"] for r in got.where("core").collect()}
    assert own == {i: i // 2 for i in range(10)}
    assert sorted(r["rank"] for r in got.where("seg = 2").collect()) == list(range(1, 9))


def test_nth_is_exact(spark):
    rng = np.random.default_rng(0)
    x = {k: np.abs(rng.normal(size=n)).view(np.int64) if k else np.full(n, 2**62) for k, n in ((0, 40), (1, 1), (2, 777))}
    df = spark.createDataFrame([(k, int(b)) for k, v in x.items() for b in v], "k long, b long")
    places = [(k, n) for k, v in x.items() for n in {0, len(v) // 2, len(v) - 1}]
    got = nth(df, "k", "b", spark.createDataFrame(places, "k long, n long"))
    assert sorted(map(tuple, got.collect())) == sorted((k, n, int(np.sort(x[k])[n])) for k, n in places)

from datetime import datetime

import numpy as np
from conftest import rows

from lithocube.operators.spikes import PHASES, flag_series, flag_spikes, flagged_cells, pareto_cutoff, seasonal

SCHEMA = "log_id long, run_id long, depth double, neutron_por double, density_por double, sonic_por double, received_at timestamp, flag string, seg int"
T = datetime(2031, 1, 1)


def one(x, fraction=False):
    x = np.asarray(x, float)
    return flag_series(x, np.zeros(len(x), int), np.array([fraction]))[0].tolist()


def noise(n, seed=1, scale=0.2):
    return 20 + np.random.default_rng(seed).normal(0, scale, n)


def brute(x, times=10.0):
    """The definition, value by value: episodes of one to three between medians of seven values on both sides."""
    out = [0] * len(x)
    stretch = 1
    for i in range(len(x)):
        stretch = stretch + 1 if i and x[i] == x[i - 1] else 1
        if stretch >= 6:
            out[i - stretch + 1 : i + 1] = [2] * stretch
    for i, v in enumerate(x):
        if v < 0 or v > 100:
            out[i] = 1
    rest = [i for i in range(len(x)) if not out[i]]
    v = x[rest]
    level = np.array([np.median(v[max(0, i - 4) : i + 5]) for i in range(len(v))])
    far = times * 1.4826 * np.median(np.abs(v - level))
    for i in range(len(v)):
        for n in (1, 2, 3):
            before, after = v[max(0, i - 7) : i], v[i + n : i + n + 7]
            if i + n <= len(v) and len(before) and len(after):
                part = v[i : i + n]
                b, a = np.median(before), np.median(after)
                back = all(min(abs(e - b), abs(e - a)) <= far for e in (v[i - 1], v[i + n]))
                if back and all(abs(part - b) > far) and all(abs(part - a) > far):
                    for j in range(n):
                        out[rest[i + j]] = 3
    return out


def test_against_the_definition():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = noise(150, seed)
        for _ in range(4):
            at, n = rng.integers(5, 140), rng.integers(1, 5)
            x[at : at + n] += rng.choice([-1, 1]) * rng.uniform(3, 9)
        x[60:] += rng.uniform(0, 6)
        x[100 : 100 + rng.integers(4, 9)] = x[100]
        x[rng.integers(0, 150)] = rng.choice([-1.0, 150.0])
        assert one(x) == brute(x)


def test_spikes_of_one_to_three_but_no_lasting_change():
    for n in (1, 2, 3):
        x = noise(80)
        x[40 : 40 + n] += 15
        assert one(x) == [0] * 40 + [3] * n + [0] * (40 - n)
    x = noise(80)
    x[40:44] += 15
    assert set(one(x)) == {0}
    x = noise(80)
    x[40:] += 15
    assert set(one(x)) == {0}


def test_impossible_and_stuck():
    x = noise(60)
    x[10], x[11], x[30:36] = -0.5, 101.0, 21.0
    f = one(x)
    assert f[10] == f[11] == 1 and f[30:36] == [2] * 6 and sum(f) == 14
    x = noise(60)
    x[30:35] = 21.0
    assert set(one(x)) == {0}
    y = noise(60) / 100
    y[5] = 1.2
    assert one(y, True)[5] == 1


def test_series_do_not_touch_and_ends_are_no_spikes():
    x = np.concatenate([noise(40), noise(40, 2) + 30])
    k = np.repeat([0, 1], 40)
    assert set(flag_series(x, k, np.array([False, False]))[0].tolist()) == {0}
    x = noise(40)
    x[0], x[-1] = 40, 40
    assert set(one(x)) == {0}


def test_short_flat_and_empty():
    assert one([]) == [] and one([5.0]) == [0] and one([1.0, 2.0, 3.0]) == [0, 0, 0]
    assert one([7.0] * 10) == [2] * 10


def test_cutoff_follows_the_tail():
    rng = np.random.default_rng(0)
    r = np.abs(rng.normal(size=20_000))
    k = np.zeros(20_000, int)
    low, high = pareto_cutoff(r, k, 1, 0.9, 1e-2, 10.0)[0], pareto_cutoff(r, k, 1, 0.9, 1e-3, 10.0)[0]
    assert 2.3 < low < 2.9 and 3.0 < high < 3.7


def test_the_tail_decides_what_is_unusual(monkeypatch):
    # Far but no spikes by the exact rule: five scatters off in a quiet run, nothing in one with a heavy tail.
    quiet, heavy = np.random.default_rng(3).uniform(-0.3, 0.3, 400) + 20, 20 + 0.2 * np.random.default_rng(4).standard_t(2.5, 400)
    quiet[200], heavy[200] = 21.2, 21.2
    x, k = np.concatenate([quiet, heavy]), np.repeat([0, 1], 400)
    flag, cutoff, beyond = flag_series(x, k, np.array([False, False]))
    assert beyond[200] and cutoff[0] < cutoff[1] and flag[200] == 0 and not beyond[600]
    monkeypatch.setattr("lithocube.operators.spikes.pareto_cutoff", lambda r, s, n, *a: np.full(n, 8.0))
    assert not flag_series(x, k, np.array([False, False]))[2][200]


def test_a_recurring_part_is_no_news():
    # Every tenth phase lies higher: by itself unusual, as a part of every cycle not.
    n = 2000
    phase = np.arange(n) // 3 % PHASES
    x = noise(n, 5, 0.1) + np.where(phase == 4, 0.25, 0.0)
    k = np.zeros(n, int)
    far = lambda p: flag_series(x, k, np.array([False]), risk=0.02, phase=p)
    assert far(phase)[1][0] < far(None)[1][0]
    s = seasonal(np.where(phase == 4, 1.0, 0.0), np.array([0.2]), k, phase)
    assert s[phase == 4].max() == 0.4 and s[phase != 4].max() == 0
    assert (seasonal(np.ones(7), np.array([1.0]), np.zeros(7, int), np.zeros(7, int)) == 0).all()


def frame(spark, data):
    return spark.createDataFrame([(*r, T, "", 9) for r in data], SCHEMA)


def test_table_order_repeats_nulls(spark):
    x = noise(60)
    x[20] += 20
    data = [(i, 1, 100.0 + i, float(v), None, -999.25) for i, v in enumerate(x)]
    data += [data[20], data[3], (900, 1, None, 500.0, 500.0, 500.0), (901, None, 7.0, 150.0, None, float("nan")), (None, 2, 1.0, -3.0, 20.0, 20.0)]
    f = flag_spikes(frame(spark, data[::-1]))
    assert f.count() == 62
    assert rows(flagged_cells(f)) == sorted([(20, "neutron_por"), (901, "neutron_por"), (None, "neutron_por")], key=repr)
    assert f.where("log_id = 3").first().flag_density_por is None and f.where("log_id = 3").first().tail_density_por is None
    assert f.where("log_id = 20").first().tail_neutron_por


def test_long_runs_in_stretches_give_the_same(spark):
    x = noise(3000)
    x[::97] += 12
    x[700:712] = 22.0
    data = [(i, 5, i / 7.0, float(v), float(v) + 1, None) for i, v in enumerate(x)]
    data += [(10_000 + i, 6, float(i), float(v), 5.0 + i, None) for i, v in enumerate(noise(100))]
    whole, cut = (rows(flagged_cells(flag_spikes(frame(spark, data), stretch=s))) for s in (50_000, 400))
    assert whole == cut and len(whole) > 60


def test_run_at_one_depth_is_cut_too(spark):
    data = [(i, 1, 5.0, 20.0 + (i * 7919 % 100) / 100, None, None) for i in range(1000)]
    f = flag_spikes(frame(spark, data), stretch=200)
    assert f.count() == 1000 and f.select("log_id").distinct().count() == 1000


def test_empty(spark):
    assert flagged_cells(flag_spikes(frame(spark, []))).count() == 0


def both(spark, data, stretch):
    return [rows(flag_spikes(frame(spark, data), stretch=s)) for s in (50_000, stretch)]


def test_long_runs_are_judged_by_the_whole_run(spark):
    # Quiet, noisy and low stretches of one run in percent: scatter and unit of a stretch are not those of the run.
    x = np.concatenate([noise(1000, 1, 0.01), noise(1000, 2, 1.0), 0.5 + 0.01 * noise(400, 3), noise(1000, 4)])
    x[300], x[1500], x[2200], x[2800] = 20.5, 60.0, 1.8, 101.0
    whole, cut = both(spark, [(i, 5, i / 7.0, float(v), float(v) * 2, None) for i, v in enumerate(x)], 300)
    assert whole == cut and {r[5] for r in whole} == {"none", "spike", "impossible"}


def test_cuts_lose_no_neighbours(spark):
    # One far depth; missing, stuck and repeated stretches about every cut, and one longer than a segment.
    x = noise(2000)
    x[::61] += 12
    x[395:399], x[500:530], x[900:1150], x[1396:1404] = 21.0, 22.0, 23.0, 24.0
    data = [(i, 5, i / 7.0, float(v), None if 560 < i < 620 or i % 5 else float(v), float(v) + 1) for i, v in enumerate(x)]
    data[-1] = (1999, 5, 1e12, *data[-1][3:])
    data += [d for d in data[180:220] for _ in range(9)] + [(5000 + i, None, 3.0, float(v), None, None) for i, v in enumerate(noise(900))]
    whole, cut = both(spark, data, 200)
    assert whole == cut and len(whole) == 2900 and {r[5] for r in whole} == {"none", "spike", "stuck"}

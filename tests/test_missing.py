import math
from datetime import datetime

import numpy as np
import pytest

from lithocube.operators.missing import FIELDS, filled_cells, impute_chained

SCHEMA = "log_id long, run_id long, campaign string, depth double, neutron_por double, density_por double, sonic_por double, received_at timestamp, rid string, grp int"
T = datetime(2031, 1, 1)
NAN = float("nan")


def make(spark, data):
    return spark.createDataFrame([(*r, T, "x", 1) for r in data], SCHEMA)


def test_every_notation_is_filled_and_marked(spark):
    gaps = [None, NAN, -999.0, -999.25, -9999.0, 999.25, 9999.0, 1e30, float("inf")]
    data = [(i, 1, "a", 100.0 + i, 20 + 0.1 * i, 18 + 0.1 * i, 19 + 0.1 * i) for i in range(50)]
    data += [(100 + i, 1, "a", 120.5, g, 20.0, 21.0) for i, g in enumerate(gaps)]
    out = impute_chained(make(spark, data))
    assert {r.log_id for r in filled_cells(out).collect()} == {100 + i for i in range(len(gaps))}
    for r in out.where("log_id >= 100").collect():
        assert r.neutron_por_state == "filled" and 20 < r.neutron_por < 25
        assert r.density_por_state == "measured" and r.density_por == 20.0


def test_regression_recovers_a_linear_field(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(20, 3, 400)
    data = [(i, i % 4, "a", float(i), float(v), float(v * 0.5 + 3), None if i % 3 == 0 else float(v * 2 - 10)) for i, v in enumerate(a)]
    out = impute_chained(make(spark, data), noise=0.0).where("sonic_por_state = 'filled'").collect()
    assert len(out) == 134
    assert max(abs(r.sonic_por - (2 * r.neutron_por - 10)) for r in out) < 0.3


def test_residual_variation_is_kept(spark):
    rng = np.random.default_rng(2)
    data = [(i, 1, "a", float(i), float(rng.normal(20, 1)), 18.0 + rng.normal(), None if i % 2 else float(rng.normal(25, 4))) for i in range(2000)]
    out = impute_chained(make(spark, data)).where("sonic_por_state = 'filled'").collect()
    assert 3 < np.std([r.sonic_por for r in out]) < 5
    again = impute_chained(make(spark, data)).where("sonic_por_state = 'filled'").collect()
    assert sorted(r.sonic_por for r in out) == sorted(r.sonic_por for r in again)


def test_fraction_runs_stay_fractions_and_wrong_values_are_measured(spark):
    data = [(i, 1, "a", float(i), 0.2, 0.18, None if i == 5 else 0.21) for i in range(20)]
    data += [(100 + i, 2, "a", float(i), 20.0, -5.0 if i == 3 else 18.0, None if i == 5 else 21.0) for i in range(20)]
    out = {r.log_id: r for r in impute_chained(make(spark, data)).collect()}
    assert 0.1 < out[5].sonic_por < 0.3 and 15 < out[105].sonic_por < 27
    assert out[103].density_por == -5.0 and out[103].density_por_state == "measured"


def test_run_without_a_tool_nulls_repeats_and_no_value_at_all(spark):
    data = [(i, 1, "a", float(i), 20.0, None, 22.0) for i in range(5)] + [(10 + i, 2, "a", float(i), 21.0, None, 23.0) for i in range(5)]
    data += [(20, None, None, None, 20.0, NAN, 22.0), (20, None, None, None, 20.0, NAN, 22.0), (None, 1, "a", 3.0, None, None, None)]
    out = impute_chained(make(spark, data)).collect()
    assert len(out) == 12
    assert all(r.density_por is None and r.density_por_state == "unfillable" for r in out)
    assert all(r.neutron_por is not None for r in out)
    assert filled_cells(impute_chained(make(spark, data))).where("field = 'density_por'").count() == 12


def test_latest_repeat_counts_and_empty(spark):
    data = [(1, 1, "a", 1.0, 5.0, 6.0, 7.0, datetime(2031, 1, 1), "", 0), (1, 1, "a", 1.0, 8.0, 6.0, 7.0, datetime(2031, 1, 2), "", 0)]
    out = impute_chained(spark.createDataFrame(data, SCHEMA)).collect()
    assert [r.neutron_por for r in out] == [8.0]
    empty = impute_chained(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and filled_cells(empty).count() == 0
    assert not any(math.isnan(getattr(r, f)) for r in out for f in FIELDS)


def test_filled_values_beat_the_mean(spark, data):
    """Held-out cells of the given table: the fit must be nearer than a field's overall mean."""
    from pyspark.sql import functions as F

    l = spark.read.parquet(f"{data}/well_logs.parquet")
    ok = F.col("density_por").between(2, 60)
    hide = ok & (F.pmod("log_id", F.lit(7)) == 0)
    out = impute_chained(l.withColumn("density_por", F.when(~hide, F.col("density_por"))), noise=0.0)
    truth = l.where(hide).select("log_id", F.col("density_por").alias("t")).distinct()
    e = out.join(truth, "log_id").agg(F.avg(F.abs(F.col("density_por") - F.col("t"))), F.mean("t")).first()
    spread = truth.agg(F.avg(F.abs(F.col("t") - F.lit(e[1])))).first()[0]
    assert e[0] < 0.6 * spread


def test_wrong_parameters_do_not_pass(spark):
    with pytest.raises(Exception):
        impute_chained(make(spark, []), sweeps="x")

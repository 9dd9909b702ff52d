from conftest import rows

from lithocube.operators.loglines import mined_templates, parse_entries, stated

SCHEMA = "log_file string, line_no int, raw_line string, stamp string, block int"

LINES = [
    "2031-03-03 20:37:28,573 INFO     manager - configuration read\r",
    "  window: 3\r",
    "=== 2031.03.03 20:37:44 | WARNING | propagation",
    "  errors on test wells",
    "  iteration : 4",
    "  RMSE      : 1.025e+01",
    "",
    "[1,3]<stdout>:May 19 13:10:31 [propagation] [it5] propagating - features [('A_b-c', 1, 2, 3),",
    "[1,2]<stderr>:May 19 13:10:32 [worker2] it#6 | trial failed",
    "[1,3]<stdout>:    ('D_e', -1, 0, 3)]",
    "[1,2]<stderr>:Traceback (most recent call last):",
    "<4>1940164916.5 manager[8419]: (iter 7) step done - took 12.5 s",
    '{"ts": "2032-04-27T02:03:24.922Z", "lvl": "info", "component": "manager", "msg": "validation", "it": 8, "rmse": 2.5}',
    "{",
    '  "time": "2032-04-27T02:03:21.142Z",',
    '  "severity": "ERROR",',
    '  "comp": "worker",',
    '  "msg": "best set",',
    '  "iteration": 9,',
    '  "features": [',
    '    "Q_s/1,3,0"',
    "  ]",
    "}",
    "17/12/2031 07:03:38;I;manager;Iteração nº 10; ring written; tempo 2521,34 s",
    'ts=2031-12-17T07:05:12Z level=debug comp=feature_sel iter=11 rmse=3.5 mae=2.2 msg="candidate scored"',
    "2031-03-03 20:38:15,100 WARNING  propagation - (iter 12) RMSE unavailable: no rows on the test wells",
    "2031-03-03 20:38:16,100 WARNING  propagation - iteration 13: features requested twice, kept once",
    "2031-03-03 20:38:17,100 INFO     feature_sel - baseline of the constant model - rmse=11.2",
]


def frame(spark, lines, file="f"):
    return spark.createDataFrame([(file, i + 1, t, "", 0) for i, t in enumerate(lines)], SCHEMA)


def test_layouts(spark):
    e = {r.first_line: r for r in parse_entries(frame(spark, LINES)).collect()}
    assert [(k, e[k].last_line) for k in sorted(e)] == [(1, 2), (3, 6), (8, 10), (9, 11), (12, 12), (13, 13), (14, 23), (24, 24), (25, 25), (26, 26), (27, 27), (28, 28)]
    assert [e[k].iteration for k in sorted(e)] == [None, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None]
    assert [e[k].level for k in sorted(e)] == ["INFO", "WARNING", None, None, "WARNING", "INFO", "ERROR", "INFO", "DEBUG", "WARNING", "WARNING", "INFO"]
    assert [e[k].component for k in sorted(e)] == ["manager", "propagation", "propagation", "worker2", "manager", "manager", "worker", "manager", "feature_sel", "propagation", "propagation", "feature_sel"]
    assert e[3].rmse == 10.25 and e[13].rmse == 2.5 and e[25].rmse == 3.5 and e[26].rmse is None and e[28].rmse == 11.2
    assert e[12].seconds == 12.5 and e[24].seconds == 2521.34
    assert len(e[8].features) == 2 and e[14].features == ["Q_s/1,3,0"] and e[27].features is None
    assert str(e[1].ts).startswith("2031-03-03 20:37:28.573") and str(e[3].ts) == "2031-03-03 20:37:44" and e[8].ts is None and e[8].stamp == "May 19 13:10:31"
    assert str(e[24].ts) == "2031-12-17 07:03:38" and e[12].ts is not None and e[13].ts is not None
    assert e[1].message == "configuration read\n  window: 3" and e[25].message == "candidate scored" and e[9].message.endswith("Traceback (most recent call last):")
    assert rows(stated(parse_entries(frame(spark, LINES))), "first_line", "last_line", "iteration") == sorted([(3, 6, 4), (8, 10, 5), (12, 12, 7), (13, 13, 8), (14, 23, 9), (24, 24, 10), (25, 25, 11)], key=repr)


def test_blocks_repeats_and_order_do_not_matter(spark):
    whole = rows(parse_entries(frame(spark, LINES)).drop("features"))
    twice = frame(spark, LINES).unionAll(frame(spark, LINES)).orderBy("raw_line")
    assert rows(parse_entries(twice, block=3).drop("features")) == whole


def test_year_from_shipping(spark):
    from datetime import datetime

    data = [("f", 1, "[1,0]<stdout>:Dec 31 23:59:00 [manager] it#1 | best set", datetime(2032, 1, 1, 0, 5)), ("f", 2, "[1,0]<stdout>:Jan  6 07:30:31 [manager] it#1 | best set", datetime(2032, 1, 6, 8)),
            ("f", 3, "[1,0]<stdout>:Feb 29 07:30:31 [manager] it#1 | best set", None)]
    e = parse_entries(spark.createDataFrame(data, "log_file string, line_no int, raw_line string, shipped_at timestamp"))
    assert [str(r.ts) for r in e.orderBy("first_line").collect()] == ["2031-12-31 23:59:00", "2032-01-06 07:30:31", "None"]


def test_odd_lines(spark):
    lines = ["no head at all", None, "   ", "\x00\x07", "2031-01-01 00:00:00,000 INFO a - " + "x" * 200_000, "{ not json", "2031-01-01 00:00:01,000 INFO b - it 5.5 took 3 s"]
    f = frame(spark, lines).unionAll(spark.createDataFrame([("f", None, "x", "", 0), (None, 1, "2031-01-01 00:00:00,000 INFO a - it 1 took 2 s", "", 0)], SCHEMA))
    e = parse_entries(f)
    assert rows(e, "log_file", "first_line", "last_line") == sorted([("f", 1, 1), ("f", 5, 5), ("f", 6, 6), ("f", 7, 7), (None, 1, 1)], key=repr)
    assert e.where("first_line = 5").first().message == "x" * 200_000
    assert e.where("first_line = 7").first().iteration is None


def test_empty(spark):
    assert parse_entries(frame(spark, [])).count() == 0
    assert parse_entries(frame(spark, ["", None])).count() == 0


def test_given_table_has_no_entry_without_stamp(spark, data):
    e = parse_entries(spark.read.parquet(f"{data}/run_log_lines.parquet"))
    assert e.where("stamp is null or component is null or message is null").count() == 0


def test_mining_decides(spark):
    e = {r.first_line: r for r in parse_entries(frame(spark, LINES), least=1_000).collect()}
    # Without constants only labels with an equals sign or a colon name values, and levels written out are known.
    assert [e[k].iteration for k in (3, 8, 9, 12, 14, 24, 25)] == [4, None, None, None, 9, None, 11]
    assert e[12].seconds is None and e[24].level is None and e[25].rmse == 3.5 and e[8].features is None
    often = {r.way: r.lines for r in mined_templates(frame(spark, LINES), least=1_000).groupBy("way").agg({"lines": "sum"}).withColumnRenamed("sum(lines)", "lines").collect()}
    assert often["fallback"] > 20
    assert mined_templates(frame(spark, LINES)).where("way = 'fallback'").count() == 0
    assert mined_templates(frame(spark, [])).count() == 0


def test_numbers_that_are_no_iteration(spark):
    lines = ["2031-01-01 00:00:00,000 INFO a - loaded before the first iteration - 28.2 sec elapsed", "\x1b[32m2031-01-01 00:00:01,000\x1b[0m \x1b[31mERROR\x1b[0m  worker3 - iteration 4: took 2 s"]
    e = parse_entries(frame(spark, lines)).orderBy("first_line").collect()
    assert [(r.iteration, r.seconds, r.level, r.component) for r in e] == [(None, 28.2, "INFO", "a"), (4, 2.0, "ERROR", "worker3")]
    assert e[1].message == "iteration 4: took 2 s"

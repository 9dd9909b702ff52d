"""Queries of the general problems: missing cells, regular grid, spikes, neighbours, log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.operators.loglines import mined_templates, parse_entries, stated
from lithocube.operators.missing import CODES, FIELDS, filled_cells, impute_chained
from lithocube.operators.near import inside_pairs, near_pairs, near_spots
from lithocube.operators.regrid import regular_grid
from lithocube.operators.spikes import flag_spikes, flagged_cells
from lithocube.plans.registry import query
from lithocube.session import read

_CODES = ", ".join(f"{c!r}" for c in CODES)


def _missing(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}) OR isinf({c}) OR {c} IN ({_CODES}))"


@query(
    "p1_found",
    " UNION ".join(f"SELECT DISTINCT log_id, '{f}' AS field FROM well_logs WHERE {_missing(f)}" for f in FIELDS),
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cells(impute_chained(read(spark, d, "well_logs")))


@query("p1_filled")
def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    return impute_chained(read(spark, d, "well_logs"))


@query(
    "p2_found",
    f"""WITH present AS (
        SELECT DISTINCT run_id, CAST(floor(depth / n_meters) AS BIGINT) AS bucket FROM well_logs JOIN aggregation_params USING (campaign)
        WHERE depth IS NOT NULL AND NOT isnan(depth) AND run_id IS NOT NULL AND NOT {_missing('density_por')}),
      spans AS (SELECT run_id, min(bucket) AS lo, max(bucket) AS hi FROM present GROUP BY run_id),
      steps AS (SELECT run_id, unnest(range(lo, hi)) AS bucket FROM spans)
    SELECT run_id, bucket FROM steps ANTI JOIN present USING (run_id, bucket)""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_grid(spark, d).where("filled").select("run_id", "bucket")


@query("p2_grid")
def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(read(spark, d, "well_logs"), read(spark, d, "aggregation_params"))


_CELLS = " UNION ALL ".join(f"SELECT run_id, log_id, depth, '{f}' AS field, {f} AS v FROM once WHERE NOT {_missing(f)}" for f in FIELDS)


def _episode(n: int) -> str:
    """Starts of episodes of `n` values that leave the levels on both sides, those next to it being back at one of them."""
    apart = [f"abs(v{k} - before) > far AND abs(v{k} - after{n}) > far" for k in range(n)]
    back = [f"(abs({v} - before) <= far OR abs({v} - after{n}) <= far)" for v in ("last", f"v{n}")]
    return f"SELECT run_id, field, j, {n} AS n FROM places WHERE far > 0 AND {' AND '.join(apart + back)}"


@query(
    "p3_found",
    f"""WITH once AS (SELECT * FROM well_logs WHERE depth IS NOT NULL AND NOT isnan(depth) QUALIFY row_number() OVER (PARTITION BY run_id, log_id ORDER BY depth, received_at DESC) = 1),
      cells AS ({_CELLS}),
      units AS (SELECT run_id, count_if(v BETWEEN 0 AND 1) * 2 > count_if(v BETWEEN 0 AND 100) AS fraction FROM cells GROUP BY run_id),
      ordered AS (SELECT *, row_number() OVER w AS i, v IS DISTINCT FROM lag(v) OVER w AS new FROM cells WINDOW w AS (PARTITION BY run_id, field ORDER BY depth, log_id)),
      stretches AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY run_id, field ORDER BY i) AS stretch FROM ordered),
      judged AS (SELECT s.run_id, log_id, field, v, i, v < 0 OR v > CASE WHEN fraction THEN 1 ELSE 100 END OR count(*) OVER (PARTITION BY s.run_id, field, stretch) >= 6 AS odd
        FROM stretches s JOIN units u ON s.run_id IS NOT DISTINCT FROM u.run_id),
      rest AS (SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY i) AS j FROM judged WHERE NOT odd),
      levels AS (SELECT *, median(v) OVER (PARTITION BY run_id, field ORDER BY j ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS level,
        median(v) OVER (PARTITION BY run_id, field ORDER BY j ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS before,
        median(v) OVER (PARTITION BY run_id, field ORDER BY j ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS after FROM rest),
      scatters AS (SELECT run_id, field, 10 * CASE WHEN median(abs(v - level)) = 0 THEN avg(least(abs(v - level), 1e6)) ELSE 1.4826 * median(abs(v - level)) END AS far FROM levels GROUP BY ALL),
      places AS (SELECT l.run_id, l.field, log_id, j, v AS v0, before, far, lag(v) OVER w AS last, lead(v) OVER w AS v1, lead(v, 2) OVER w AS v2, lead(v, 3) OVER w AS v3,
          lead(after) OVER w AS after1, lead(after, 2) OVER w AS after2, lead(after, 3) OVER w AS after3
        FROM levels l JOIN scatters s ON l.run_id IS NOT DISTINCT FROM s.run_id AND l.field = s.field WINDOW w AS (PARTITION BY l.run_id, l.field ORDER BY j)),
      episodes AS ({' UNION ALL '.join(map(_episode, (1, 2, 3)))}),
      members AS (SELECT run_id, field, unnest(range(j, j + n)) AS j FROM episodes)
    SELECT log_id, field FROM judged WHERE odd UNION SELECT log_id, r.field FROM rest r JOIN members m ON r.run_id IS NOT DISTINCT FROM m.run_id AND r.field = m.field AND r.j = m.j""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flagged_cells(flag_spikes(read(spark, d, "well_logs")))


@query(
    "p3_measured",
    "SELECT field, CAST(count(DISTINCT log_id) AS BIGINT) AS values, true AS few_unusual FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, log_id FROM well_logs WHERE depth IS NOT NULL AND NOT isnan(depth) AND NOT {_missing(f)}" for f in FIELDS)
    + ") GROUP BY field",
)
def p3_measured(spark: SparkSession, d: str) -> DataFrame:
    """Per field: values judged, and whether those beyond their tail's cutoff are few, as its risk says (spikes aside)."""
    f = p3_flags(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("flag_" + c).alias("flag"), F.col("tail_" + c).alias("tail")) for c in FIELDS]))
    f = f.select(each.alias("c")).where("c.flag is not null")
    plain = F.count_if(F.col("c.tail") & (F.col("c.flag") == "none")) / F.count_if(F.col("c.flag") == "none")
    return f.groupBy("c.field").agg(F.count(F.lit(1)).alias("values"), (plain < 0.05).alias("few_unusual"))


@query("p3_flags")
def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_spikes(read(spark, d, "well_logs"))


@query(
    "p4_found",
    """WITH w AS (SELECT DISTINCT well_id, CAST(x_coord AS DOUBLE) AS x, CAST(y_coord AS DOUBLE) AS y FROM wells_info_completed
                 WHERE x_coord >= 0 AND y_coord >= 0 AND well_id IS NOT NULL)
    SELECT DISTINCT 'near' AS kind, a.well_id AS a_id, b.well_id AS b_id FROM w a JOIN w b
      ON a.well_id < b.well_id AND b.x BETWEEN a.x - 25 AND a.x + 25
      WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625
    UNION ALL
    SELECT DISTINCT 'inside', area_id, well_id FROM areas_coords JOIN w
      ON x BETWEEN least(min_x, max_x) AND greatest(min_x, max_x) AND y BETWEEN least(min_y, max_y) AND greatest(min_y, max_y)
      WHERE min_x IS NOT NULL AND max_x IS NOT NULL AND min_y IS NOT NULL AND max_y IS NOT NULL""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    wells, areas = read(spark, d, "wells_info_completed"), read(spark, d, "areas_coords")
    near = near_pairs(wells, 25.0).select(F.lit("near").alias("kind"), "a_id", "b_id")
    return near.unionAll(inside_pairs(wells, areas).select(F.lit("inside"), "a_id", "b_id"))


@query(
    "p1_states",
    "WITH once AS (SELECT log_id, " + ", ".join(f"any_value({_missing(f)}) AS {f}_gap" for f in FIELDS) + " FROM well_logs WHERE log_id IS NOT NULL GROUP BY log_id) SELECT log_id, "
    + ", ".join(f"CASE WHEN {f}_gap THEN 'filled' ELSE 'measured' END AS {f}_state" for f in FIELDS) + ", true AS in_range FROM once",
)
def p1_states(spark: SparkSession, d: str) -> DataFrame:
    """The mark of every cell, and whether the filled ones hold a porosity."""
    p = p1_filled(spark, d)
    good = [(F.col(f"{f}_state") != "filled") | F.coalesce(F.col(f).between(0, 100), F.lit(False)) for f in FIELDS]
    return p.select("log_id", *[f"{f}_state" for f in FIELDS], (good[0] & good[1] & good[2]).alias("in_range"))


@query(
    "p2_steps",
    f"""WITH once AS (SELECT run_id, log_id, CAST(floor(depth / n_meters) AS BIGINT) AS bucket, min(density_por) AS v FROM well_logs JOIN aggregation_params USING (campaign)
        WHERE depth IS NOT NULL AND NOT isnan(depth) AND run_id IS NOT NULL AND NOT {_missing('density_por')} GROUP BY ALL),
      cells AS (SELECT run_id, bucket, avg(greatest(0, least(100, v))) AS v, count(*) AS n FROM once GROUP BY ALL),
      spans AS (SELECT run_id, min(bucket) AS lo, max(bucket) AS hi, min(v) AS least_v, max(v) AS most_v FROM cells GROUP BY run_id),
      steps AS (SELECT run_id, unnest(range(lo, hi + 1)) AS bucket FROM spans)
    SELECT run_id, bucket, coalesce(n, 0) AS n_readings, n IS NULL AS filled, round(v + 1e-7, 5) AS measured, true AS within_run FROM steps LEFT JOIN cells USING (run_id, bucket)""",
)
def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every step of every run with its measured mean, and whether filled ones stay within what the run has measured."""
    g = p2_grid(spark, d)
    v = F.col("density_por")
    span = g.where("not filled").groupBy("run_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    g = g.join(span, "run_id")
    within = v.between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)
    return g.select("run_id", "bucket", "n_readings", "filled", F.when(~F.col("filled"), F.round(v + 1e-7, 5)).alias("measured"), within.alias("within_run"))


_SPOTS = "s AS (SELECT DISTINCT CAST(x_coord AS DOUBLE) AS x, CAST(y_coord AS DOUBLE) AS y FROM wells_info_completed WHERE x_coord >= 0 AND y_coord >= 0 AND well_id IS NOT NULL)"


@query(
    "p4_spots",
    f"""WITH {_SPOTS} SELECT a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y FROM s a JOIN s b ON b.x BETWEEN a.x AND a.x + 25
    WHERE (a.x < b.x OR a.y < b.y) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 625""",
)
def p4_spots(spark: SparkSession, d: str) -> DataFrame:
    return near_spots(read(spark, d, "wells_info_completed"), 25.0)[0]


#: Entries and their statements line by line, by regular expressions of their own.
_ENTRIES = r"""l AS (SELECT log_file, line_no, max(raw_line) AS raw FROM run_log_lines WHERE line_no IS NOT NULL GROUP BY ALL),
  t AS (SELECT log_file, line_no, rtrim(regexp_replace(translate(raw, chr(9) || chr(160), '  '), '\x1b\[[0-9;]*[A-Za-z]|[\x00-\x08\x0b-\x1f\x7f\x{200b}\x{feff}]', '', 'g')) AS txt FROM l),
  s AS (SELECT log_file, line_no, regexp_extract(txt, '^\[\d+,\d+\]<\w+>:') AS stream, regexp_replace(txt, '^\[\d+,\d+\]<\w+>:', '') AS body FROM t),
  h AS (SELECT *, regexp_matches(body, '^(?:(?:=== *|ts=)?(?:\d{4}-\d\d-\d\d[ T]\d\d:|\d{4}\.\d\d\.\d\d |\d\d/\d\d/\d{4} |[A-Z][a-z]{2} +\d{1,2} \d\d:)|<\d>\d{9}|\{)') AS head
    FROM s WHERE trim(body) <> ''),
  e AS (SELECT *, coalesce(max(CASE WHEN head THEN line_no END) OVER (PARTITION BY log_file, stream ORDER BY line_no), line_no) AS first_line FROM h),
  f AS (SELECT log_file, stream, first_line, line_no,
      try_cast(nullif(regexp_extract(body, '(?i)(?:^|[^\w])(?:iteration|itera..o|iter|it)(?:[\s:=#"().]|nº)*(\d+)(?:[.,]?$|[.,]?[^\w.,])', 1), '') AS INTEGER) AS it,
      regexp_matches(body, '(?i)\brmse"?\s*[:=]?\s*[+-]?\d') AS r,
      regexp_matches(body, '(?i)\b(?:took|tempo|total time\(s\)|seconds"?)\s*[:=]?\s*\d|\d\s*sec\s+elapsed') AS sec,
      regexp_matches(body, '(?i)\b(?:features|chosen|atributos)\b') AS listed,
      regexp_matches(body, '\w_[\w-]+(?:/-?\d+,-?\d+,-?\d|:-?\d+:-?\d+:-?\d|\[-?\d+ -?\d+ -?\d| \(-?\d+ -?\d+ -?\d)|\(''[\w-]+'', -?\d+, -?\d+, -?\d') AS feat FROM e)"""


@query(
    "p6_found",
    f"""WITH {_ENTRIES} SELECT log_file, CAST(first_line AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, arg_min(it, line_no) AS iteration
    FROM f GROUP BY log_file, stream, first_line
    HAVING arg_min(it, line_no) IS NOT NULL AND (bool_or(r) OR bool_or(sec) OR coalesce(max(CASE WHEN feat THEN line_no END) >= min(CASE WHEN listed THEN line_no END), false))""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return stated(p6_entries(spark, d)).select("log_file", "first_line", "last_line", "iteration")


@query("p6_entries")
def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    return parse_entries(read(spark, d, "run_log_lines"))


@query(
    "p6_values",
    f"""WITH {_ENTRIES}, v AS (SELECT log_file, stream, first_line, line_no,
        try_cast(replace(regexp_extract(body, '(?i)\\brmse"?\\s*[:=]?\\s*([+-]?\\d+(?:[.,]\\d+)?(?:[eE][+-]?\\d+)?)', 1), ',', '.') AS DOUBLE) AS r,
        try_cast(replace(coalesce(nullif(regexp_extract(body, '(?i)\\b(?:took|tempo|total time\\(s\\)|seconds"?)\\s*[:=]?\\s*(\\d+(?:[.,]\\d+)?(?:[eE][+-]?\\d+)?)', 1), ''),
          regexp_extract(body, '(\\d+(?:[.,]\\d+)?(?:[eE][+-]?\\d+)?)\\s*sec\\s+elapsed', 1)), ',', '.') AS DOUBLE) AS s FROM e)
    SELECT log_file, CAST(first_line AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, arg_min(r, line_no) AS rmse, arg_min(s, line_no) AS seconds FROM v GROUP BY log_file, stream, first_line""",
)
def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with the RMSE and the seconds that it states."""
    return p6_entries(spark, d).select("log_file", "first_line", "last_line", "rmse", "seconds")


@query(
    "p6_heads",
    f"""WITH {_ENTRIES}, v AS (SELECT log_file, stream, first_line, line_no,
        coalesce(nullif(regexp_extract(body, '\\b(?:level|lvl|severity)"?\\s*[:=]\\s*"?(\\w+)', 1), ''), nullif(regexp_extract(body, '^=== [^|]+\\| (\\w+) \\|', 1), ''),
          nullif(regexp_extract(body, '^\\d\\d/\\d\\d/\\d{{4}} [^;]+;(\\w);', 1), ''), nullif(regexp_extract(body, '^\\d{{4}}-\\d\\d-\\d\\d [^ ]+ +(\\w+) ', 1), ''), nullif(regexp_extract(body, '^<(\\d)>\\d', 1), '')) AS l,
        coalesce(nullif(regexp_extract(body, '\\b(?:comp|component|logger)"?\\s*[:=]\\s*"?(\\w+)', 1), ''), nullif(regexp_extract(body, '^=== [^|]+\\| \\w+ \\| ([\\w-]+)', 1), ''),
          nullif(regexp_extract(body, '^\\d\\d/\\d\\d/\\d{{4}} [^;]+;\\w;([\\w-]+);', 1), ''), nullif(regexp_extract(body, '^\\d{{4}}-\\d\\d-\\d\\d [^ ]+ +\\w+ +([\\w-]+) - ', 1), ''),
          nullif(regexp_extract(body, '^<\\d>[\\d.]+ ([\\w-]+)', 1), ''), nullif(regexp_extract(body, '^[A-Z][a-z]{{2}} +\\d+ [\\d:]+ \\[([\\w-]+)\\]', 1), '')) AS c FROM e)
    SELECT log_file, CAST(first_line AS INTEGER) AS first_line, CASE lower(arg_min(l, line_no)) WHEN 'debug' THEN 'DEBUG' WHEN 'd' THEN 'DEBUG' WHEN '7' THEN 'DEBUG' WHEN 'info' THEN 'INFO' WHEN 'i' THEN 'INFO'
        WHEN '6' THEN 'INFO' WHEN '5' THEN 'INFO' WHEN 'warning' THEN 'WARNING' WHEN 'warn' THEN 'WARNING' WHEN 'w' THEN 'WARNING' WHEN '4' THEN 'WARNING' WHEN 'error' THEN 'ERROR' WHEN 'e' THEN 'ERROR' WHEN '3' THEN 'ERROR'
        WHEN 'critical' THEN 'CRITICAL' WHEN 'fatal' THEN 'CRITICAL' WHEN 'c' THEN 'CRITICAL' WHEN '2' THEN 'CRITICAL' END AS level, arg_min(c, line_no) AS component FROM v GROUP BY log_file, stream, first_line""",
)
def p6_heads(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with its level and component."""
    return p6_entries(spark, d).select("log_file", "first_line", "level", "component")


@query("p6_templates")
def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    return mined_templates(read(spark, d, "run_log_lines"))

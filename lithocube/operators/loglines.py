"""Problem 6: log lines of several programs into entries with fields, by mining frequent position-word pairs.

Lines are masked inside the scan (numbers, feature lists and timestamps become placeholders), so that lines of one
layout share one shape, however many lines there are. Pairs of position and word are counted over the shapes, weighted
by their lines; a word that is frequent at its position, from the start or from the end of the line, is a constant of
a layout, every other word a variable. The shape with its constants is a template. A template says which placeholder
is an iteration, an error or a time (the one that its label constant names), where a list begins, and which slots are
level, component and message. Words that are no constants can name a value only by the fallback rule: a known label
with an equals sign or a colon. Values are then taken from the lines by the places that the templates give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithocube.session import cut, small

#: Share of all lines on which a word must stand at one position to be a constant, and the least number of lines.
SHARE, LEAST = 1e-5, 1
#: Lines of a file that are carried as one block when continuation lines look for their head.
BLOCK = 2048

#: Placeholders of a masked line: number, list of features, timestamp.
NUM, LIST, STAMP = "\x01", "\x02", "\x03"
# The ways in which a timestamp, a number and a displaced feature are written (Java regular expressions).
_STAMPS = [
    r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:[.,]\d+)?Z?",
    r"\d{4}\.\d\d\.\d\d \d\d:\d\d:\d\d",
    r"\d\d/\d\d/\d{4} \d\d:\d\d:\d\d",
    r"[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d",
    r"(?<=>)\d{9,}(?:\.\d+)?",
]
_HEAD = r"^((?:===\s*|ts=|<\d>)?(" + "|".join(_STAMPS) + r")|(?=\{))"
_NUMBER = r"(?<![\w])[+-]?\d++(?:[.,]\d++)?(?:[eE][+-]?\d++)?(?!\w)|(?<=\b[iI]t)\d++(?!\w)"
_FEATURE = r"(?:\b\p{L}+_[\w-]+?(?:/-?\d+,-?\d+,-?\d+|:-?\d+:-?\d+:-?\d+|\[-?\d+ -?\d+ -?\d+\]| \(-?\d+ -?\d+ -?\d+\))|\('[\w-]+', -?\d+, -?\d+, -?\d+\))"
_LISTED = _FEATURE + r"(?:[\"']?\s*[,|+;]?\s*[\"']?" + _FEATURE + ")*"
_UNSEEN = r"\x1b\[[0-9;]*[A-Za-z]|[\x00-\x08\x0b-\x1f\x7f\u200b\ufeff]"
_STREAM = r"^\[(\d+,\d+)\]<(\w+)>:"
LEVELS = {  # fixed values: words and letters that programs write for a level
    "debug": "DEBUG", "info": "INFO", "warning": "WARNING", "warn": "WARNING", "error": "ERROR", "critical": "CRITICAL", "fatal": "CRITICAL",
    "d": "DEBUG", "i": "INFO", "w": "WARNING", "e": "ERROR", "c": "CRITICAL",
}
SYSLOG = {"2": "CRITICAL", "3": "ERROR", "4": "WARNING", "5": "INFO", "6": "INFO", "7": "DEBUG"}
#: Labels beside which an iteration, an RMSE, a list or a number of seconds is written, and keys of an entry's head.
LABELS = {
    "iteration": ("iteration", "iter", "it", "iteração", "iteracao"), "rmse": ("rmse",),
    "features": ("features", "chosen", "atributos"), "seconds": ("seconds", "took", "time", "tempo", "elapsed"),
}
KEYS = {"level": ("level", "lvl", "severity"), "component": ("comp", "component", "logger"), "message": ("msg", "message"), "stamp": ("ts", "time", "timestamp")}
_LABEL_OF = {w: k for k, ws in LABELS.items() for w in ws}
_KEY_OF = {w: k for k, ws in KEYS.items() for w in ws}
#: What may stand between a label and its value.
_BETWEEN = frozenset((":", "=", "#", '"', "'", ".", "nº", "n", "º", "(", ")", "s"))
_TOKEN = re.compile(rf"[{NUM}{LIST}{STAMP}]|[^\W\d_][\w-]*|\d\w*|[^\s\w]|_\w*")
_WORD = re.compile(r"[^\W\d_]")


def masked(lines: DataFrame) -> DataFrame:
    """`lines` (raw_line and others) with stream, body, head, lead, masked, shape, severity, filled.

    `head`: the line opens an entry; `lead`: its beginning up to the timestamp; `masked`: what follows, with lists and
    timestamps as placeholders, null where it holds none; `filled`: it is not blank. All in the scan's stage, each
    expression once: nothing is filtered here, as a filter would be worked out apart.
    """
    raw = F.coalesce("raw_line", F.lit(""))
    raw = F.when(raw.contains("\t") | raw.contains("\xa0"), F.translate(raw, "\t\xa0", "  ")).otherwise(raw)
    d = lines.withColumn("_t", F.rtrim(F.regexp_replace(raw, _UNSEEN, "")))
    d = d.withColumn("_p", F.when(F.col("_t").startswith("["), F.regexp_extract("_t", _STREAM, 0)).otherwise(F.lit("")))
    d = d.withColumns({"stream": F.when(F.col("_p") == "", "").otherwise(F.regexp_replace("_p", _STREAM, "$1,$2")), "body": F.expr("substring(_t, length(_p) + 1)")})
    first = F.substring("body", 1, 1)
    d = d.withColumn("lead", F.when(first.between("0", "9") | first.isin("=", "t", "<") | first.between("A", "Z"), F.regexp_extract("body", _HEAD, 1)).otherwise(F.lit("")))
    d = d.withColumn("_r", F.expr("substring(body, length(lead) + 1)"))
    stamped = F.when(F.col("_r").contains('"') & F.col("_r").contains("T"), F.regexp_replace("_r", _STAMPS[0], STAMP)).otherwise(F.col("_r"))
    d = d.withColumn("_s", stamped)
    d = d.withColumn("_m", F.when(F.col("_s").contains("_") | F.col("_s").contains("('"), F.regexp_replace("_s", _LISTED, LIST)).otherwise(F.col("_s")))
    kind = F.when(F.col("lead") == "", F.lit("")).otherwise(F.regexp_replace(F.regexp_replace("lead", "[A-Z][a-z]{2} +", "M "), r"\d++", "0"))
    return d.select(
        *[c for c in lines.columns if c != "raw_line"], "stream", "body", "lead", ((F.col("lead") != "") | F.col("body").startswith("{")).alias("head"),
        F.when(F.col("_m") != F.col("_r"), F.col("_m")).alias("masked"), F.concat(kind, F.lit("\n"), F.regexp_replace("_m", _NUMBER, NUM)).alias("shape"),
        F.when(F.col("lead").startswith("<"), F.substring("lead", 2, 1)).alias("severity"), (F.trim("body") != "").alias("filled"),
    )


def tokens(shape: str) -> list[tuple[str, int]]:
    """Tokens of a shape after its timestamp, with the place behind each; words, placeholders, single other characters."""
    return [(m.group(), m.end()) for m in _TOKEN.finditer(shape, shape.find("\n") + 1)]


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word of every shape with its place, counted from the start (0, 1, ...) and from the end (-1, -2, ...)."""
    for pdf in batches:
        out: list[tuple] = []
        for shape, n in zip(pdf["shape"], pdf["n"]):
            found = tokens(shape)
            for i, (t, _) in enumerate(found):
                if _WORD.match(t):
                    out += [(shape, n, i, i, t), (shape, n, i, i - len(found), t)]
        yield pd.DataFrame(out, columns=["shape", "n", "i", "position", "word"])


def plan_of(shape: str, constant: frozenset[int]) -> dict:
    """What a template says of its lines: places of values among the numbers, lists, level, component, message.

    `constant`: the tokens that are constants of the layout. Labels among them name a value beside them in any way
    known; a word that is no constant names one only with an equals sign or a colon (the fallback rule).
    """
    found = tokens(shape)
    words = [t.lower() for t, _ in found]
    number_at = {i: k for k, i in enumerate(i for i, w in enumerate(words) if w == NUM)}
    out: dict = {"iteration": None, "rmse": None, "seconds": None, "listed": False, "level": None, "component": None, "keyed": False, "stamped": False, "cut": 0, "cut_numbers": 0}
    fell_back = False
    head_end = None
    for i, w in enumerate(words):
        kind, key = _LABEL_OF.get(w), _KEY_OF.get(w)
        if kind is None and key is None:
            continue
        j = i + 1
        while j < len(words) and words[j] in _BETWEEN:
            j += 1
        sure = i in constant
        if not sure and not {"=", ":"} & set(words[i + 1 : j]):
            continue
        if kind in ("iteration", "rmse", "seconds"):
            at = j if j in number_at else None
            if w == "time" and words[max(i - 1, 0)] != "total":
                at = None
            if w == "elapsed" and i >= 2 and i - 2 in number_at:
                at = i - 2
            if at is not None and out[kind] is None:
                out[kind] = number_at[at]
                fell_back |= not sure
        elif kind == "features":
            out["listed"] = True
        if key and j < len(words) and {"=", ":"} & set(words[i + 1 : j]):
            if key == "level" and words[j] in LEVELS:
                out["level"] = LEVELS[words[j]]
            elif key == "component" and out["component"] is None and _WORD.match(words[j]):
                out["component"] = found[j][0]
            elif key == "message" and '"' in words[i + 1 : j]:
                out["keyed"] = True
            elif key == "stamp" and words[j] == STAMP:
                out["stamped"] = True
    if not shape.startswith("\n"):
        for i, w in enumerate(words):
            if not _WORD.match(w) or w in _KEY_OF:
                continue
            if out["level"] is None and w in LEVELS and (i in constant or len(w) > 1 and found[i][0].isupper()):
                out["level"], head_end = LEVELS[w], i
            elif out["level"] and w in LEVELS and LEVELS[w] == out["level"] and head_end is None and out["component"]:
                head_end = i
            else:
                if out["component"] is None:
                    out["component"] = found[i][0]
                head_end = i
                break
        start = shape.find("\n") + 1
        end = found[head_end][1] if head_end is not None else start
        end = re.compile(rf"(?:\[{NUM}\])?[\s\]|;:,-]*").match(shape, end).end()
        lead = shape[start:end]
        if LIST not in lead and STAMP not in lead:
            out["cut"], out["cut_numbers"] = len(lead), lead.count(NUM)
    some = any(_WORD.match(w) for w in words)
    out["template"] = " ".join(t if i in constant or not _WORD.match(t) else "<*>" for i, (t, _) in enumerate(found))
    out["way"] = "fallback" if fell_back or (some and not constant) else "template"
    return out


_PLAN = "shape string, n long, iteration int, rmse int, seconds int, listed boolean, level string, component string, keyed boolean, stamped boolean, cut int, cut_numbers int, template string, way string"


def _plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _PLAN.split(", ")]
    for pdf in batches:
        rows = [{"shape": s, "n": n} | plan_of(s, frozenset(c if c is not None else ())) for s, n, c in zip(pdf["shape"], pdf["n"], pdf["constant"])]
        out = pd.DataFrame(rows, columns=names)
        for c in ("iteration", "rmse", "seconds"):
            out[c] = out[c].astype("Int32")
        yield out


def mined_plans(shapes: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The plan (see plan_of) of every one of `shapes` (shape, n lines), by frequent pairs of position and word.

    A pair is frequent if it stands on at least `share` of all lines and on `least` lines. Everything is counted and
    joined on the executors; the number of pairs is that of shapes and words, not of lines.
    """
    total = shapes.agg(F.sum("n")).first()[0] or 0
    pairs = cut(shapes.mapInPandas(_positions, "shape string, n long, i int, position int, word string"))
    often = pairs.groupBy("position", "word").agg(F.sum("n").alias("lines")).where(F.col("lines") >= max(float(least), share * total))
    constant = pairs.join(small(cut(often.select("position", "word"))), ["position", "word"]).groupBy("shape").agg(F.collect_set("i").alias("constant"))
    return cut(shapes.join(constant, "shape", "left").select("shape", "n", "constant").mapInPandas(_plans, _PLAN))


def _lines(log_lines: DataFrame, block: int) -> DataFrame:
    """Masked lines, each once, with `opened`: the head before it in its block and stream. One shuffle, by file and block."""
    shipped = F.col("shipped_at").cast("timestamp") if "shipped_at" in log_lines.columns else F.lit(None).cast("timestamp")
    d = log_lines.where("line_no is not null").select(
        F.coalesce(F.col("log_file"), F.lit("\0")).alias("file"), F.col("line_no").cast("int").alias("line_no"), "raw_line", shipped.alias("shipped")
    ).withColumn("block", F.floor(F.col("line_no") / block))
    d = d.repartition("file", "block")
    latest = Window.partitionBy("file", "block", "line_no").orderBy(F.desc_nulls_last("raw_line"), F.asc_nulls_last("shipped"))
    d = masked(d.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn"))
    up_to = Window.partitionBy("file", "block", "stream").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("opened", F.last(F.when(F.col("head"), F.col("line_no")), ignorenulls=True).over(up_to))
    return cut(d.where("filled").drop("filled"))


def _shapes(lines: DataFrame) -> DataFrame:
    return cut(lines.groupBy("shape").agg(F.count(F.lit(1)).alias("n")))


def _with_first(lines: DataFrame) -> DataFrame:
    """Lines with the first line of their entry; only those at a block's start look for a head in the blocks before."""
    ends = lines.where("head").groupBy("file", "stream", "block").agg(F.max("line_no").alias("end"))
    open_ = lines.where("opened is null")
    asked = open_.select("file", "stream", "block").distinct()
    # The last head of a stream before each block that asks for one.
    both = ends.unionByName(asked.withColumn("end", F.lit(None).cast("int")))
    before = Window.partitionBy("file", "stream").orderBy("block", F.asc_nulls_first("end")).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where("end is null and carried is not null").select("file", "stream", "block", "carried")
    late = open_.join(small(cut(carried)), ["file", "stream", "block"], "left").withColumn("first_line", F.coalesce("carried", "line_no")).drop("carried")
    return lines.where("opened is not null").withColumn("first_line", F.col("opened")).unionByName(late)


def parse_entries(log_lines: DataFrame, share: float = SHARE, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """One row per log entry: log_file, stream, first_line, last_line, ts, stamp, level, component, message,
    iteration, rmse, seconds, features, listed (whether there are features).

    `log_lines`: log_file, line_no, raw_line. A line that starts as an entry does (a timestamp in any of the known
    notations, or an opening brace) opens one; other lines continue the last entry of their stream, a stream being a
    process of a file (`[job,rank]<stdout>:` before the line) or the file itself. first_line and last_line are the
    first and last lines that are not blank. Fields come from the mined templates (see plan_of); the first line of an
    entry that states a field decides. `stamp` is the timestamp as written, `ts` as a timestamp; where the year is not
    written it is that of the line's shipped_at, if the table has it, else `ts` is null; level is null where none is
    written; number notations (decimal comma, exponent) are read.
    - A line before any entry of its stream is an entry of its own without timestamp.
    - Lines of one file and line_no count once (the greatest text of them); null log_file is a file of its own; lines
      with null line_no come out nowhere; a null raw_line is a blank line; blank lines alone make no entry.
    - Files are worked on in blocks of `block` lines, heads are carried over blocks, so no file has to fit into a task.
      An entry's own lines are gathered for its message only, which is one cell of the result. Empty tables give
      empty results.
    """
    lines = _lines(log_lines, block)
    plans = mined_plans(_shapes(lines), share, least).drop("n", "template", "way")
    named = plans.withColumnsRenamed({c: "at_" + c for c in ("iteration", "rmse", "seconds")})
    d = _with_first(lines).join(small(named), "shape")
    # Numbers are taken out only of lines whose plan names one of them (or has some before the message).
    d = d.withColumn("rest", F.expr("substring(body, length(lead) + 1)"))
    asked = F.col("at_iteration").isNotNull() | F.col("at_rmse").isNotNull() | F.col("at_seconds").isNotNull()
    taken = lambda when: F.when(when, F.regexp_extract_all(F.coalesce("masked", "rest"), F.lit(_NUMBER), F.lit(0)))
    d = d.withColumn("numbers", taken(asked))
    literal = lambda c: F.get("numbers", F.col("at_" + c))
    value = lambda c: F.expr(f"try_cast(replace(get(numbers, at_{c}), ',', '.') as double)")
    feats = F.when(F.col("shape").contains(LIST), F.regexp_extract_all("rest", F.lit(_FEATURE), F.lit(0)))
    keyed = F.regexp_extract("rest", r'(?:\bmsg=|"(?:msg|message)"\s*:\s*)"((?:[^"\\]|\\.)*)"', 1)
    before = F.slice(taken(F.col("cut_numbers") > 0), F.lit(1), F.greatest(F.col("cut_numbers"), F.lit(0)))
    lead = F.col("cut") - F.col("cut_numbers") + F.coalesce(F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x)), F.lit(0))
    d = d.withColumns({
        "_it": F.when(literal("iteration").rlike(r"^\d{1,9}$"), literal("iteration").cast("int")), "_rmse": value("rmse"), "_sec": value("seconds"),
        "_feats": feats, "_lists": F.col("shape").contains(LIST),
        "_stamp": F.coalesce(F.when(F.col("lead") != "", F.regexp_extract("body", _HEAD, 2)), F.when(F.col("stamped"), F.regexp_extract("rest", _STAMPS[0], 0))),
        "_level": F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SYSLOG.items() for x in kv]), F.coalesce("severity", F.lit(""))), F.col("level")),
        "_json": F.col("head") & F.col("body").startswith("{"),
        "_keyed": F.when(F.col("keyed"), keyed),
        "_text": F.when(F.col("line_no") == F.col("first_line"), F.substring(F.col("rest"), lead + 1, F.length("rest"))).otherwise(F.col("body")),
    })
    when_there = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    groups = d.groupBy("file", "stream", "first_line").agg(
        F.max("line_no").alias("last_line"), F.min("shipped").alias("shipped"),
        when_there("_it").alias("iteration"), when_there("_rmse").alias("rmse"), when_there("_sec").alias("seconds"),
        F.min(F.when(F.col("listed"), F.col("line_no"))).alias("_from"), F.max(F.when(F.col("_lists"), F.col("line_no"))).alias("_upto"),
        F.array_sort(F.collect_list(F.when(F.col("_lists"), F.struct("line_no", "_feats")))).alias("_all"),
        when_there("_stamp").alias("stamp"), when_there("_level").alias("level"), when_there("component").alias("component"),
        F.bool_or("_json").alias("_json"), when_there("_keyed").alias("_keyed"), F.array_sort(F.collect_list(F.struct("line_no", "_text"))).alias("_texts"),
    )
    listed = F.flatten(F.transform(F.filter("_all", lambda x: x["line_no"] >= F.col("_from")), lambda x: x["_feats"]))
    rest = F.trim(F.array_join(F.transform("_texts", lambda x: x["_text"]), "\n"), F.lit(" \n"))
    follow = F.trim(F.array_join(F.concat(F.array("_keyed"), F.transform(F.filter("_texts", lambda x: x["line_no"] > F.col("first_line")), lambda x: x["_text"])), "\n"), F.lit(" \n"))
    message = F.when(F.col("_json") & F.col("_keyed").isNotNull(), F.col("_keyed")).when(F.col("_keyed").isNotNull(), follow).otherwise(rest)
    s = F.col("stamp")
    at = lambda text, form: F.try_to_timestamp(text, F.lit(form))
    ts = F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(s, ",", "."), "Z$", ""))),
        F.when(s.rlike(r"^\d{4}\."), at(s, "yyyy.MM.dd HH:mm:ss")),
        F.when(s.rlike(r"^\d\d/"), at(s, "dd/MM/yyyy HH:mm:ss")),
        F.when(s.rlike(r"^[A-Z]"), _with_year(s)),
        F.when(s.rlike(r"^\d{9,}"), F.timestamp_micros((F.expr("try_cast(stamp as decimal(20,6))") * 1_000_000).cast("long"))),
    )
    return groups.select(
        F.nullif("file", F.lit("\0")).alias("log_file"), "stream", "first_line", "last_line", "stamp", "level", "component", message.alias("message"),
        "iteration", "rmse", "seconds", F.when(F.col("_upto") >= F.col("_from"), listed).alias("features"), ts.alias("ts"),
        F.coalesce(F.col("_upto") >= F.col("_from"), F.lit(False)).alias("listed"),
    )


def _with_year(stamp: Column) -> Column:
    """A stamp without year as of the last year in which it lies before the entry was shipped (a day's grace)."""
    year, text = F.year("shipped"), F.regexp_replace(stamp, " +", " ")
    at = lambda y: F.try_to_timestamp(F.concat_ws(" ", y.cast("string"), text), F.lit("yyyy MMM d HH:mm:ss"))
    known = F.col("shipped").isNotNull()
    return F.when(known, F.when(at(year) <= F.col("shipped") + F.expr("INTERVAL 1 DAY"), at(year)).otherwise(F.coalesce(at(year - 1), at(year))))


def mined_templates(log_lines: DataFrame, share: float = SHARE, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """template, way, lines, shapes: the templates found, and how many lines each stands for.

    `way` is 'fallback' where a word that is no constant named a value, or where no word of the line is a constant.
    Empty tables give empty results.
    """
    plans = mined_plans(_shapes(_lines(log_lines, block)), share, least)
    return plans.groupBy("template", "way").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("shapes"))


def stated(entries: DataFrame) -> DataFrame:
    """Entries that state an iteration number with an RMSE, a list of features or a number of seconds."""
    more = F.col("rmse").isNotNull() | F.col("listed") | F.col("seconds").isNotNull()
    return entries.where(F.col("iteration").isNotNull() & more)

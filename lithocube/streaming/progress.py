"""Following a run's log while it is written: the metrics of new lines, kept per iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.operators.loglines import LABELS


def metrics(lines: DataFrame, line: str = "value") -> DataFrame:
    """iteration, rmse, seconds of lines of a run's log, by their labels; lines without an iteration are left out."""
    word = "|".join(w for w in LABELS["iteration"] if w.isascii())
    number = r"([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    it = F.regexp_extract(line, rf"(?i)\b(?:{word})\W{{0,3}}(\d+)", 1).try_cast("int")
    rmse = F.regexp_extract(line, rf"(?i)\brmse\W{{0,3}}{number}", 1).try_cast("double")
    seconds = F.regexp_extract(line, rf"(?i)\b(?:seconds|took|time\(s\))\W{{0,3}}{number}", 1).try_cast("double")
    return lines.select(it.alias("iteration"), rmse.alias("rmse"), seconds.alias("seconds")).where("iteration is not null")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the metrics of lines that files in `folder` gain."""
    return metrics(spark.readStream.format("text").load(folder))


def latest(stream: DataFrame) -> DataFrame:
    """Per iteration: the least RMSE, the sum of seconds, lines seen."""
    return stream.groupBy("iteration").agg(F.min("rmse").alias("rmse"), F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("lines"))

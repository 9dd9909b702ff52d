"""Comparing sets of predictions, and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["x", "y", "z"]


def without_repeats(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points once per x, y, z, phi, and how many repeats there were."""
    once = p.groupBy(*KEY, "phi").agg(F.count(F.lit(1)).alias("_n"))
    return once.drop("_n"), once.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"))


def full_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """x, y, z, phi_x, phi_y, merge: points of either set, and in which of them they are."""
    l = a.select(*KEY, F.col("phi").alias("phi_x"), F.lit(1).alias("_a"))
    r = b.select(*KEY, F.col("phi").alias("phi_y"), F.lit(1).alias("_b"))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return l.join(r, KEY, "full").withColumn("merge", side).drop("_a", "_b")


def left_compare(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of `a` that `b` lacks, and points of both."""
    return a.join(b.select(*KEY), KEY, "left_anti"), intersection(a, b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY, F.col("phi").alias("phi_x")).join(b.select(*KEY, F.col("phi").alias("phi_y")), KEY)


def total_difference(a: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Sum of phi_x - phi_y over common points, and whether it is practically zero."""
    d = F.coalesce(F.sum(F.col("phi_x") - F.col("phi_y")), F.lit(0.0))
    return intersection(a, b).agg(d.alias("diff")).withColumn("same", F.abs("diff") <= tolerance)


def checked_errors(predicted: DataFrame, truth: DataFrame, strict: bool = True) -> DataFrame:
    """RMSE and MAE of predicted points against truth; with `strict`, a predicted point that truth lacks is an error."""
    t = truth.select(*KEY, F.col("phi").alias("phi_t"))
    j = predicted.join(t, KEY, "left")
    truth_value: Column = F.when(F.col("phi_t").isNull(), F.raise_error(F.lit("a predicted point is missing in the truth"))).otherwise(F.col("phi_t")) if strict else F.col("phi_t")
    e = F.col("phi") - truth_value
    return j.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n"))


def error_metrics(points: DataFrame, truth: str, predicted: str, by: str = "well_id") -> DataFrame:
    """RMSE, MAE and number per `by`, and of all points together in the row whose `by` is null."""
    e = F.col(truth) - F.col(predicted)
    return points.groupingSets([[by], []], by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n"))


def mean_of_folds(metrics: DataFrame, by: str = "well_id") -> DataFrame:
    """Unweighted means over the wells' metrics (not the same as the pooled error)."""
    return metrics.where(F.col(by).isNotNull()).agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("folds"))

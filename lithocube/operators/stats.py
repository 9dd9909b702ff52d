"""Statistics of porosities, features and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_and_deviation(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, sample deviation and number of `value` (NaN aside), per `by`."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 1) and n of values in [low, high], the upper end in the last bin; empty bins are left out."""
    inside = df.where(F.col(value).between(low, high) & ~F.isnan(value))
    return inside.groupBy(F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("bigint")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def z_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """z of the difference of two samples' means: (mean a - mean b) / sqrt(var a / n + var b / n), population variances."""
    s = lambda d, n: d.agg(F.avg(value).alias(f"m{n}"), F.var_pop(value).alias(f"v{n}"), F.count(value).alias(f"n{n}"))
    j = s(a, 1).join(F.broadcast(s(b, 2)))  # one row each
    return j.select(F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("z"))


def bootstrap_z(df: DataFrame, value: str, side: str, key: str, n: int = 10, reps: int = 100, seed: int = 9) -> DataFrame:
    """rep, z of `reps` resamples with replacement of about `n` rows of each side (`side` true or false).

    A row is taken a Poisson number of times in all replicates together, and each time a replicate is drawn for it, by
    hashes: about n * reps hits come out, and no row is met once a replicate.
    """
    sizes = df.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(float(n) * reps) / F.col("_n"))
    # Rows with more than one hit to expect are drawn for in so many parts, each with at most one to expect.
    sizes = sizes.withColumn("_parts", F.ceil("_all")).withColumn("_rate", F.col("_all") / F.col("_parts"))
    # Number of hits of a Poisson variable: the steps of its distribution function that lie below a uniform number.
    terms = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.exp(-F.col("_rate") + i * F.log("_rate") - F.log(F.factorial(i))))
    grow = lambda a, t: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + t)
    steps = sizes.select(side, "_parts", F.aggregate(terms, F.array().cast("array<double>"), grow).alias("_cdf"))
    d = df.where(F.col(value).isNotNull()).select(key, side, value).join(F.broadcast(steps.limit(3)), side)  # one row a side
    d = d.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    u = (F.pmod(F.xxhash64(key, "part", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    d = d.withColumn("u", u).where(F.col("u") >= F.get("_cdf", F.lit(0)))
    d = d.withColumn("hit", F.explode(F.sequence(F.lit(1), F.size(F.filter("_cdf", lambda c: c <= F.col("u"))))))
    d = d.select(F.pmod(F.xxhash64(key, "part", "hit", F.lit(seed + 1)), F.lit(reps)).cast("int").alias("rep"), side, value, F.lit(1).alias("k"))
    m = d.groupBy("rep", side).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col(value)).alias("s"), F.sum(F.col("k") * F.col(value) ** 2).alias("q"))
    m = m.select("rep", side, "n", (F.col("s") / F.col("n")).alias("m"), F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("v"))
    one = lambda f, c: F.max(F.when(f, F.col(c)))
    t, f = F.col(side), ~F.col(side)
    g = m.groupBy("rep").agg(one(t, "m").alias("m1"), one(t, "v").alias("v1"), one(t, "n").alias("n1"), one(f, "m").alias("m2"), one(f, "v").alias("v2"), one(f, "n").alias("n2"))
    return g.select("rep", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("z"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls and NaN of every column."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.agg(*[F.count_if(F.col(c).isNull() | (F.isnan(c) if c in floats else F.lit(False))).alias(c) for c in df.columns])


def feature_ranks(results: DataFrame, features: str = "features", iteration: str = "iteration", sep: str = r",\s*") -> DataFrame:
    """prefix, n, ranks: how often each cube's attributes were chosen, and at which (iteration, rank)."""
    each = results.where(F.col(features).isNotNull()).select(iteration, F.posexplode(F.split(features, sep)).alias("rank", "f"))
    name = F.split_part(F.trim("f"), F.lit("_"), F.lit(1))
    return each.groupBy(name.alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.struct(F.col(iteration).alias("iteration"), F.col("rank").cast("int").alias("rank")))).alias("ranks")
    )


def explained_variance(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """component (from 1), variance share and cumulative share of the standardised columns; NaN and null count as 0."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    clean = df.select(*[F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    v = VectorAssembler(inputCols=clean.columns, outputCol="all").transform(clean)
    v = StandardScaler(inputCol="all", outputCol="scaled", withMean=True, withStd=True).fit(v).transform(v)
    shares = PCA(k=k or len(columns), inputCol="scaled", outputCol="p").fit(v).explainedVariance.toArray().tolist()
    rows, upto = [], 0.0
    for i, s in enumerate(shares):
        upto += s
        rows.append((i + 1, float(s), float(upto)))
    return df.sparkSession.createDataFrame(rows, "component int, share double, cumulative double")


def consecutive_difference(df: DataFrame, order: str, value: str) -> DataFrame:
    """`value` less that of the row before (of results, few per run)."""
    from pyspark.sql import Window

    return df.withColumn("difference", F.col(value) - F.lag(value).over(Window.partitionBy().orderBy(order)))


def points_per_tile(cube: DataFrame, train: Sequence[int], test: Sequence[int], tile: int = 100) -> DataFrame:
    """tx, ty, train and test points of every tile, in one pass."""
    w = F.col("well_id")
    return cube.groupBy(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(
        F.count_if(w.isin(*train)).alias("train"), F.count_if(w.isin(*test)).alias("test")
    )

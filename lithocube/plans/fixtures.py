"""Tables the queries derive from the given ones, as DataFrames and as SQL: a feature cube, wells, a cube's state,
two sets of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithocube.operators.geometry import assign_rings
from lithocube.session import read

#: A vector of `embeddings` is a trace of 64 samples, twenty traces a line.
NX, NZ = 20, 64
WELLS = [(0, 4, 5), (1, 12, 10), (2, 17, 20), (3, 8, 15)]
TEST = [3]
TRAIN = [w for w in WELLS if w[0] not in TEST]
#: Rings that are filled in the cube's state.
FILLED = 4

CUBE = """embeddings_cube AS (SELECT CAST(vec_id % 20 AS INTEGER) AS x, CAST(vec_id // 20 AS INTEGER) AS y, CAST(z AS INTEGER) AS z,
  CAST(embedding[z + 1] AS DOUBLE) AS amp FROM embeddings, range(64) samples(z))"""
SHAPE = "shape AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM embeddings_cube)"
WELL_ROWS = "wells(well_id, wx, wy) AS (VALUES " + ", ".join(f"({w}, {x}, {y})" for w, x, y in WELLS) + ")"
OWN = f"""cols AS (SELECT DISTINCT x, y FROM embeddings_cube),
own AS (SELECT x, y, well_id, ring FROM (SELECT x, y, well_id, greatest(abs(x - wx), abs(y - wy)) AS ring,
    row_number() OVER (PARTITION BY x, y ORDER BY greatest(abs(x - wx), abs(y - wy)), well_id) AS rn
  FROM cols, wells WHERE well_id NOT IN ({', '.join(map(str, TEST))})) WHERE rn = 1)"""
STATE = f"""state AS (SELECT e.x, e.y, e.z,
    CASE WHEN w.well_id IS NOT NULL OR o.ring <= {FILLED} THEN e.amp * 10 ELSE 0.0 END AS phi,
    CASE WHEN w.well_id IS NOT NULL THEN 0 WHEN o.ring <= {FILLED} THEN 1 ELSE 5 END AS real,
    CASE WHEN w.well_id IS NOT NULL THEN 0 WHEN o.ring <= {FILLED} THEN o.ring ELSE -1 END AS ring,
    CASE WHEN w.well_id IS NOT NULL THEN w.well_id WHEN o.ring <= {FILLED} THEN o.well_id ELSE -1 END AS well_id
  FROM embeddings_cube e JOIN own o USING (x, y) LEFT JOIN wells w ON e.x = w.wx AND e.y = w.wy)"""
WITH_STATE = f"WITH {CUBE}, {WELL_ROWS}, {OWN}, {STATE} "
PREDICTIONS = """pred_a AS (SELECT l_orderkey AS x, CAST(l_linenumber AS BIGINT) AS y, CAST(0 AS BIGINT) AS z, sum(l_quantity) AS phi FROM lineitem GROUP BY ALL),
pred_b AS (SELECT l_partkey AS x, CAST(l_linenumber AS BIGINT) AS y, CAST(0 AS BIGINT) AS z, sum(l_quantity) AS phi FROM lineitem GROUP BY ALL)"""


def traces(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.pmod("vec_id", F.lit(NX)).cast("int").alias("x"), F.floor(F.col("vec_id") / NX).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("amp"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    return traces(spark, d).select("x", "y", F.posexplode("amp").alias("z", "amp"))


def state(spark: SparkSession, d: str) -> DataFrame:
    """The cube's state after FILLED rings: x, y, z, phi, real, ring, well_id."""
    c = assign_rings(cube(spark, d), TRAIN)
    own = F.lit(None).cast("int")
    for w, x, y in WELLS:
        own = F.when((F.col("x") == x) & (F.col("y") == y), w).otherwise(own)
    filled = F.col("ring") <= FILLED
    return c.withColumn("own", own).select(
        "x", "y", "z",
        F.when(F.col("own").isNotNull() | filled, F.col("amp") * 10).otherwise(0.0).alias("phi"),
        F.when(F.col("own").isNotNull(), 0).when(filled, 1).otherwise(5).alias("real"),
        F.when(F.col("own").isNotNull(), 0).when(filled, F.col("ring")).otherwise(-1).alias("ring"),
        F.coalesce("own", F.when(filled, F.col("well_id")), F.lit(-1)).alias("well_id"),
    )


def predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = read(spark, d, "lineitem")
    make = lambda c: l.groupBy(F.col(c).alias("x"), F.col("l_linenumber").cast("long").alias("y"), F.lit(0).cast("long").alias("z")).agg(F.sum("l_quantity").alias("phi"))
    return make("l_orderkey"), make("l_partkey")

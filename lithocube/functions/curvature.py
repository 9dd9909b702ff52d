"""Surface attributes as column expressions over the quadratic surface's parameters (published by Roberts, 2001).

Parameters: a = Zxx / 2, b = Zyy / 2, c = Zxy, d = Zx, e = Zy. A division of zero by zero, or a negative number under a
root, gives NaN; another division by zero gives an infinity, as IEEE arithmetic has it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAN = float("nan")


def over(n: Column, m: Column) -> Column:
    """n / m by IEEE rules; ANSI SQL would fail on zero."""
    zero = F.when((n == 0) | F.isnan(n), _NAN).otherwise(F.signum(n) * float("inf"))
    return F.coalesce(F.try_divide(n, m), F.when(m.isNotNull() & n.isNotNull(), zero))


def root(v: Column) -> Column:
    return F.when(v < 0, _NAN).otherwise(F.sqrt(v))


#: Helper columns that several attributes share; computed once per point, in this order.
SHARED = ("_g", "_mean", "_gauss", "_off", "_bend")


def with_shared(df: DataFrame) -> DataFrame:
    """`df` (with columns a, b, c, d, e) and the helper columns, each stage a projection of its own."""
    a, b, c, d, e = [F.col(n) for n in "abcde"]
    df = df.withColumns({"_g": 1 + d * d + e * e, "_bend": 2 * (a * e * e - c * d * e + b * d * d)})
    g = F.col("_g")
    df = df.withColumns({"_mean": (a * (1 + e * e) - c * d * e + b * (1 + d * d)) / (g * F.sqrt(g)), "_gauss": (4 * a * b - c * c) / (g * g)})
    return df.withColumn("_off", root(F.col("_mean") * F.col("_mean") - F.col("_gauss")))


def attributes() -> dict[str, Column]:
    """All surface attributes by name, over the columns of with_shared."""
    a, b, c, d, e = [F.col(n) for n in "abcde"]
    g, mean, gauss, off, bend = [F.col(n) for n in SHARED]
    across = root((a - b) * (a - b) + c * c)
    return {
        "dip_angle": F.atan(F.sqrt(d * d + e * e)),
        "azimuth": F.atan(over(e, d)),
        "mean_curvature": mean,
        "gaussian_curvature": gauss,
        "max_curvature": mean + off,
        "min_curvature": mean - off,
        "most_positive_curvature": a + b + across,
        "most_negative_curvature": a + b - across,
        "shape_index": F.lit(2 / math.pi) * F.atan(over(2 * mean, 2 * off)),
        "dip_curvature": over(bend, F.sqrt(g) * (d * d + e * e)),
        "contour_curvature": bend / (g * F.sqrt(g)),
        "curvedness": F.sqrt(mean * mean + off * off),
    }


#: Names under which the attributes were also known.
ALIASES = {"contur-curvature": "contour_curvature"}

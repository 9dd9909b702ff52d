"""Small scalar functions of names, depths and indices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_distance(x: Column, y: Column, wx: Column | int, wy: Column | int) -> Column:
    """Square (Chebyshev) distance: the ring on which a point lies around a well."""
    return F.greatest(F.abs(x - wx), F.abs(y - wy))


def well_type(min_depth: Column, max_depth: Column) -> Column:
    """complete (a range of at least 2000), else top (ends above 4000), else bottom; null bounds give null."""
    known = min_depth.isNotNull() & max_depth.isNotNull()
    kind = F.when(max_depth - min_depth >= 2000, "complete").when(max_depth < 4000, "top").otherwise("bottom")
    return F.when(known, kind)


def round_half_even(v: Column, digits: int = 4) -> Column:
    return F.bround(v, digits)


def depth_index(z: Column, resolution: Column | float, start: Column) -> Column:
    """Index of a depth among samples of `resolution` that begin with the one that holds `start`."""
    return (F.floor(z / resolution) - F.floor(start / resolution)).cast("int")


def linear_index(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    """Row-major number of a point."""
    return (x.cast("long") * ny + y) * nz + z


def from_linear(i: Column, ny: int, nz: int) -> tuple[Column, Column, Column]:
    return F.floor(i / (ny * nz)), F.pmod(F.floor(i / nz), F.lit(ny)), F.pmod(i, F.lit(nz))


def name_of_file(path: Column) -> Column:
    """Well name of a log's file: its stem up to the first underscore, in capitals."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.upper(F.split_part(stem, F.lit("_"), F.lit(1)))


def feature_prefix(feature: Column) -> Column:
    """Cube a feature was made from: what stands before the first underscore of its name."""
    return F.split_part(F.split_part(F.trim(feature), F.lit(" "), F.lit(1)), F.lit("_"), F.lit(1))


def feature_text(name: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """NAME/dx,dy,dz"""
    return F.concat(name, F.lit("/"), F.concat_ws(",", dx.cast("string"), dy.cast("string"), dz.cast("string")))


def is_header(line: Column) -> Column:
    """A line is a header if none of its tokens is a number."""
    tokens = F.split(F.trim(line), r"[\s,;]+")
    return ~F.exists(tokens, lambda t: t.try_cast("double").isNotNull())


def yes_or_no(text: str) -> bool:
    """Settings write truth as y, yes, on, true or n, no, off, false."""
    low = str(text).strip().lower()
    if low in ("y", "yes", "on", "true"):
        return True
    if low in ("n", "no", "off", "false"):
        return False
    raise ValueError(f"neither yes nor no: {text!r}")


def beta_density(at: Column, alpha: float, beta: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    """Density of the beta distribution, 0 outside [loc, loc + scale]."""
    u = (at - loc) / scale
    log_c = math.lgamma(alpha + beta) - math.lgamma(alpha) - math.lgamma(beta)
    inner = F.exp(log_c + (alpha - 1) * F.log(u) + (beta - 1) * F.log(1 - u)) / scale
    edge = {True: math.exp(log_c) / scale}.get(alpha == 1 and beta == 1, 0.0)
    return F.when((u > 0) & (u < 1), inner).when((u == 0) | (u == 1), edge).otherwise(0.0)

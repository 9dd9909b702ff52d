"""Square rings around wells: who owns a point, how many are covered, when a well reaches one.

Wells are a short list of settings, so they are part of the expressions: no join, no shuffle, and the work stays in the
scan's own stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithocube.functions.scalars import ring_distance
from lithocube.schema import State

#: (well_id, x, y)
Well = tuple[int, int, int]


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def owner(wells: Sequence[Well], start: int = 0) -> Column:
    """struct(ring, well_id) of the well that reaches column (x, y) first; of wells on one ring, the earlier listed.

    Only rings from `start` on count; null if there is none.
    """
    reach = []
    for place, (well_id, wx, wy) in enumerate(wells):
        ring = ring_distance(F.col("x"), F.col("y"), wx, wy).cast("int")
        reach.append(F.when(ring >= start, F.struct(ring.alias("ring"), F.lit(place).alias("place"), F.lit(well_id).alias("well_id"))))
    return _least(reach)


def assign_rings(points: DataFrame, wells: Sequence[Well], start: int = 0) -> DataFrame:
    """`points` with the ring and well that fill each of them, in closed form (no loop over rings)."""
    return points.withColumn("_o", owner(wells, start)).select("*", F.col("_o.ring").alias("ring"), F.col("_o.well_id").alias("well_id")).drop("_o")


def frontier(cube: DataFrame, wells: Sequence[Well], ring: int, state: int = State.EMPTY) -> DataFrame:
    """Points of `state` that ring `ring` fills: those no earlier ring reaches, each with its well.

    With canal points as the state it predicts where truth is known; state NONE matches nothing.
    """
    got = cube.drop("ring", "well_id").where(F.col("real") == int(state)).withColumn("_o", owner(wells, min(1, ring)))
    return got.where(F.col("_o.ring") == ring).select("*", F.col("_o.ring").alias("ring"), F.col("_o.well_id").alias("well_id")).drop("_o")


def touches(wells: Sequence[Well], low: int, high: int, tile: int) -> Column:
    """Whether tile (tx, ty) meets the border of a square ring from `low` to `high` of any well: a tile wholly inside
    the inner square, or wholly outside the outer one, needs no read."""
    x0, y0 = F.col("tx") * tile, F.col("ty") * tile
    x1, y1 = x0 + tile - 1, y0 + tile - 1
    found = []
    for _, wx, wy in wells:
        near = F.greatest(F.lit(0), x0 - wx, wx - x1, y0 - wy, wy - y1)
        far = F.greatest(F.abs(x0 - wx), F.abs(x1 - wx), F.abs(y0 - wy), F.abs(y1 - wy))
        found.append((near <= high) & (far >= low))
    return reduce(lambda a, b: a | b, found)


def reached(points: DataFrame, wells: Sequence[Well], it: int) -> DataFrame:
    """`points` with the wells whose square at iteration `it` covers them, by arrival; only covered points."""
    each = F.array(*[F.struct(ring_distance(F.col("x"), F.col("y"), wx, wy).cast("int").alias("ring"), F.lit(w).alias("well_id")) for w, wx, wy in wells])
    got = points.withColumn("wells", F.array_sort(F.filter(each, lambda s: s["ring"] <= it)))
    return got.where(F.size("wells") > 0)


def first_to_reach(points: DataFrame, wells: Sequence[Well]) -> DataFrame:
    """`points` with `its`, the iterations until a well reaches them, and `well_id` of that well (lowest id on ties)."""
    each = [F.struct(ring_distance(F.col("x"), F.col("y"), wx, wy).cast("int").alias("its"), F.lit(w).alias("well_id")) for w, wx, wy in wells]
    return points.withColumn("_f", _least(each)).select("*", "_f.its", "_f.well_id").drop("_f")


@dataclass(frozen=True)
class Box:
    """Size of the volume: columns nx by ny, samples nz."""

    nx: int
    ny: int
    nz: int

    def __post_init__(self) -> None:
        for n in (self.nx, self.ny, self.nz):
            if isinstance(n, bool) or not isinstance(n, int):
                raise TypeError("sizes must be whole numbers")
            if n < 1:
                raise ValueError("sizes must be at least 1")


def checked(wells: Sequence[Well], box: Box) -> list[Well]:
    """The wells without repeats; those outside the box or with coordinates that are no whole numbers are errors."""
    out: dict[tuple[int, int], Well] = {}
    for w, x, y in wells:
        if not all(isinstance(v, int) and not isinstance(v, bool) for v in (w, x, y)):
            raise TypeError("wells must be whole numbers")
        if not (0 <= x < box.nx and 0 <= y < box.ny):
            raise ValueError(f"well {w} lies outside the volume")
        out.setdefault((x, y), (w, x, y))
    return list(out.values())


def extent(well: Well, it: int, box: Box) -> tuple[int, int, int, int]:
    """x0, x1, y0, y1 of a well's square at iteration `it`, cut at the box."""
    if isinstance(it, bool) or not isinstance(it, int):
        raise TypeError("iteration must be a whole number")
    if it < 0:
        raise ValueError("iteration must be 0 or more")
    _, x, y = well
    return max(x - it, 0), min(x + it, box.nx - 1), max(y - it, 0), min(y + it, box.ny - 1)


def predicted_by(well: Well, it: int, box: Box) -> int:
    """Points that one well alone has predicted: its square without its own column."""
    x0, x1, y0, y1 = extent(well, it, box)
    return ((x1 - x0 + 1) * (y1 - y0 + 1) - 1) * box.nz


def overlap_volume(a: Well, b: Well, it: int, box: Box) -> int:
    """Points covered by both wells' squares; a square of one column (iteration 0) overlaps nothing."""
    if it == 0:
        return 0
    ax0, ax1, ay0, ay1 = extent(a, it, box)
    bx0, bx1, by0, by1 = extent(b, it, box)
    w, h = min(ax1, bx1) - max(ax0, bx0) + 1, min(ay1, by1) - max(ay0, by0) + 1
    return w * h * box.nz if w > 0 and h > 0 else 0


def coverage(columns: DataFrame, wells: Sequence[Well], it: int) -> DataFrame:
    """x, y, n: how many wells' squares cover each column at iteration `it`; the wells' own columns count 0."""
    n = reduce(lambda a, b: a + b, [(ring_distance(F.col("x"), F.col("y"), wx, wy) <= it).cast("int") for _, wx, wy in wells])
    own = reduce(lambda a, b: a | b, [(F.col("x") == wx) & (F.col("y") == wy) for _, wx, wy in wells])
    return columns.select("x", "y").distinct().select("x", "y", F.when(own, 0).otherwise(n).alias("n"))


def covered_volumes(columns: DataFrame, wells: Sequence[Well], it: int, depth: int) -> DataFrame:
    """predicted and overlapping points of all wells together."""
    c = coverage(columns, wells, it)
    return c.agg((F.count_if(F.col("n") > 0) * depth).alias("predicted"), (F.count_if(F.col("n") > 1) * depth).alias("overlap"))


def iterations_to_predict(columns: DataFrame, wells: Sequence[Well], depth: int, n: int) -> DataFrame:
    """its: the first iteration by which at least `n` points are predicted; 0 for n = 0, null if n are never reached.

    Points per ring are counted once; there are at most as many rings as the volume is wide.
    """
    if not wells:
        raise ValueError("no wells")
    if n == 0:
        return columns.sparkSession.range(1).select(F.lit(0).alias("its"))
    own = reduce(lambda a, b: a | b, [(F.col("x") == wx) & (F.col("y") == wy) for _, wx, wy in wells])
    rings = assign_rings(columns.select("x", "y").distinct().where(~own), wells).groupBy("ring").agg((F.count(F.lit(1)) * depth).alias("points"))
    upto = F.sum("points").over(Window.orderBy("ring"))
    return rings.withColumn("upto", upto).where(F.col("upto") >= n).agg(F.min("ring").alias("its"))


def rings_of_iteration(it: int, layers: int) -> range:
    """Rings that one iteration fills if each fills `layers` of them."""
    if layers < 1 or it < 0:
        raise ValueError("iteration must be 0 or more, layers at least 1")
    return range(it * layers, it * layers + layers)


def extents(wells: DataFrame, box: Box, it: Column) -> DataFrame:
    """`wells` (well_id, x, y) with x0, x1, y0, y1 of their squares at iteration `it`, cut at the box, and the points
    each alone has predicted."""
    x0, x1 = F.greatest(F.col("x") - it, F.lit(0)), F.least(F.col("x") + it, F.lit(box.nx - 1))
    y0, y1 = F.greatest(F.col("y") - it, F.lit(0)), F.least(F.col("y") + it, F.lit(box.ny - 1))
    w = wells.select("*", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    return w.withColumn("predicted", ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) - 1) * box.nz)


def _meeting(squares: DataFrame) -> DataFrame:
    """Pairs of `squares` (well_id, x0, x1, y0, y1) that overlap, with width and height: the columns of the one with the
    smaller well_id as `a_...`, of the other as `b_...`.

    Squares meet in the cells of a grid as wide as the widest of them, so each lies in at most four cells; a pair is kept
    in the cell that holds the overlap's first corner. Rows multiply on the way to the join and the planner's estimate
    does not see it, so the join is never left to a broadcast; both sides are one shuffle.
    """
    side = F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1).alias("_side")
    sized = squares.join(F.broadcast(squares.agg(side)))  # one row
    cell = lambda c: F.floor(F.col(c) / F.col("_side"))
    sized = sized.withColumn("_cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("_cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    end = lambda s: sized.select("_side", "_cx", "_cy", *[F.col(c).alias(f"{s}_{c}") for c in squares.columns])
    j = end("a").join(end("b").hint("merge"), ["_side", "_cx", "_cy"]).where("a_well_id < b_well_id")
    j = j.withColumns({"_x": F.greatest("a_x0", "b_x0"), "_y": F.greatest("a_y0", "b_y0")})
    j = j.withColumns({"width": F.least("a_x1", "b_x1") - F.col("_x") + 1, "height": F.least("a_y1", "b_y1") - F.col("_y") + 1})
    return j.where((F.col("width") > 0) & (F.col("height") > 0) & (cell("_x") == F.col("_cx")) & (cell("_y") == F.col("_cy")))


def overlaps(squares: DataFrame, box: Box) -> DataFrame:
    """a, b (a < b), width, height and points that both wells' squares (see extents) cover; only pairs that overlap,
    and none at iteration 0."""
    j = _meeting(squares.where("x0 < x1 or y0 < y1").select("well_id", "x0", "x1", "y0", "y1"))
    return j.select(F.col("a_well_id").alias("a"), F.col("b_well_id").alias("b"), "width", "height", (F.col("width") * F.col("height") * box.nz).alias("points"))


def overlap_volumes(wells: DataFrame, box: Box, last: int) -> DataFrame:
    """it, a, b (a < b) and points that both wells' squares cover, at each iteration from 1 to `last` at which they
    overlap.

    Squares only grow, so pairs are looked for once, at the last iteration, and followed back to their first.
    """
    if last < 1:
        raise ValueError("last iteration must be at least 1")
    j = _meeting(extents(wells, box, F.lit(last)).select("well_id", "x", "y", "x0", "x1", "y0", "y1"))
    apart = F.greatest(F.abs(F.col("a_x") - F.col("b_x")), F.abs(F.col("a_y") - F.col("b_y")))
    j = j.withColumn("it", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(apart / 2).cast("int")), F.lit(last))))
    span = lambda c, n: F.least(F.least(f"a_{c}", f"b_{c}") + F.col("it"), F.lit(n - 1)) - F.greatest(F.greatest(f"a_{c}", f"b_{c}") - F.col("it"), F.lit(0)) + 1
    return j.select("it", F.col("a_well_id").alias("a"), F.col("b_well_id").alias("b"), (span("x", box.nx) * span("y", box.ny) * box.nz).alias("points"))

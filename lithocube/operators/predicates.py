"""Conjunctions of predicates on cube points, kept as data so they can be shown and pushed down to the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithocube.schema import State


def _ids(ids: Sequence) -> tuple:
    if not isinstance(ids, (list, tuple)):
        raise TypeError("ids must be a list or tuple")
    return tuple(ids)


@dataclass(frozen=True)
class Points:
    """Which points to take; each method gives a narrower copy. No predicate takes all points."""

    min_ring: int | None = None
    ring: int | None = None
    in_wells: tuple = ()
    not_in_wells: tuple = ()
    coords: tuple = ()
    states: tuple = field(default=())

    def from_ring(self, n: int) -> Points:
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("ring must be a whole number, 0 or more")
        return replace(self, min_ring=n)

    def at_ring(self, n: int) -> Points:
        """Only ring n; replaces a ring asked for before."""
        return replace(self, ring=n)

    def wells(self, ids: Sequence) -> Points:
        """Only these wells; an empty list does not filter."""
        return replace(self, in_wells=_ids(ids))

    def without_wells(self, ids: Sequence) -> Points:
        return replace(self, not_in_wells=_ids(ids))

    def at_coords(self, coords: Sequence) -> Points:
        """Only points on these (x, y)."""
        return replace(self, coords=tuple((int(x), int(y)) for x, y in _ids(coords)))

    def of_state(self, *states: int) -> Points:
        return replace(self, states=tuple(int(s) for s in states))

    def predicates(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        if self.min_ring is not None:
            out["min_ring"] = F.col("ring") >= self.min_ring
        if self.ring is not None:
            out["ring"] = F.col("ring") == self.ring
        if self.in_wells:
            out["in_wells"] = F.col("well_id").isin(*self.in_wells)
        if self.not_in_wells:
            out["not_in_wells"] = ~F.col("well_id").isin(*self.not_in_wells)
        if self.coords:
            out["coords"] = reduce(lambda a, b: a | b, [(F.col("x") == x) & (F.col("y") == y) for x, y in self.coords])
        if self.states:
            out["states"] = F.col("real").isin(*self.states)
        return out

    def __len__(self) -> int:
        return len(self.predicates())

    def __str__(self) -> str:
        return " and ".join(self.predicates()) or "all points"

    def of(self, cube: DataFrame) -> DataFrame:
        return cube.where(reduce(lambda a, b: a & b, self.predicates().values(), F.lit(True)))

    def count(self, cube: DataFrame) -> DataFrame:
        return self.of(cube).agg(F.count(F.lit(1)).alias("n"))


#: Points that train the model of a ring, that train feature selection, and that validate a fold.
PREDICTION = Points().of_state(State.REAL, State.PROPAGATED)
SELECTION = Points().of_state(State.REAL, State.CANAL_EXPANDED, State.PROPAGATED)
VALIDATION = Points().of_state(State.REAL)


def leave_one_out(points: DataFrame, wells: Sequence[int]) -> DataFrame:
    """`points` once per fold: fold, is_val, and the columns. A fold's well validates with its real points only; all
    other wells train; fold -1 trains on all."""
    folds = F.explode(F.array(*[F.lit(int(w)) for w in [-1, *wells]]))
    out = points.where(F.col("well_id").isin(*wells)).withColumn("fold", folds)
    out = out.withColumn("is_val", F.col("fold") == F.col("well_id"))
    return out.where(~F.col("is_val") | (F.col("real") == int(State.REAL)))


def inside_area(points: DataFrame, x0: int, x1: int, y0: int, y1: int, half_open: bool = False) -> DataFrame:
    """Points of a rectangle, both ends included, or without the upper ends."""
    x, y = F.col("x"), F.col("y")
    if half_open:
        return points.where((x >= x0) & (x < x1) & (y >= y0) & (y < y1))
    return points.where(x.between(x0, x1) & y.between(y0, y1))

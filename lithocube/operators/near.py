"""Problem 4: points near other points, and regions that contain points, by a distributed dual-tree join.

The tree is a quadtree of cells in three levels over an unbounded forest of roots; a node is its cell and the bounding
box of the points in it. Pairs of nodes are compared level by level: pairs that cannot be near are dropped, pairs that
are certainly near are accepted wholesale, the rest is refined; pairs of leaves still uncertain compare their points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithocube.session import BROADCAST_ROWS, cut

#: Sides of the cells of a level, in multiples of the distance asked for.
LEVELS = (64, 8, 1)


def _gap2(kind: str) -> Column:
    """Square of the least ('near') or greatest ('far') distance between the boxes of nodes a and b."""
    parts = []
    for c in ("x", "y"):
        if kind == "near":
            d = F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"))
        else:
            d = F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"))
        parts.append(d * d)
    return parts[0] + parts[1]


def _nodes(points: DataFrame, level: int) -> DataFrame:
    """Nodes of a level: cell, its parent, bounding box of its points."""
    up = [F.first(f"c{level - 1}{c}").alias(f"p{c}") for c in "xy"] if level else []
    return points.groupBy(f"c{level}x", f"c{level}y").agg(
        *up, F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y")
    ).select(F.col(f"c{level}x").alias("cx"), F.col(f"c{level}y").alias("cy"), *(["px", "py"] if level else []), "lo_x", "hi_x", "lo_y", "hi_y")


def _side(nodes: DataFrame, s: str) -> DataFrame:
    return nodes.select([F.col(c).alias(f"{s}_{c}") for c in nodes.columns])


NODE = ("cx", "cy", "lo_x", "hi_x", "lo_y", "hi_y")


def near_pairs(points: DataFrame, distance: float, key: str = "well_id", x: str = "x_coord", y: str = "y_coord") -> DataFrame:
    """a_id < b_id of every two keys with points at a straight-line distance of at most `distance`, each pair once.

    - Points with a null or NaN coordinate, a negative one, or a null key are near nothing.
    - A key with several points is near another if any two of their points are; repeated rows count once; a key is
      never near itself. Points on one spot are near each other. Empty tables give empty results; other columns and
      their names do not matter. `distance` must be above 0.
    Every node pair met is within one cell of its partner, so work is in proportion to nodes and to results; a crowded
    spot is one leaf whose pairs are accepted wholesale and spread by the join that writes them out.
    """
    if not distance > 0:
        raise ValueError("distance must be above 0")
    p = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.where("id is not null and x >= 0 and y >= 0 and x < 1e15 and y < 1e15").distinct()
    for level, times in enumerate(LEVELS):
        p = p.withColumns({f"c{level}{c}": F.floor(F.col(c) / (distance * times)) for c in "xy"})
    p = cut(p)
    limit = float(distance) ** 2
    sure, open_pairs = [], None
    for level in range(len(LEVELS)):
        nodes = _nodes(p, level)
        if open_pairs is None:
            # Roots: each with itself and with its neighbours, every pair once.
            shifts = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
            spread = _side(nodes, "a").withColumn("d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in shifts])))
            b = _side(nodes, "b")
            pairs = spread.join(b, (F.col("a_cx") + F.col("d.i") == F.col("b_cx")) & (F.col("a_cy") + F.col("d.j") == F.col("b_cy"))).drop("d")
        else:
            a, b = _side(nodes, "a"), _side(nodes, "b")
            up = open_pairs.select(*[F.col(f"{s}_{c}").alias(f"u{s}{c}") for s in "ab" for c in ("cx", "cy")])
            pairs = up.join(a, (F.col("uacx") == F.col("a_px")) & (F.col("uacy") == F.col("a_py"))).join(
                b, (F.col("ubcx") == F.col("b_px")) & (F.col("ubcy") == F.col("b_py"))
            )
            # Children of one node meet twice: keep one order.
            own = (F.col("uacx") == F.col("ubcx")) & (F.col("uacy") == F.col("ubcy"))
            pairs = pairs.where(~own | (F.struct("a_cx", "a_cy") <= F.struct("b_cx", "b_cy")))
        pairs = pairs.select(*[f"{s}_{c}" for s in "ab" for c in NODE]).where(_gap2("near") <= limit)
        pairs = cut(pairs.withColumn("sure", _gap2("far") <= limit))
        sure.append((level, pairs.where("sure")))
        open_pairs = pairs.where("not sure")
    out = []
    for level, found in [*sure, (len(LEVELS) - 1, open_pairs)]:
        cell = [f"c{level}x", f"c{level}y"]
        a = p.select(*[F.col(c).alias(f"m{c}") for c in cell], F.col("id").alias("ia"), F.col("x").alias("xa"), F.col("y").alias("ya"))
        b = p.select(*[F.col(c).alias(f"n{c}") for c in cell], F.col("id").alias("ib"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        cells = found.select("a_cx", "a_cy", "b_cx", "b_cy")
        both = cells.join(a, (F.col("a_cx") == F.col(f"m{cell[0]}")) & (F.col("a_cy") == F.col(f"m{cell[1]}"))).join(
            b, (F.col("b_cx") == F.col(f"n{cell[0]}")) & (F.col("b_cy") == F.col(f"n{cell[1]}"))
        )
        if found is open_pairs:
            both = both.where((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2 <= limit)
        out.append(both.where("ia <> ib").select(F.least("ia", "ib").alias("a_id"), F.greatest("ia", "ib").alias("b_id")))
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found.distinct()


def near_spots(points: DataFrame, distance: float, key: str = "well_id", x: str = "x_coord", y: str = "y_coord") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): near_pairs with every spot once, however many keys lie on it.

    pairs: a_x, a_y, b_x, b_y of every two different spots at most `distance` apart, (a_x, a_y) < (b_x, b_y); members:
    `key`, x, y of every key with a known place, once per spot. Keys are near each other if they share a spot or their
    spots are a pair, so n keys on one spot are n rows, not n squared. Unknown places and empty tables as in near_pairs.
    """
    members = points.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    members = cut(members.where(F.col(key).isNotNull()).where("x >= 0 and y >= 0 and x < 1e15 and y < 1e15").distinct())
    spots = members.select(F.struct("x", "y").alias("spot"), "x", "y").distinct()
    pairs = near_pairs(spots, distance, "spot", "x", "y")
    return pairs.select("a_id.x", "a_id.y", "b_id.x", "b_id.y").toDF("a_x", "a_y", "b_x", "b_y"), members


def inside_pairs(
    points: DataFrame, regions: DataFrame, root: float = 4096.0, leaf: float = 256.0, key: str = "well_id", x: str = "x_coord", y: str = "y_coord",
    region: str = "area_id", bounds: tuple[str, str, str, str] = ("min_x", "max_x", "min_y", "max_y"),
) -> DataFrame:
    """region id (a_id) and point key (b_id) of every point in a rectangle, rims included, each pair once.

    The same comparison of nodes, with rectangles as the other side: a root cell meets the rectangles that reach into
    it; nodes outside are dropped, nodes wholly inside are accepted with all their points, the rest is refined.
    - Interchanged bounds are read in the right order; a region with a null bound or id contains nothing.
    - Points with a null, NaN or negative coordinate or a null key are in nothing. Repeated rows count once.
    """
    p = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.where("id is not null and x >= 0 and y >= 0 and x < 1e15 and y < 1e15").distinct()
    for level, side in enumerate((root, leaf)):
        p = p.withColumns({f"c{level}{c}": F.floor(F.col(c) / side) for c in "xy"})
    p = cut(p)
    lo_x, hi_x, lo_y, hi_y = [F.col(b).cast("double") for b in bounds]
    whole = F.col(region).isNotNull() & lo_x.isNotNull() & hi_x.isNotNull() & lo_y.isNotNull() & hi_y.isNotNull()
    r = regions.where(whole).select(
        F.col(region).alias("rid"), F.least(lo_x, hi_x).alias("r_lo_x"), F.greatest(lo_x, hi_x).alias("r_hi_x"),
        F.least(lo_y, hi_y).alias("r_lo_y"), F.greatest(lo_y, hi_y).alias("r_hi_y"),
    ).where("r_hi_x >= 0 and r_hi_y >= 0").distinct()
    # Rectangles meet the columns of roots that hold a point, so far-off points and wide rectangles cost nothing between.
    roots = cut(_nodes(p, 0))
    columns = roots.select(F.col("cx").alias("gx")).distinct()
    first, last = F.floor(F.greatest(F.lit(0.0), F.col("r_lo_x")) / root), F.floor(F.col("r_hi_x") / root)
    if columns.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cover = r.join(F.broadcast(columns), F.col("gx").between(first, last))
    else:
        extent = roots.agg(F.max("cx").alias("mx"))
        cover = r.join(F.broadcast(extent)).where(first <= F.col("mx")).withColumn("gx", F.explode(F.sequence(first, F.least(last, F.col("mx"))))).drop("mx")  # one row
    apart = (F.col("lo_x") > F.col("r_hi_x")) | (F.col("hi_x") < F.col("r_lo_x")) | (F.col("lo_y") > F.col("r_hi_y")) | (F.col("hi_y") < F.col("r_lo_y"))
    within = (F.col("lo_x") >= F.col("r_lo_x")) & (F.col("hi_x") <= F.col("r_hi_x")) & (F.col("lo_y") >= F.col("r_lo_y")) & (F.col("hi_y") <= F.col("r_hi_y"))
    rect = ["rid", "r_lo_x", "r_hi_x", "r_lo_y", "r_hi_y"]
    top = roots.join(cover, F.col("cx") == F.col("gx")).where(~apart)
    top = cut(top.select("cx", "cy", *rect, within.alias("sure")))
    low = _nodes(p, 1).join(top.where("not sure").withColumnsRenamed({"cx": "ux", "cy": "uy"}), (F.col("px") == F.col("ux")) & (F.col("py") == F.col("uy")))
    low = cut(low.where(~apart).select("cx", "cy", *rect, within.alias("sure")))
    at = lambda level: [F.col(f"c{level}x").alias("kx"), F.col(f"c{level}y").alias("ky"), "id", "x", "y"]
    meet = (F.col("cx") == F.col("kx")) & (F.col("cy") == F.col("ky"))
    exact = F.col("x").between(F.col("r_lo_x"), F.col("r_hi_x")) & F.col("y").between(F.col("r_lo_y"), F.col("r_hi_y"))
    found = top.where("sure").join(p.select(*at(0)), meet).select("rid", "id")
    found = found.unionAll(low.join(p.select(*at(1)), meet).where(F.col("sure") | exact).select("rid", "id"))
    return found.select(F.col("rid").alias("a_id"), F.col("id").alias("b_id")).distinct()

"""Problem 5: splits that keep related records together, over a persisted table of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithocube.session import cut, settings, small

#: Components above this share of all records are placed one by one on the driver (there are at most 1 / ALONE of
#: them); the others are placed by hash, along a histogram of so many buckets.
ALONE, BUCKETS = 1e-3, 4096


def _spot(x: str, y: str) -> list[Column]:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    return [F.when(ok, F.round(F.col(c).cast("double")).cast("long")).alias(s) for c, s in ((x, "sx"), (y, "sy"))]


def _placed(points: DataFrame) -> DataFrame:
    return points.select("point_id", *_spot("x", "y")).where("point_id is not null and sx is not null").distinct()


def component_table(points: DataFrame, wells: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """sx, sy, component, n_points, split: the spots of all points, those of linked spots with one component.

    Points (point_id, x, y) on one spot, x and y rounded to whole units, are linked; so are the spots of wells
    (x_coord, y_coord) with one test_area, and so all spots of one point_id. Links chain, also over spots of wells
    on which no point lies. A component is named by its smallest point_id.
    `existing` is the table as persisted before: its components stay together, keep their split, and grow or merge by
    the new links; `split` lists the splits that the merged components had (empty: new; two: a conflict).
    Labels are merged by pointer jumping: each round takes the smallest label over every link and then the label's own
    label, so a chain is halved each time; labels are written out every round.
    - Points none of whose rows has both coordinates are on no spot: each is a component of its own, in a row with sx
      and sy null; once such a point gets a place, its split goes with it. Null point_ids are nothing.
    - Wells with an unknown coordinate (null, negative or beyond 2**31) or a null or NaN test_area link nothing; spots
      without points are in no row. Repeated rows count once. point_ids are below 2**62.
    """
    none = F.array().cast("array<string>")
    p = cut(_placed(points))
    spots = p.groupBy("sx", "sy").agg(F.min("point_id").alias("first"), F.count(F.lit(1)).alias("n_points"))
    lone = points.where("point_id is not null").select("point_id").distinct().join(p.select("point_id"), "point_id", "left_anti")
    lone = lone.select("point_id", none.alias("split"))
    if existing is not None:
        was_lone = existing.where("sx is null").select(F.col("component").alias("point_id"), "split")
        came = p.join(was_lone, "point_id").groupBy("sx", "sy").agg(F.flatten(F.collect_set("split")).alias("brought"))
        old = existing.where("sx is not null").select("sx", "sy", F.col("component").alias("old"), F.col("n_points").alias("n_old"), "split")
        spots = spots.join(old, ["sx", "sy"], "full").join(came, ["sx", "sy"], "left")
        spots = spots.withColumn("n_points", F.greatest(F.coalesce("n_points", F.lit(0)), F.coalesce("n_old", F.lit(0))))
        spots = spots.withColumn("first", F.least("first", "old")).withColumn("split", F.array_distinct(F.concat(F.coalesce("split", none), F.coalesce("brought", none))))
        spots = spots.drop("n_old", "brought")
        lone = lone.join(was_lone.select("point_id"), "point_id", "left_anti").unionByName(was_lone.join(p.select("point_id"), "point_id", "left_anti"))
    else:
        spots = spots.withColumn("old", F.lit(None).cast("long")).withColumn("split", none)
    spots = cut(spots)

    # Nodes: spots with points by their first point (spots of one first point are one node), empty spots above all points.
    known = "x_coord >= 0 and y_coord >= 0 and x_coord < 2147483648 and y_coord < 2147483648 and test_area is not null and not isnan(test_area)"
    w = wells.where(known).select(*_spot("x_coord", "y_coord"), F.col("test_area").cast("double").cast("string").alias("link")).distinct()
    empty = F.lit(1 << 62) + F.shiftleft("sx", 31) + F.col("sy")
    links = w.join(spots.select("sx", "sy", "first"), ["sx", "sy"], "left").select(F.coalesce("first", empty).alias("node"), F.concat(F.lit("a"), "link").alias("link"))
    wide = p.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("point_id")
    wide = p.join(wide, "point_id").join(spots.select("sx", "sy", "first"), ["sx", "sy"])
    links = links.unionAll(wide.select("first", F.concat(F.lit("p"), F.col("point_id").cast("string"))))
    if existing is not None:
        links = links.unionAll(spots.where("old is not null").select("first", F.concat(F.lit("c"), F.col("old").cast("string"))))
    links = cut(links.distinct())
    label = cut(links.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        least = links.join(label, "node").groupBy("link").agg(F.min("label").alias("least"))
        hooked = links.join(least, "link").groupBy("node").agg(F.min("least").alias("to"))
        hooked = cut(hooked.join(label, "node").select("node", F.least("to", "label").alias("to"), "label"))
        up = hooked.select(F.col("node").alias("of"), F.col("to").alias("jump"))
        jumped = hooked.join(up, F.col("to") == F.col("of"), "left").select("node", F.least("to", F.coalesce("jump", "to")).alias("new"), "label")
        jumped = cut(jumped)
        changed = not jumped.where("new <> label").isEmpty()
        label = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            break
    named = spots.join(label, F.col("first") == F.col("node"), "left").withColumn("component", F.coalesce("label", "first"))
    splits = named.groupBy("component").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("split")))).alias("splits"))
    placed = named.join(splits, "component").select("sx", "sy", "component", "n_points", F.col("splits").alias("split"))
    nowhere = F.lit(None).cast("long")
    return placed.unionAll(lone.select(nowhere, nowhere, "point_id", F.lit(1).cast("long"), "split"))


def assign_splits(table: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """component, n_points, split, state of every component of `table` (see component_table).

    state 'kept': the one split that the component had before; 'new': placed where records are lacking; 'quarantined':
    components of different splits have been linked, split is null. Targets: split_name, target_share; shares are
    scaled to 1, null or negative ones are 0. Large components go one by one, largest first, to the split that lacks
    most; the others fill the splits along a hash histogram, so each is right to about 1/4096 of the rest.
    """
    wanted = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").alias("s"))
    shares = {r[0]: r[1] for r in sorted(settings(wanted))}
    c = cut(table.groupBy("component").agg(F.sum("n_points").alias("n_points"), F.first("split").alias("splits")))
    state = F.when(F.size("splits") > 1, "quarantined").when(F.size("splits") == 1, "kept").otherwise("new")
    c = c.withColumn("state", state)
    total = c.where("state <> 'quarantined'").agg(F.sum("n_points")).first()[0] or 0
    whole = sum(shares.values()) or 1.0
    lack = {k: v / whole * total for k, v in shares.items()}
    for split, n in c.where("state = 'kept'").groupBy(F.element_at("splits", 1)).agg(F.sum("n_points")).where(F.element_at("splits", 1).isin(*shares) if shares else F.lit(False)).collect():
        lack[split] -= n
    fresh = c.where("state = 'new'")
    alone = fresh.where(F.col("n_points") > ALONE * total)
    placed = []
    for r in alone.orderBy(F.desc("n_points"), "component").select("component", "n_points").collect() if shares else []:
        to = max(lack, key=lambda k: (lack[k], k))
        lack[to] -= r[1]
        placed.append((r[0], to))
    spark = table.sparkSession
    single = spark.createDataFrame(placed, "component long, chosen string")
    # The rest: buckets of the hash in order fill one split after the other, in proportion to what each lacks.
    h = F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(BUCKETS)).cast("int")
    rest = fresh.where(F.col("n_points") <= ALONE * total)
    weights = {r[0]: r[1] for r in rest.groupBy(h.alias("h")).agg(F.sum("n_points")).collect()}
    open_ = {k: max(v, 0.0) for k, v in lack.items()}
    scale = sum(weights.values()) / (sum(open_.values()) or 1.0)
    ends, at = [], 0.0
    for k in sorted(open_):
        at += open_[k] * scale
        ends.append((at, k))
    bounds, done, i = [], 0.0, 0
    for b in range(BUCKETS):
        n = weights.get(b, 0)
        while i < len(ends) - 1 and done + n / 2 > ends[i][0]:
            bounds.append((b, ends[i][1]))
            i += 1
        done += n
    chosen = F.lit(ends[-1][1] if ends else None).cast("string")
    for b, k in reversed(bounds):
        chosen = F.when(h < b, k).otherwise(chosen)
    rest = rest.withColumn("split", chosen)
    out = ["component", "n_points", "split", "state"]
    kept = c.where("state <> 'new'").withColumn("split", F.when(F.col("state") == "kept", F.element_at("splits", 1)))
    large = alone.join(small(single), "component", "left").withColumn("split", F.col("chosen"))
    return kept.select(*out).unionAll(large.select(*out)).unionAll(rest.select(*out))


def point_groups(points: DataFrame, table: DataFrame) -> DataFrame:
    """group_id, point_id: each point with the smallest point_id of its linked group; points on no spot are left out."""
    return _placed(points).join(table.select("sx", "sy", "component"), ["sx", "sy"]).select(F.col("component").alias("group_id"), "point_id").distinct()


def split_points(points: DataFrame, wells: DataFrame, targets: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(point_id, component, split, state) of every point, and the table of components to persist for the next call.

    Points on no spot are components of their own and are placed by what the splits lack, as others are. A persisted
    table holds the split of each of its spots as a list of one; quarantined components keep the list of two.
    """
    table = cut(component_table(points, wells, existing))
    splits = cut(assign_splits(table, targets))
    keep = F.when(F.col("s") == "quarantined", F.col("old")).otherwise(F.array_compact(F.array("new")))
    named = table.withColumnRenamed("split", "old").join(splits.select("component", F.col("split").alias("new"), F.col("state").alias("s")), "component")
    persist = cut(named.select("sx", "sy", "component", "n_points", keep.alias("split")))
    linked = point_groups(points, table)
    alone = points.where("point_id is not null").select("point_id").distinct().join(table.where("sx is null").select(F.col("component").alias("point_id")), "point_id", "left_semi")
    linked = linked.unionAll(alone.select(F.col("point_id").alias("group_id"), "point_id"))
    return linked.join(splits, F.col("group_id") == F.col("component")).select("point_id", "component", "split", "state"), persist

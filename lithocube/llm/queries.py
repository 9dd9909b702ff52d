"""Queries of the problems on training texts and splits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithocube.llm.lookalikes import look_alike_groups, look_alike_pairs, one_form
from lithocube.llm.mixing import mix_sources
from lithocube.llm.packing import fill_report, pack_documents
from lithocube.llm.splits import component_table, point_groups, split_points
from lithocube.plans.registry import query
from lithocube.session import cut, read


_GROUPS = """p AS (SELECT DISTINCT point_id, CAST(round(x) AS BIGINT) AS sx, CAST(round(y) AS BIGINT) AS sy FROM por_test
         WHERE point_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
      w AS (SELECT DISTINCT CAST(x_coord AS BIGINT) AS sx, CAST(y_coord AS BIGINT) AS sy, test_area FROM wells_info_completed
         WHERE x_coord >= 0 AND y_coord >= 0 AND test_area IS NOT NULL AND NOT isnan(test_area)),
      spots AS (SELECT sx, sy FROM p UNION SELECT sx, sy FROM w),
      stars AS (SELECT test_area, min((sx, sy)) AS least FROM w GROUP BY test_area),
      many AS (SELECT point_id, min((sx, sy)) AS least FROM p GROUP BY point_id HAVING count(*) > 1),
      edges AS (SELECT DISTINCT (sx, sy) AS a, least AS b FROM w JOIN stars USING (test_area) UNION SELECT (sx, sy), least FROM p JOIN many USING (point_id)),
      both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
      reach AS (SELECT (sx, sy) AS a, (sx, sy) AS b FROM spots UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
      named AS (SELECT a AS spot, min(point_id) AS group_id FROM reach JOIN p ON (p.sx, p.sy) = b GROUP BY a),
      linked AS (SELECT DISTINCT group_id, point_id FROM p JOIN named ON spot = (sx, sy)),
      everyone AS (SELECT group_id, point_id FROM linked UNION
         SELECT point_id, point_id FROM por_test WHERE point_id IS NOT NULL AND point_id NOT IN (SELECT point_id FROM p))"""


@query("p5_found", f"WITH RECURSIVE {_GROUPS} SELECT group_id, point_id FROM linked WHERE group_id <> point_id")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "por_test")
    return point_groups(points, component_table(points, read(spark, d, "wells_info_completed"))).where("group_id <> point_id")


@query("p5_splits")
def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return split_points(read(spark, d, "por_test"), read(spark, d, "wells_info_completed"), read(spark, d, "split_targets"))[0]


@query("p5_components", f"WITH RECURSIVE {_GROUPS} SELECT group_id AS component, count(*) AS points, 1 AS splits, 'new' AS state FROM everyone GROUP BY group_id")
def p5_components(spark: SparkSession, d: str) -> DataFrame:
    """Every component with its points and the number of splits that they are in."""
    s = p5_splits(spark, d)
    return s.groupBy("component").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("split").cast("int").alias("splits"), F.max("state").alias("state"))


@query("p5_shares", """SELECT split_name, true AS near_target FROM split_targets WHERE target_share > 0""")
def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Whether each split holds its share of all points to within the largest component or a hundredth."""
    s = cut(p5_splits(spark, d))
    most = s.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    have = s.groupBy(F.col("split").alias("split_name")).agg(F.count(F.lit(1)).alias("have"))
    t = read(spark, d, "split_targets").where("target_share > 0").join(have, "split_name", "left").crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("total")))).crossJoin(F.broadcast(most))
    whole = F.sum("target_share").over(Window.partitionBy())
    t = t.withColumn("want", F.col("target_share") / whole * F.col("total"))
    return t.select("split_name", (F.abs(F.coalesce("have", F.lit(0)) - F.col("want")) <= F.greatest(F.col("most"), F.col("total") * 0.01)).alias("near_target"))


@query("p5_again", f"WITH RECURSIVE {_GROUPS} SELECT group_id AS component, point_id, true AS same_split, 'kept' AS state FROM everyone")
def p5_again(spark: SparkSession, d: str) -> DataFrame:
    """A second call over the persisted components: every point keeps its component and split."""
    points, wells, targets = read(spark, d, "por_test"), read(spark, d, "wells_info_completed"), read(spark, d, "split_targets")
    first, table = split_points(points, wells, targets)
    second, _ = split_points(points, wells, targets, table)
    was = first.select("point_id", F.col("split").alias("was"))
    return second.join(was, "point_id").select("component", "point_id", (F.col("split") == F.col("was")).alias("same_split"), "state")


@query("p7_packed")
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(read(spark, d, "documents"), read(spark, d, "pack_sizes"))


@query("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_packed(spark, d), read(spark, d, "pack_sizes"))


@query(
    "p7_rules",
    """SELECT pack_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, 0 AS over_capacity, 0 AS cut_without_need, 0 AS broken, true AS little_room_left
    FROM pack_sizes WHERE pack_id IS NOT NULL AND capacity_tokens >= 1""",
)
def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every capacity: all documents in, none twice, no container too full, no needless cut, over 97 % of the room used."""
    packs = read(spark, d, "pack_sizes")
    p = cut(p7_packed(spark, d))
    loads = p.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("n")).join(packs, "pack_id")
    loads = loads.groupBy("pack_id").agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("int")).cast("int").alias("over_capacity"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("containers"))
    docs = p.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("first_token").alias("last"), F.min(F.struct("first_token", "n_tokens")).alias("head"), F.max(F.struct("first_token", "n_tokens")).alias("tail"))
    docs = docs.join(packs, "pack_id")
    broken = (F.col("head.first_token") != 0) | (F.col("tail.first_token") + F.col("tail.n_tokens") != F.col("n")) | (F.col("pieces") != F.ceil(F.col("n") / F.col("capacity_tokens")))
    docs = docs.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).cast("int")).cast("int").alias("cut_without_need"),
        F.sum(broken.cast("int")).cast("int").alias("broken"),
    )
    full = F.col("tokens") / F.col("capacity_tokens")
    both = docs.join(loads, "pack_id").join(packs, "pack_id")
    return both.select("pack_id", "documents", "over_capacity", "cut_without_need", "broken", ((full / F.col("containers") > 0.97) | (F.col("containers") - full < 4)).alias("little_room_left"))


@query("p8_mixture")
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "source_targets"))[0]


@query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "source_targets"))[1]


@query(
    "p8_rules",
    """WITH t AS (SELECT source, max(target_share) AS share, max(max_repeats) AS r FROM source_targets WHERE source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND max_repeats >= 1 GROUP BY source),
      s AS (SELECT source, count(*) AS documents FROM documents WHERE text <> '' AND source IS NOT NULL GROUP BY source)
    SELECT source, round(share / sum(share) OVER (), 9) AS share, true AS repeats_kept, true AS even, true AS share_reached FROM t JOIN s USING (source)""",
)
def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the mixture: no document above the cap, uses of two documents apart by one at most, the share to within half a document."""
    mixed, report = mix_sources(read(spark, d, "documents"), read(spark, d, "source_targets"))
    by = mixed.groupBy("source").agg(F.max("uses").alias("most"), F.min("uses").alias("least"))
    # A source whose budget is below half of its first document may come out unused: that too is within half a document.
    r = report.where("share is not null").join(by, "source", "left").crossJoin(F.broadcast(report.agg(F.sum("tokens_used").alias("size"))))
    asked = F.sum(F.col("longest")).over(Window.partitionBy()) / 2
    # Every source misses its budget by half its longest document at most, and the size is missed by the sum of those.
    near = F.abs(F.col("share_reached") - F.col("share")) * F.col("size") <= F.col("longest") / 2 + F.col("share") * asked + 1
    return r.select("source", F.round("share", 9).alias("share"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("repeats_kept"), F.coalesce(F.col("most") - F.col("least") <= 1, F.lit(True)).alias("even"), near.alias("share_reached"))


def _print_sql() -> str:
    """What a text prints, character by character, from Unicode's names and NFKC: written apart from the operator's own tables."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    letters = {}
    for script, names in (
        ("CYRILLIC", {"A": "a", "VE": "B", "IE": "e", "KA": "K", "EM": "M", "EN": "H", "O": "o", "ER": "p", "ES": "c", "TE": "T", "U": "y", "HA": "x", "DZE": "s", "BYELORUSSIAN-UKRAINIAN I": "i", "JE": "j", "SHHA": "h"}),
        ("GREEK", {"ALPHA": "A", "BETA": "B", "EPSILON": "E", "ZETA": "Z", "ETA": "H", "IOTA": "I", "KAPPA": "K", "MU": "M", "NU": "N", "OMICRON": "o", "RHO": "P", "TAU": "T", "UPSILON": "Y", "CHI": "X"}),
    ):
        for name, to in names.items():
            for case, as_ in (("CAPITAL", to.upper()), ("SMALL", to)):
                # Small letters print alike only where the Latin one is written small here.
                if case == "CAPITAL" or to.islower():
                    letters[unicodedata.lookup(f"{script} {case} LETTER {name}")] = as_
    letters.pop("\u04ba", None)  # the capital does not look like H
    table = {}
    for i in (*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2070), *range(0x2150, 0x2190), 0x3000, *range(0xFB00, 0xFB07), *range(0xFE00, 0xFE10), *range(0xFEFF, 0xFF5F)):
        c = chr(i)
        kind = unicodedata.decomposition(c).split(" ")[0]
        base, *accents = unicodedata.normalize("NFD", c)
        if kind in ("<wide>", "<compat>", "<noBreak>") and (unicodedata.category(c) in ("Zs", "Nl", "Pd", "Ll", "Lu") or kind == "<wide>" or c == "\u2026"):
            to = unicodedata.normalize("NFKC", c)
            table[c] = "-" if to == "\u2010" else to
        elif unicodedata.category(c) == "Cf" or 0xFE00 <= i < 0xFE10:
            table[c] = ""
        elif base in letters:
            table[c] = unicodedata.normalize("NFC", letters[base] + "".join(accents))
    table |= letters | {"\u2010": "-", "\u2011": "-", "\u00a0": " ", "\u202f": " ", "\u2007": " ", "\u3000": " "}
    table = {c: to for c, to in table.items() if unicodedata.category(c) != "Zs" or to == " "}
    rows = ", ".join(f"({ord(c)}, {quote(to)})" for c, to in sorted(table.items()))
    return f"""looks(point, prints) AS (VALUES {rows}),
      texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
      different AS (SELECT doc_id, text FROM texts WHERE regexp_matches(text, '[^\\x00-\\x7f]')),
      points AS (SELECT doc_id, regexp_extract_all(nfc_normalize(text), '(?s).') AS s FROM different),
      letters AS (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM points),
      printed AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(prints, l), '' ORDER BY i)) AS form FROM letters LEFT JOIN looks ON unicode(l) = point GROUP BY doc_id),
      forms AS (SELECT doc_id, text, coalesce(form, text) AS form FROM texts LEFT JOIN printed USING (doc_id))"""


@query(
    "p9_found",
    f"""WITH {_print_sql()} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b USING (form)
    WHERE a.doc_id < b.doc_id AND a.text <> b.text AND trim(form) <> ''""",
)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(read(spark, d, "documents"))


@query(
    "p9_classes",
    f"""WITH {_print_sql()}, variants AS (SELECT form, text, min(doc_id) AS variant_id FROM forms WHERE trim(form) <> '' GROUP BY ALL),
      many AS (SELECT form, min(variant_id) AS class_id FROM variants GROUP BY form HAVING count(*) > 1)
    SELECT class_id, doc_id, variant_id FROM forms JOIN variants USING (form, text) JOIN many USING (form)""",
)
def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_groups(read(spark, d, "documents"))


@query("p9_form", f"WITH {_print_sql()} SELECT d.doc_id, CASE WHEN text = '' THEN '' ELSE form END AS form FROM documents d LEFT JOIN (SELECT doc_id, form FROM forms) USING (doc_id)")
def p9_form(spark: SparkSession, d: str) -> DataFrame:
    return one_form(read(spark, d, "documents")).select("doc_id", "form")

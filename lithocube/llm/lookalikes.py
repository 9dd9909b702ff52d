"""Problem 9: text that looks the same in different characters, brought to one form by DuckDB inside Arrow partitions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that DuckDB works on at a time, so that long ones do not fill a worker's memory.
SLICE = 1_000

# Look-alike letters of other alphabets and the Latin letters printed the same, those met often first.
CYRILLIC = "АВЕКМНОРСТУХЅІЈҮԌԚԜаеорсухѕіјһԁԛԝӏҽёЁїЇѐЀӓӒӧӦӱӰ"
CYRILLIC_AS = "ABEKMHOPCTYXSIJYGQWaeopcyxsijhdqwleëËïÏèÈäÄöÖÿŸ"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϹϳάόΆΈΉΊΌΎΪΫ"
GREEK_AS = "ABEZHIKMNOPTYXocCjáóÁÉHÍÓÝÏŸ"
RARE = "ӀνɑɡıոօսհցզյՕՍՏᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴᴄᴏᴠᴡᴢꜱǃ։"
RARE_AS = "IvaginouhgqjOUSDRTAJEWMHGZRWSVSLCPKBBPDTGKJCZFMNLSRVHWXYAEIOUcovwzs!:"
# Hyphens and minus signs printed alike.
OTHER = "\u2010\u2011\u2212\ufe63\uff0d"
OTHER_AS = "-----"
# Blanks of other widths or that do not break.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters that print nothing though they are not of category Cf, and the signs of category Cf that do print.
BARE, SEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0", "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"
# Ligatures and Roman numerals that print as the letters they are made of.
JOINED = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "Ǉ": "LJ", "Ǌ": "NJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj",
    "Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅴ": "V", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅹ": "X", "Ⅺ": "XI", "Ⅻ": "XII", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M",
    "ⅰ": "i", "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅴ": "v", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅹ": "x", "ⅺ": "xi", "ⅻ": "xii", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "…": "...", "‥": "..", "‼": "!!", "⁇": "??", "⁈": "?!", "⁉": "!?", "″": "′′", "‴": "′′′",
}
#: Kinds of compatibility forms that print as the plain character: other widths, fonts, positions in a word, small forms.
KINDS = ("<wide>", "<narrow>", "<font>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Planes and blocks with such forms.
FORMS = ((0x2100, 0x2150), (0x3131, 0x318F), (0xFB20, 0xFB2A), (0xFB50, 0xFE00), (0xFE50, 0xFFF0), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1FBF0, 0x1FBFA))


def compatibility() -> tuple[str, str]:
    """Characters that are another one in a compatibility form, and that one, by Unicode's own decompositions."""
    this, that = [], []
    for first, last in FORMS:
        for c in map(chr, range(first, last)):
            kind, *parts = unicodedata.decomposition(c).split() or [""]
            if kind in KINDS and len(parts) == 1 and c not in OTHER + BARE and not 0x21 <= ord(c) - 0xFEE0 <= 0x7E:
                this.append(c)
                that.append(chr(int(parts[0], 16)))
    return "".join(this), "".join(that)


def _invisible() -> str:
    """Characters that print nothing: category Cf, variation selectors, tags, and BARE."""
    plain = {c for c in map(chr, (*range(0xAD, 0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080))) if unicodedata.category(c) == "Cf"}
    return "".join(sorted(plain - set(SEEN) | set(BARE) | set(map(chr, range(0xFE00, 0xFE10)))))


INVISIBLE = _invisible()


def ranges(characters: str) -> str:
    """Sorted characters as ranges of a regular expression's class."""
    out: list[list[int]] = []
    for i in map(ord, characters):
        if out and i == out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def form_sql(column: str = "text") -> str:
    """DuckDB expression for the one form of `column`.

    Full-width forms, blanks and look-alike letters are translated one to one; characters that print nothing are
    removed; joined forms are spelt out; combining accents are composed, before (so a composed Cyrillic letter is
    known) and after the translation (so an accent over a look-alike meets its Latin letter). Compatibility forms of
    other widths, fonts and positions and letters of rarer alphabets follow by tables of their own, which only texts
    that hold one go through. Case, accents, raised figures and everything else that shows in print stay.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("\uff0d", "")
    narrow = "".join(map(chr, range(0x21, 0x7F))).replace("-", "")
    this, that = compatibility()
    x = f"regexp_replace(nfc_normalize({column}), {quote('[' + ranges(INVISIBLE) + ']+')}, '', 'g')"
    x = f"translate({x}, {quote(wide + CYRILLIC + GREEK + OTHER + BLANKS)}, {quote(narrow + CYRILLIC_AS + GREEK_AS + OTHER_AS + ' ' * len(BLANKS))})"
    spelt = f"translate({x}, {quote(this + RARE)}, {quote(that + RARE_AS)})"
    for one, many in JOINED.items():
        spelt = f"replace({spelt}, {quote(one)}, {quote(many)})"
    # Few texts hold a joined or rare form: the others skip these replacements.
    blocks = "".join(f"\\x{{{a:x}}}-\\x{{{b - 1:x}}}" for a, b in FORMS if a != 0xFE50) + "\\x{fe50}-\\x{feff}\\x{ff5f}-\\x{fff0}"
    some = quote("[" + blocks + "".join(JOINED) + RARE + "]")
    x = f"CASE WHEN regexp_matches({column}, {some}) THEN {spelt} ELSE {x} END"
    return f"nfc_normalize({x})"


def _normalizer(columns: list[str]):
    sql = f"SELECT {', '.join(columns)}, {form_sql('text')} AS form FROM batch"

    def run(batches):
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        for b in batches:
            kinds = pa.schema([*[pa.field(c, b.schema.field(c).type) for c in columns], pa.field("form", pa.string())])
            for at in range(0, b.num_rows, SLICE):
                con.register("batch", pa.Table.from_batches([b.slice(at, SLICE)]))
                got = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from got.cast(kinds).to_batches()

    return run


def one_form(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, text and `form`: the text in the one form in which look-alike texts are equal.

    Null text gives null; an empty text, or one of characters that print nothing, gives an empty form. Whole texts are
    worked on, of any length. Other columns are ignored. Repeated rows stay repeated.
    """
    d = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = f"key {d.schema['key'].dataType.simpleString()}, text string, form string"
    return d.mapInArrow(_normalizer(["key", "text"]), kinds).withColumnRenamed("key", key)


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `class` (hash of the one form) and `variant` (hash of the text itself), for texts that print something.

    The hashes are 128 bits long and made in the partition that made the form, so texts are never shuffled. Null and
    blank texts and null keys are in no class; repeated rows count once.
    """
    f = one_form(documents, key, text).where(f"{key} is not null and trim(form) <> ''")
    return f.select(key, F.md5("form").alias("class"), F.md5("text").alias("variant")).distinct()


def look_alike_groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """class_id, `key`, variant_id: every document of a class that is written in more than one way.

    class_id is the least key of the class, variant_id that of the documents with exactly this text, so two documents
    look alike if they share a class_id, in different characters if their variant_ids differ. One row per document,
    however large the class.
    """
    from lithocube.session import cut

    c = cut(look_alike_classes(documents, key, text))
    variants = c.groupBy("class", "variant").agg(F.min(key).alias("variant_id"))
    many = variants.groupBy("class").agg(F.min("variant_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "class_id")
    return c.join(variants.join(many, "class"), ["class", "variant"]).select("class_id", key, "variant_id")


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`<key>_a` < `<key>_b` of every two documents whose texts look the same but are different sequences of characters.

    Pairs are made between the variants of a class, so copies of one text never meet each other; members join last.
    """
    from lithocube.session import cut

    c = cut(look_alike_classes(documents, key, text))
    variants = c.groupBy("class", "variant").agg(F.min(key).alias("first"))
    many = variants.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    a = variants.join(many, "class", "left_semi").select("class", F.col("variant").alias("va"))
    b = a.select("class", F.col("va").alias("vb"))
    meet = a.join(b, "class").where("va < vb")
    left = c.select("class", F.col("variant").alias("va"), F.col(key).alias("ka"))
    right = c.select("class", F.col("variant").alias("vb"), F.col(key).alias("kb"))
    pairs = meet.join(left, ["class", "va"]).join(right, ["class", "vb"]).where("ka <> kb")
    return pairs.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()

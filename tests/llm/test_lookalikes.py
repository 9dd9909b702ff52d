import unicodedata

import pytest

pytest.importorskip("lithocube.llm")
import lithocube.llm.lookalikes as la  # noqa: E402

DOCS = "doc_id long, text string, form string, class string, key int"

SAME = [
    "Nr. 5/2031 Café Oslo II office - page",
    "Ｎｒ. ５/２０３１ Café Oslo Ⅱ office - page",
    "Nr. 5/2031 Café ​Oslo II oﬃce ‐ pa­ge",
    "Nr. 5/2031 Саfé Оѕlо ІІ оffiсе ‑ рagе",
    "Nr. 5/2031 Саfе́ Οslo ΙΙ office - page⁠",
]
OTHERS = [s.replace(a, b) for s, a, b in [(SAME[0], "é", "e"), (SAME[0], "5", "6"), (SAME[0], "2031", "203¹"), (SAME[0], "Oslo", "oslo"), (SAME[0], " - ", " – "), (SAME[0], "page", "pages"), (SAME[0], "Café", "Cafè")]]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "f", "c", 0) for i, t in enumerate(texts)], DOCS)


def test_translation_tables_fit():
    assert len(la.CYRILLIC) == len(la.CYRILLIC_AS) and len(la.GREEK) == len(la.GREEK_AS) and len(la.OTHER) == len(la.OTHER_AS)
    for text in (la.CYRILLIC, la.GREEK):
        assert len(set(text)) == len(text)
    assert all(unicodedata.category(c) in ("Zs", "Mn", "Cf", "Lo") for c in la.BLANKS + la.INVISIBLE)


def test_compatibility_forms_and_rare_letters(spark):
    pairs = [("𝐇𝐞𝐥𝐥𝐨", "Hello"), ("ｶﾞ", "ガ"), ("￥", "¥"), ("օ", "o"), ("Ꭺ", "A"), ("Ӏ", "I"), ("ν", "v"), ("ɑ", "a"), ("ı", "i"), ("ℓ", "l"), ("−", "-"),
             ("a\U000e0041b", "ab"), ("a\u180bb", "ab"), ("a\u3164b", "ab"), ("ﻼ", "ﻼ"), ("ﺍ", "ا"), ("x\u0600", "x\u0600"), ("203¹", "203¹"), ("①", "①")]
    got = {r.doc_id: r.form for r in la.one_form(frame(spark, [a for a, _ in pairs])).collect()}
    assert [got[i] for i in range(len(pairs))] == [b for _, b in pairs]
    this, that = la.compatibility()
    assert len(this) == len(that) == len(set(this)) and len(la.RARE) == len(la.RARE_AS) == len(set(la.RARE))


def test_classes_are_one_row_a_document(spark):
    d = frame(spark, [SAME[0], SAME[1], SAME[0], "alone", OTHERS[0], None])
    assert {tuple(r) for r in la.look_alike_groups(d.unionAll(d)).collect()} == {(0, 0, 0), (0, 1, 1), (0, 2, 0)}
    assert la.look_alike_groups(frame(spark, [])).count() == 0


def test_same_print_same_form(spark):
    forms = {r.doc_id: r.form for r in la.one_form(frame(spark, SAME + OTHERS)).collect()}
    assert {forms[i] for i in range(len(SAME))} == {SAME[0]}
    assert len({forms[i] for i in range(len(SAME + OTHERS))}) == 1 + len(OTHERS)


def test_pairs_are_of_different_texts_only(spark):
    texts = [*SAME, SAME[0], *OTHERS, None, "", " ", "​", None]
    pairs = {tuple(r) for r in la.look_alike_pairs(frame(spark, texts)).collect()}
    n = len(SAME)
    assert pairs == {(a, b) for b in range(n + 1) for a in range(b) if (a, b) != (0, n)}


def test_cyrillic_words_keep_their_own_letters(spark):
    words = ["суд", "cуд", "решение по делу", "ЁЛКА", "ËЛКА", "ЁЛКА"]
    f = {r.doc_id: r.form for r in la.one_form(frame(spark, words)).collect()}
    assert f[0] == f[1] and f[3] == f[4] == f[5] and "ш" in f[2]


def test_a_form_is_its_own_form(spark):
    first = la.one_form(frame(spark, SAME + OTHERS)).select("doc_id", "form").collect()
    again = {r.doc_id: r.form for r in la.one_form(frame(spark, [r.form for r in sorted(first)])).collect()}
    assert again == {r.doc_id: r.form for r in first}


def test_very_long_and_repeated_and_empty(spark):
    long = "а" * 500_000
    d = frame(spark, [long, "a" * 500_000, "b"])
    assert {tuple(r) for r in la.look_alike_pairs(d.unionAll(d)).collect()} == {(0, 1)}
    assert la.look_alike_pairs(frame(spark, [])).count() == 0 and la.one_form(frame(spark, [])).count() == 0

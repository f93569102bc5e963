import unicodedata
from collections import Counter

import pytest

from labelloom.llm import lookalikes

PLAIN = "The patient was given one tablet of space and scope. Race peer cope pace. Вот и всё. Опыт применения ограничен. naïve café déjà ½ 5%"
CASES = {
    "plain text": "plain text",
    "": "",
    "ＷＩＤＥ ２３％": "WIDE 23%",
    "ﬁrst 𝐛𝐨𝐥𝐝 Ⓐ①": "first bold A1",
    "café naïve": "café naïve",
    "a​b﻿c­d⁠": "abcd",
    "a b c　d": "a b c d",
    "tab\tand\nbreak": "tab\tand\nbreak",
    "раtient": "patient",
    "This was seen in open ѕрасе.": "This was seen in open space.",
    "саѕеѕ were seen": "cases were seen",
    "caѕеѕ were seen": "cases were seen",
    "Вот и всё, а он у неё.": "Вот и всё, а он у неё.",
    "На фоне приёма nellirelin у 31.6% больных": "На фоне приёма nellirelin у 31.6% больных",
    "the local term «сыпь».": "the local term «сыпь».",
    "an α-adrenergic effect, Δ from baseline, TNFα": "an α-adrenergic effect, Δ from baseline, TNFα",
    "cοugh and reνiew": "cough and review",
    "Ꭺ lᎪbel, Ꮪevere CᎪSES": "Ꭺ lAbel, Severe CASES",
    "ᴘatient's doɡ ɑte, tᴀblet": "patient's dog ate, tablet",
    "the sound /ɡəʊ/, [ɑː] and ɡʌp": "the sound /ɡəʊ/, [ɑː] and ɡʌp",
    "pαtients on TNFα, γGT or IFNγ": "patients on TNFα, γGT or IFNγ",
    "խoսse": "խoսse",
    "hոսse of раіո": "hnuse of pain",
    "ışık łódź straße": "ışık łódź straße",
    "клиниkа и больнuца": "клиника и больнuца",
    "‐ ‑ − ’ ‘ “ ” •": "‐ ‑ − ’ ‘ “ ” •",
    "naïve – “quoted” ‰ ≥ °C ½ m² ™ № •": "naïve – “quoted” ‰ ≥ °C ½ m² ™ № •",
    "👩‍⚕️ visit": "👩‍⚕️ visit",
    "الدواء": "الدواء",
    "ё" * 20_000: "ё" * 20_000,
}


@pytest.fixture(scope="module")
def to(spark):
    return lookalikes.Rewriter(dict(Counter(PLAIN * 50)), lookalikes.prototypes(spark))


def test_rewrite(to):
    assert {k: to.rewrite(k) for k in CASES} == CASES
    assert to.rewrite(None) is None


def test_invisible_characters_beside_signs(to):
    hidden = ["\u200b", "\u00ad", "\ufeff", "\u2060", "\u200c", "\u200d", "\U000e0041"]
    for sign in "®™©°№℃→■":
        for h in hidden:
            assert to.rewrite(f"Brand{sign}{h} tablets {h}{sign}C {sign}{h}{sign}") == f"Brand{sign} tablets {sign}C {sign}{sign}"
    for h in hidden:
        assert to.rewrite(f"a👍{h} b {h}👍 c ©\ufe0f{h}👍") == "a👍 b 👍 c ©\ufe0f👍"
    for h in hidden[:5]:
        assert to.rewrite(f"👩{h}⚕") == "👩⚕"
    flag = "🏴" + "".join(chr(0xE0000 + ord(c)) for c in "gbsct") + "\U000e007f"
    pictures = ["👩\u200d⚕\ufe0f", "👩🏽\u200d⚕\ufe0f", "🏳\ufe0f\u200d🌈", "🧔\u200d♂\ufe0f", "🙂\u200d↔\ufe0f", "👨\u200d👩\u200d👧", flag]
    assert [to.rewrite(p) for p in pictures] == pictures
    assert to.rewrite(flag[:-1] + " x") == "🏴 x"
    assert to.rewrite("👍" + "\U000e0041" * 50_000) == "👍"


def test_rewriting_again_changes_nothing(to):
    assert all(to.rewrite(v) == v for v in CASES.values())


def test_classes_are_transitive():
    classes = lookalikes.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        classes.unite(a, b)
    assert sorted(classes.all()) == [["a", "b", "c", "d"], ["x", "y"]]


def test_frequency_decides(spark):
    table = lookalikes.prototypes(spark)
    one, other = (lookalikes.Rewriter(c, table) for c in ({"'": 90, "’": 10, "-": 9, "–": 3, '"': 5, "ӏ": 1, "і": 2}, {"'": 10, "’": 90, "-": 3, "–": 9, "“": 5, "ӏ": 2, "і": 1}))
    text = "the patient’s ‘5–6’ “dose” '' it's ‐ −"
    assert one.compare(text) == "the patient's '5-6' \"dose\" \" it's - -"
    assert other.compare(text) == "the patient’s ’5–6’ “dose“ “ it’s – –"
    assert lookalikes.Rewriter({"''": 3, '"': 2}, table).compare('say "it"') == "say ''it''"
    assert (one.by_script["CYRILLIC"]["i"], other.by_script["CYRILLIC"]["i"]) == ("і", "ӏ")
    assert one.compare(None) is None and one.compare("") == ""
    for to in (one, other):
        assert to.compare(to.compare(text)) == to.compare(text)


def test_full_table_of_confusables(spark):
    """Every letter of the table with a plain counterpart of its kind is brought back inside a plain word."""
    table = lookalikes.prototypes(spark)
    to = lookalikes.Rewriter(dict(Counter("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" * 9)), table)
    latin = to.by_script["LATIN"]
    assert len(latin) > 100 and {lookalikes.script(c) for c in latin} >= {"CYRILLIC", "GREEK", "ARMENIAN", "OTHER"}
    for c, plain in latin.items():
        if plain.isascii() and unicodedata.normalize("NFKC", c) == c:
            assert to.rewrite(f"ab{c}ab is it") == f"ab{plain}ab is it", c
    assert all(to.rewrite(c) == c for c in map(chr, range(128)))


def test_unify_and_counts(spark):
    rows = [(i, t, True) for i, t in enumerate([*CASES, None, None, "ﬁ", "ﬁ"])]
    df = spark.createDataFrame(rows, "i bigint, t string, changed boolean")
    counts = lookalikes.string_counts([df.select("t")])
    assert counts == dict(Counter("".join(t or "" for _, t, _ in rows)))
    out = lookalikes.unify(df, "i", "t", dict(Counter(PLAIN * 50))).collect()
    assert len(out) == len(rows)
    got = {r.i: (r.unified, r.changed) for r in out}
    for i, t, _ in rows:
        want = CASES.get(t, "fi" if t else None)
        assert got[i] == (want, want != t)
    assert lookalikes.unify(df.limit(0), "i", "t", {}).count() == 0
    both = lookalikes.unify(df, "i", "t", dict(Counter(PLAIN * 50)), compare=True).collect()
    assert {r.i: (r.unified, r.changed) for r in both} == got and len(both) == len(rows)
    assert lookalikes.unify(df.limit(0), "i", "t", {}, compare=True).count() == 0
    assert lookalikes.string_counts([df.limit(0).select("t")]) == {}
    quotes = spark.createDataFrame([("a--b",), ("-",), ("----",), (None,)], "t string")
    assert lookalikes.string_counts([quotes], ["--", "''"]) == {"a": 1, "b": 1, "-": 7, "--": 3}

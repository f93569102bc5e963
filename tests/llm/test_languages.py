import pytest
from pyspark.sql import functions as F

from labelloom.llm import languages as L
from labelloom.session import load


def test_labels(spark):
    cases = {"en": "en", "EN_us": "en", " English (UK)": "en", "fr-CA": "fr", "Deutsch": "de", "español": "es", "por": "pt", "und": None, "": None, "  ": None, None: None, "unknown": None, "sv": "other", "RUS": "ru", "nl": "nl", "ita": "it"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r.l: r.n for r in df.withColumn("n", L.label(F.col("l"))).collect()} == cases


def test_segments():
    assert L.segments("One line\nwrapped here. Two? Three\n\n- item\n- other") == ["One line\nwrapped here.", "Two?", "Three", "- item", "- other"]
    assert L.segments(None) == [] and L.segments(" \n ") == []
    assert L.plain("Trial NF-1032 of 3.5% dramocyclan IS double-blind, COVID-19 x2y") == "trial of dramocyclan is double blind".split()


@pytest.fixture(scope="module")
def model(spark, sf):
    return L.fit(load(spark, "/root/testdata/sf0.01", "documents"), "text", "lang")


def test_held_out_accuracy(spark, sf, model):
    rows = load(spark, sf, "eval_item").collect()
    texts = [model.numbers(r.text) for r in rows]
    cosines, _ = model.cosines(L.np.concatenate(texts), L.np.cumsum([0, *map(len, texts)])[:-1])
    right = sum(L.LANGUAGES[i] == r.lang for i, r in zip(cosines.argmax(axis=1), rows, strict=True))
    assert right / len(rows) >= 0.97


def test_mixed_wrong_and_odd_documents(spark, model):
    en = "The rate of rash did not differ from placebo in patients taking a diuretic. Carers should be told that fits can follow a missed dose."
    de = "Bitte informieren Sie Ihren Arzt über alle weiteren Arzneimittel. Die meisten Fälle von Hautausschlag waren leicht."
    rows = [
        (1, en, "en-GB"), (2, en, "fr"), (3, en + " " + de, "en"), (4, de, None), (5, None, None), (6, "", "en"), (7, "637/338930 | 88 #461", None),
        (8, "The caller used the phrase “leichter Schwindel” twice. " + en, "eng"), (9, de * 200, "und"), (4, de, None), (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa\n\n" + en, "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("segment", F.lit("clash"))
    got = sorted({(r.doc_id, r.lang) for r in L.mislabelled(L.document_languages(df, "doc_id", "text", "lang", model), "doc_id").collect()})
    assert got == [(2, "en"), (3, "de"), (3, "en"), (4, "de"), (9, "de")]
    assert L.classify(df.limit(0), "doc_id", "text", "lang", model).count() == 0


def test_summary_of_segments(spark, model):
    rows = [(1, "Bitte informieren Sie Ihren Arzt. Die meisten Fälle von Hautausschlag waren leicht und gingen zurück.", "x"), (2, "12 34", None), (None, "The rate of rash did not differ from placebo.", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    by = {}
    for r in L.classify(df, "doc_id", "text", "lang", model).collect():
        assert r.segment_text in rows[0][1] + rows[1][1] + rows[2][1] and 0 <= r.confidence <= 1
        if r.lang:
            n, s = by.get((r.doc_id, r.label, r.lang), (0, 0.0))
            by[r.doc_id, r.label, r.lang] = (n + 1, round(s + r.confidence, 6))
    assert {(r.doc_id, r.label, r.lang): (r.n, round(r.sure, 6)) for r in L.document_languages(df, "doc_id", "text", "lang", model).collect()} == by


def test_what_is_remembered_changes_nothing(model, monkeypatch):
    texts = [f"The rate of rash did not differ in group {chr(97 + i % 26)}{chr(97 + i // 26)} from placebo. Die Fälle waren leicht und gingen bald zurück." for i in range(60)]
    want = L.decide_segments(model, texts)[:2]
    monkeypatch.setattr(L, "REMEMBERED", 5)
    small = L.Model(model.idf, model.centroids, model.languages)
    got = [L.decide_segments(small, [t])[:2] for t in texts]
    assert [n for g in got for n in g[0]] == want[0] and [c for g in got for c in g[1]] == pytest.approx(want[1], abs=1e-3)


def test_ends_of_segments_are_found_alike(model):
    texts = ["One. Two?! \"Three.\" four\n\nfive:\n- six; seven;\n eight 3.5 x-y\n* nine… ten", "", None, "  ", "a.b. c", "…", "\n\n", "x:\n\n\ny"]
    for t in texts:
        want = [n for s in L.segments(t) if (n := model.numbers(s))]
        got, part = [], []
        for n in [*(model.numbers(t, L.RUN_OR_END) if t else []), L.END]:
            if n == L.END:
                got += [part] if part else []
                part = []
            else:
                part.append(n)
        assert got == want, t


def test_document_frequencies(spark):
    texts = ["rash rash fever", "fever", None, "", "12", "Rash-fever x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found, n = L.document_frequencies(df, "t")
    want = L.np.zeros(L.BUCKETS, int)
    for t in texts:
        if t and L.plain(t):
            want[L.np.unique(L.features(L.plain(t))[1])] += 1
    assert n == 3 and (found == want).all()


def test_no_labelled_rows(spark):
    df = spark.createDataFrame([(1, "some text here", None)], "doc_id bigint, text string, lang string")
    empty = L.fit(df, "text", "lang")
    assert [r.lang for r in L.classify(df, "doc_id", "text", "lang", empty).collect()] == [None]

"""Scenarios of the evidence rules, each a small label text with the outcome it must have."""

import pytest
from pyspark.sql import functions as F

from labelloom.functions import numeric as N
from labelloom.functions import text as X
from labelloom.plans import extract, quality

# (text, event, drug, section code, expected fields)
B, S, H, W, AR = "bradycardia", "serotonin syndrome", "hypotension", "43685-7", "34084-4"
MENTIONS = [
    ("In the open study no events of bradycardia were ever observed with velorin.", B, "velorin", W, {"evidence_status": "negated", "assertion": "absent", "subject": "selected_drug"}),
    ("Velorin did not lead to a slow heart rate at any visit.", B, "velorin", W, {"evidence_status": "negated", "matched_term": "slow heart rate"}),
    ("Stop velorin in patients who have a slow heart rate.", B, "velorin", W, {"evidence_status": "historical_or_preexisting", "assertion": "historical", "subject": "patient_history"}),
    ("Slow heart rate came up more often with control than with velorin.", B, "velorin", W, {"evidence_status": "comparator_only", "subject": "comparator", "comparator_text": "Control (frequency not stated)"}),
    ("Concomitant quinolex may increase how deep a slow heart rate goes.", B, "velorin", W, {"evidence_status": "interaction_dependent", "assertion": "conditional", "subject": "concomitant_drug"}),
    ("A slow heart rate was seen on coadministration with quinolex.", B, "velorin", W, {"evidence_status": "interaction_dependent", "subject": "selected_drug"}),
    ("Fenotrel has precipitated serotonin syndrome in adults.", S, "fenotrel", W, {"evidence_status": "explicit_positive", "assertion": "present", "evidence_context": ["warning"]}),
    ("Fenotrel has precipitated serotonin syndrome, but the risk is increased with lithium.", S, "fenotrel", W, {"evidence_status": "explicit_positive", "assertion": "present"}),
    ("Early symptoms of serotonin syndrome are tremor and sweating.", S, "fenotrel", W, {"evidence_status": "related_but_not_explicit", "assertion": "uncertain"}),
    ("Stop at once if serotonin syndrome should emerge.", S, "fenotrel", W, {"evidence_status": "related_but_not_explicit"}),
    ("Low blood pressure (a sitting BP under 85/45 mmHg) before the first dose", H, "nerivast", W, {"evidence_status": "historical_or_preexisting", "frequency_text": None}),
    ("Known hypotension with a BP of <85/45 mmHg", H, "nerivast", W, {"evidence_status": "historical_or_preexisting", "frequency_text": None}),
    ("Hypotension 7% against placebo 4%.", H, "nerivast", W, {"frequency_text": "7%", "frequency_value": 7.0, "frequency_unit": "percent", "comparator_text": "Placebo: 4%"}),
    ("Bradycardia was recorded: 3 events per 500 patients.", B, "velorin", W, {"frequency_text": "3 events per 500 patients", "frequency_value": 3.0, "frequency_unit": "per 500 patients"}),
    ("After one 25 mg capsule a day hypotension was reported in 6.5% versus 3% with control.", H, "nerivast", W, {"frequency_text": "6.5%", "comparator_text": "Control 3%"}),
    ("Opioids may bring on hypotension.", H, "codamine", AR, {"subject": "general_class_statement", "evidence_context": ["adverse_reaction"]}),
    ("Three people had myopathy.", "rhabdomyolysis", "lovacor", AR, {"evidence_status": "related_but_not_explicit", "matched_term": "myopathy"}),
    ("Hypotension followed oral doses.", H, "Metrosan cream 2%", W, {"evidence_status": "insufficient_label_data", "assertion": "present", "subject": "unclear", "route_context": ["oral", "route_mismatch"]}),
    ("No cases of hypotension were observed with the topical cream in either study.", H, "Metrosan cream 2%", W, {"evidence_status": "negated", "frequency_text": None, "route_context": ["topical", "cream", "matching_route"]}),
    ("Hypotension is seen with inhaled use.", H, "dapirel", W, {"evidence_status": "related_but_not_explicit", "extraction_confidence": "low", "route_context": ["inhaled", "ambiguous_route"]}),
    ("Hypotension troubled pediatric patients at doses above 40 mg a day.", H, "dapirel", AR, {"population_context": ["pediatric patients"], "dose_context": ["at doses above 40 mg a day"]}),
    ("Hypotension was rarely seen.", H, "dapirel", AR, {"frequency_text": "rarely", "frequency_value": None, "frequency_unit": "qualitative"}),
    ("Hypotension and a common cold came up.", H, "dapirel", AR, {"frequency_text": None}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"s{i}", code, "WARNINGS", "paragraph", 0, text, "section[0]/paragraph[0]", drug, event) for i, (text, event, drug, code, _) in enumerate(MENTIONS)]
    df = spark.createDataFrame(rows, "set_id string, section_code string, section_title string, chunk_type string, chunk_index int, text string, source_path string, drug_name string, event string")
    df = df.withColumns({"subsection_title": F.lit(None).cast("string"), "chunk_hash": F.lit("c"), "column_headers": F.lit(None).cast("array<string>"), "row_cells": F.lit(None).cast("array<string>"), "rxcui": F.lit("1"), "drug_names": F.array("drug_name"), "product_context": F.lit(None).cast("string")})
    df = extract.parent_context(extract.searchable(df))
    out = {}
    for r in extract.items(df, [extract.event_plan(e) for e in sorted({m[1] for m in MENTIONS})]).collect():
        out.setdefault((r.set_id, r.normalized_event), []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(MENTIONS)))
def test_mention(found, i):
    text, event, _, _, expected = MENTIONS[i]
    got = found[f"s{i}", extract.event_plan(event).event][0]
    assert {k: got[k] for k in expected} == expected, text


FREQUENCIES = {
    "Headache came up in 7% of subjects.": ["7%"],
    "The rate of headache was 1.4%.": ["1.4%"],
    "Four events per 2,500 person-years were counted.": ["Four events per 2,500 person-years"],
    "Itching bothered 9 of 310 patients.": ["9 of 310 patients"],
    "Itching was observed in 18 subjects.": ["18 subjects"],
    "The lotion 4% was given to 90 patients; flaking occurred in 6%.": ["6%"],
    "Each vial holds 0.25% active ingredient. Flaking occurred in 8%.": ["8%"],
    "Adults were given 15 mg/3 mL oral suspension at night. Gagging occurred in 2%.": ["2%"],
    "zinc lotion 4%": [],
    "4% zinc lotion": [],
    "nasal spray 0.7%": [],
    "2% dextrose": [],
    "Adults were given 15 mg a day.": [],
    "n=75": [],
    "Of 480 subjects, 6 had a rash.": [],
    "A total of 1,250 subjects took part.": [],
    "The blood pressure fell to 82/44 mmHg.": [],
    "A pulse 12% below the first was noted.": [],
    "Hematocrit dropped by 12%.": [],
    "": [],
}


def test_frequencies(spark):
    df = spark.createDataFrame([(t,) for t in FREQUENCIES], "t string")
    assert {r.t: r.f for r in df.withColumn("f", F.expr(N.frequencies("t"))).collect()} == FREQUENCIES


def test_frequency_parts(spark):
    cases = {"0.75 %": (0.75, "percent"), "7 of 2,400 patients": (7.0, "of 2,400 patients"), "six events per 900 person-years": (6.0, "per 900 person-years"), "3,100 treated subjects": (3100.0, "treated subjects"), "8/250 cases": (8.0, "per 250 cases"), "8/250": (8.0, "per 250"), "Uncommon": (None, "qualitative"), "several": (None, None)}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r.t: (r.p.value, r.p.unit) for r in df.withColumn("p", F.expr(N.parts("t"))).collect()}
    assert got == cases | {None: (None, None)}


def test_table_variants(spark):
    cases = [
        (["Reaction", "Corvexil maleate (%)", "Placebo (%)"], ["Dizziness", "6.1", "2.2"], "corvexil", [("6.1%", 6.1, "Placebo 2.2%")]),
        (["Reaction", "Zolarex (%)"], ["Dizziness", "3.8"], "zolarex", [("3.8%", 3.8, None)]),
        (["Reaction", "Corvexil 5 mg (%)", "Active control (%)"], ["Dizziness", "7.5", "1.5"], "corvexil", [("7.5%", 7.5, "Active control 1.5%")]),
        (["Reaction", "Corvexil (N=90)"], ["Dizziness", "11%"], "corvexil", [("11%", 11.0, None)]),
        (["Column 1", "Column 2"], ["Dizziness", "3"], "corvexil", []),
        (["Reaction"], ["Dizziness", "3"], "corvexil", []),
        (["Reaction", "Men / Corvexil (%)", "Women / Placebo (%)", "Men / Placebo (%)"], ["Itch", "4", "8", "2"], "corvexil", [("4%", 4.0, "Placebo 2%")]),
    ]
    df = spark.createDataFrame([(i, h, c, [d]) for i, (h, c, d, _) in enumerate(cases)], "i int, h array<string>, c array<string>, n array<string>")
    got = {r.i: [(v.frequency_text, v.value, v.comparator_text) for v in r.v] for r in df.withColumn("v", F.expr(N.table_variants("h", "c", "n"))).collect()}
    assert got == {i: e for i, (_, _, _, e) in enumerate(cases)}


def test_sentences_and_clauses(spark):
    cases = {
        "Avoid St. Barbara's bark. Rest.": ["Avoid St. Barbara's bark.", "Rest."],
        "Call Prof. Lindqvist, i.e. Today. Then rest!": ["Call Prof. Lindqvist, i.e. Today.", "Then rest!"],
        "  ": [],
        "One.\n Two? three. 4 is": ["One.", "Two? three.", "4 is"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("s", F.expr(X.sentences("t")))
    assert {r.t: r.s for r in df.collect()} == cases
    one = spark.createDataFrame([("A rash; and fever ; but none;",)], "t string").select(F.expr(X.clauses("t"))).first()[0]
    assert one == ["A rash", "fever", "none;".rstrip(";")]


def test_headings_are_stripped_again_and_again(spark):
    rows = [("5 WARNINGS 5 Warnings Rash: rash occurs", "5 Warnings", "Rash"), ("Warnings", "Warnings", None), ("Ｗarnings ﬁrst", "Warnings", None), (None, None, None), ("", "", "")]
    df = extract.normalized_text(spark.createDataFrame(rows, "text string, section_title string, subsection_title string"), "n")
    assert [r.n for r in df.collect()] == ["occurs", "", "first", "", ""]


def test_parent_paragraph_of_list_items(spark):
    rows = [
        (0, "paragraph", "Velorin must not be given in these states:", "s[0]/paragraph[0]", None),
        (1, "list_item", "one", "s[0]/list[0]/item[0]", None),
        (2, "list_item", "two", "s[0]/list[0]/item[1]", None),
        (3, "list_item", "three of another list", "s[0]/list[1]/item[0]", None),
        (4, "table_row", "row", "s[0]/table[0]/row[0]", None),
        (5, "list_item", "after a table", "s[0]/list[2]/item[0]", None),
        (6, "paragraph", "Next", "s[0]/paragraph[1]", None),
        (7, "list_item", "under another heading", "s[0]/list[3]/item[0]", "Sub"),
    ]
    df = spark.createDataFrame(rows, "pos int, chunk_type string, text string, source_path string, subsection_title string").withColumns({"set_id": F.lit("a"), "section_code": F.lit("c"), "section_title": F.lit("t")})
    got = {r.pos: r.parent_context for r in extract.parent_context(df).collect()}
    assert {p: v for p, v in got.items() if v} == {1: rows[0][2], 2: rows[0][2]}


def test_documents_stay_apart(spark):
    """Two deliveries of one label: nothing is de-duplicated, ordered or introduced across them."""
    schema = "set_id string, retrieved_at string, version string, chunk_index int, chunk_type string, text string, source_path string, section_code string, section_title string, subsection_title string"
    row = lambda at, version, i, kind, text, path: ("a", at, version, i, kind, text, path, "34084-4", "T", None)
    rows = [row("1", "v2", 0, "paragraph", "Intro one", "s/paragraph[0]"), row("1", "2", 1, "list_item", "same item", "s/list[0]/item[0]"), row("2", "2", 0, "list_item", "same item", "s/list[0]/item[0]"), row("2", None, 1, "list_item", "Same, item!", "s/list[0]/item[1]")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.retrieved_at, r.pos, r.text, r.parent_context) for r in extract.parent_context(extract.searchable(df)).collect())
    assert got == [("1", 0, "Intro one", None), ("1", 1, "same item", "Intro one"), ("2", 0, "same item", None)]
    states = sorted((r.retrieved_at, r.chunk_index, r.state, r.new_index) for r in quality.checked(df).collect())
    assert states == [("1", 0, "kept", 0), ("1", 1, "kept", 1), ("2", 0, "kept", 0), ("2", 1, "duplicate", None)]
    assert sorted((r.retrieved_at, r.total_chunks, r.duplicate_chunks) for r in quality.diagnostics(df).collect()) == [("1", 2, 0), ("2", 2, 1)]


def test_any_number_of_headings(spark):
    for mark in ("h", "ĥ"):
        titles = [f"{mark}{i}" for i in range(1500)]
        df = spark.createDataFrame([(" ".join(titles) + " rest", "x", ">".join(titles))], "text string, section_title string, subsection_title string")
        assert extract.normalized_text(df, "n").first().n == "rest"


def test_event_plan():
    assert extract.event_plan(" Low blood-pressure ").event == "hypotension"
    assert extract.event_plan("QT prolongation").event == "qt prolongation"
    assert extract.event_plan("odd thing!") == extract.EventPlan("odd thing!", "odd thing", ("odd thing",), ())


def test_fold_is_the_same_in_both_ways(spark):
    texts = ["", " ", "A-b,\tC % d!", "x" * 5000 + " --- " * 2000, "".join(map(chr, range(1, 128))) * 3, "a\x00b", "ＡＢ c", "5.1 Rash\n\n(see 'x')\\", None]
    df = spark.createDataFrame([(i, t, "", None) for i, t in enumerate(texts)], "i int, text string, section_title string, subsection_title string")
    assert {r.i: r.n for r in extract.normalized_text(df, "n").collect()} == {i: X.fold_characters(t or "") for i, t in enumerate(texts)}
    plain = [t for t in texts if t and t.isascii() and "\x00" not in t]
    got = spark.createDataFrame([(t,) for t in plain], "t string").select(F.expr(X.fold("t"))).collect()
    assert [r[0] for r in got] == [X.fold_characters(t) for t in plain]

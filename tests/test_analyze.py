"""The whole path from drugs, labels and chunks to drug and class rows."""

import pytest
from pyspark.sql import functions as F

from labelloom.plans.analyze import analyze, fallback_chunks

LABELS = "rxcui string, requested_name string, selected_spl_set_id string, effective_time string, spl_effective_time string, spl_version string, label_match_confidence string, extraction_source string, generic_names array<string>, brand_names array<string>, substance_names array<string>, selected_label_product map<string,string>, sections map<string,string>"
CHUNKS = "set_id string, section_code string, section_title string, subsection_title string, chunk_type string, chunk_index int, text string, source_path string, chunk_hash string, column_headers array<string>, row_cells array<string>, loinc_display_name string, version string, effective_time string"


def label(rxcui, set_id, confidence="high", source="dailymed_spl_xml", sections=None):
    return (rxcui, f"drug{rxcui}", set_id, "20240101", None, "1", confidence, source, [f"drug{rxcui}"], [], None, None, sections)


def chunk(set_id, i, text, code="34084-4", title="ADVERSE REACTIONS"):
    return (set_id, code, title, None, "paragraph", i, text, f"section[0]/paragraph[{i}]", f"h{set_id}{i}", None, None, "x", "1", "20240101")


@pytest.fixture(scope="module")
def result(spark):
    drugs = spark.createDataFrame([(str(i), f"drug{i}", [f"drug{i}"], i) for i in range(1, 8)], "rxcui string, drug_name string, cms_generic_names array<string>, rank int")
    labels = spark.createDataFrame(
        [label("1", "S1"), label("2", "s2"), label("3", "s3", "low"), label("4", None, "high", "openfda_fallback", {"warnings": "Drug4 may cause hypotension.", "indications_and_usage": "hypotension"}), label("5", "s5"), label("6", "s6")], LABELS
    )
    chunks = spark.createDataFrame(
        [
            chunk("s1", 0, "Hypotension occurred in 5% of patients."), chunk("s1", 1, "hypotension  occurred in 5% of patients"), chunk("s1", 2, "No cases of hypotension were observed."),
            chunk("s2", 0, "No cases of hypotension were observed."), chunk("s3", 0, "Hypotension occurred."), chunk("s5", 0, "Nothing of note."), chunk("s6", 0, "Hypotension.", "99999-9"),
        ],
        CHUNKS,
    )
    return analyze(drugs, labels, chunks, "low blood pressure")


def test_drugs(result):
    rows = {r.rxcui: r for r in result.drugs.collect()}
    assert {k: r.evidence_status for k, r in rows.items()} == {
        "1": "explicit_positive", "2": "negated", "3": "insufficient_label_data", "4": "explicit_positive", "5": "not_found", "6": "insufficient_label_data", "7": "insufficient_label_data",
    }
    assert rows["1"].n_items == 2 and len(rows["1"].evidence_snippets) == 2
    assert rows["1"].matched_sections == ["adverse_reactions"] and rows["4"].matched_sections == ["warnings_and_cautions"]
    assert rows["7"].label_match_confidence == "unavailable" and rows["7"].evidence_snippets is None
    assert "No selected openFDA label was available for this drug." in rows["7"].limitations
    assert rows["1"].searched_terms == ["hypotension", "low blood pressure", "hypotensive episode"]


def test_class(result):
    row = result.summary.first()
    assert (row.drugs_analyzed, row.n_explicit_positive, row.n_insufficient_label_data, row.class_assessment) == (7, 2, 3, "partial_or_mixed_label_evidence")
    assert row.evidence_distribution["comparator_only"] == 0


def test_every_positive_item_can_be_traced(result):
    for r in result.items.filter("evidence_status <> 'insufficient_label_data'").collect():
        assert r.supporting_quote and r.source_path and r.chunk_hash and r.set_id


def test_fallback_order(spark):
    df = spark.createDataFrame([label("1", "x", sections={"warnings": " a ", "contraindications": "b", "boxed_warning": ""})], LABELS)
    assert [(r.section_title, r.chunk_index, r.text, r.section_code) for r in fallback_chunks(df).orderBy("chunk_index").collect()] == [("Warnings", 1, "a", "43685-7"), ("Contraindications", 4, "b", "34070-3")]


def test_merge_unites_in_order(spark):
    from labelloom.plans.rollup import merge_items

    schema = "item_order int, drug_name string, normalized_event string, evidence_status string, assertion string, subject string, route_context array<string>, section_code string, subsection_title string, source_path string, chunk_hash string, supporting_quote string, frequency_text string, comparator_text string, population_context array<string>, interaction_context array<string>, postmarketing_only boolean, mentioned_in_sections array<string>, extra string"
    one = lambda o, quote, pm, sections, extra: (o, "Drug", "e", "s", "a", "u", ["x"], "c", None, "p", "h", quote, None, None, [], None, pm, sections, extra)
    df = spark.createDataFrame([one(3, "A  quote", True, ["b", "a"], "late"), one(1, "a QUOTE", False, ["c", "b"], "first"), one(2, "other", True, None, "x")], schema)
    got = {r.item_order: (r.merged, r.postmarketing_only, r.mentioned_in_sections, r.extra) for r in merge_items(df).collect()}
    assert got == {1: (2, False, ["c", "b", "a"], "first"), 2: (1, True, [], "x")}
    assert merge_items(df.limit(0)).count() == 0


def test_class_rows_of_no_drugs(spark):
    from labelloom.plans.rollup import class_summary

    row = class_summary(spark.createDataFrame([], "evidence_status string"), []).first()
    assert (row.drugs_analyzed, row.class_assessment) == (0, "insufficient_class_evidence")
    consistent = spark.createDataFrame([("explicit_positive",)] * 2 + [("negated",)], "evidence_status string")
    assert class_summary(consistent, []).first().class_assessment == "consistent_label_evidence"
    assert F is not None

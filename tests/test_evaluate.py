import re
from collections import defaultdict

import pyarrow.parquet as pq

from labelloom.functions import rules as R
from labelloom.plans import evaluate
from labelloom.plans.extract import event_plan
from labelloom.queries.labels import gold_primary_items

ITEM = "item_id bigint, k string, evidence_status string, matched_term string, extraction_confidence string, subject string, evidence_context array<string>, supporting_quote string, drug_name string, assertion string, interaction_context array<string>, source_path string, source_paths array<string>, chunk_hash string, chunk_hashes array<string>, source_text string"


def whole_word(term, text):
    return re.search(rf"(?<!\w){re.escape(term).replace(r'\ ', r'\s+')}(?!\w)", text, re.I)


def key(item, query):
    """The whole key in plain Python."""
    plan = event_plan(query or "")
    quote, term, status = item["supporting_quote"] or "", item["matched_term"] or "", item["evidence_status"]
    low, paths, context = quote.lower(), item["source_paths"] or [], item["evidence_context"] or []
    path = item["source_path"] or (paths[0] if paths else "")
    says = lambda *words: any(w in low for w in words)
    interaction = bool(item["interaction_context"])
    supported = {
        "negated": says("no cases", "not observed", "none observed"),
        "historical_or_preexisting": says("pre-existing", "preexisting", "history of"),
        "comparator_only": says("placebo", "comparator", "control"),
        "interaction_dependent": interaction or "drug_interaction" in context,
        "explicit_positive": item["assertion"] == "present" and bool(term),
        "related_but_not_explicit": item["assertion"] == "uncertain" and bool(term),
    }.get(status, True)
    trace = [quote.strip(), path, item["chunk_hash"] or item["chunk_hashes"], says(*plan.terms), supported]
    at = lambda values, v: values.index(v) if v in values else 99
    q = quote.strip()
    whole = q and not (q[0].islower() or q[0] in ")]},;:") and q.count(")") <= q.count("(") and q.count("]") <= q.count("[")
    direct = any(whole_word(item["drug_name"], c) and any(whole_word(t, c) for t in plan.direct) for c in re.split(r"(?<=[.!?;])\s+", quote))
    numbers = [int(n) for n in re.findall(r"\[(\d+)\]", path)]
    return (
        at(R.STATUSES, status), term.lower() not in plan.direct, at(R.CONFIDENCES, item["extraction_confidence"]), at(evaluate.SUBJECTS, item["subject"]),
        min((at(evaluate.CONTEXTS, c) for c in context), default=99), -sum(map(bool, trace)), not whole,
        0 if direct else 2 if status == "interaction_dependent" or item["assertion"] == "conditional" or interaction else 1,
        numbers or [2**63], numbers[-1] if numbers else 2**63, path, item["item_id"],
    )


def test_each_part_of_the_key(spark):
    base = {"evidence_status": "explicit_positive", "matched_term": "low blood pressure", "extraction_confidence": "high", "subject": "selected_drug", "evidence_context": ["warning"], "supporting_quote": "Low blood pressure was seen with xol.", "drug_name": "xol", "assertion": "present", "interaction_context": [], "source_path": "a[1]", "source_paths": ["a[1]"], "chunk_hash": "h", "chunk_hashes": ["h"], "source_text": "Low blood pressure was seen with xol."}
    worse = {
        "direct term before confidence": ({"extraction_confidence": "low"}, {"matched_term": "hypotensive episode"}),
        "event or synonym": ({}, {"supporting_quote": "Something was seen with xol."}),
        "classification": ({}, {"assertion": "absent"}),
        "all paths and hashes stand in": ({"source_path": "", "chunk_hash": None, "source_paths": ["a[0]"]}, {}),
        "direct statement": ({}, {"supporting_quote": "Low blood pressure was seen. It was with xol."}),
        "direct statement before the path": ({"source_path": "a[9]"}, {"supporting_quote": "Low blood pressure was seen; then xol."}),
        "interaction last": ({"supporting_quote": "Hypotension was seen."}, {"supporting_quote": "Hypotension was seen.", "interaction_context": ["with y"], "source_path": "a[0]"}),
        "place of the quote": ({}, {"source_text": "Before. Low  blood pressure was seen with xol."}),
        "quote not in the text": ({}, {"source_text": "other"}),
    }
    # the worse item has the smaller id
    rows = [{**base, **change, "k": k, "item_id": 2 * n + i} for n, (k, (better, worse)) in enumerate(worse.items()) for i, change in enumerate((worse, better))]
    columns = [c.split()[0] for c in ITEM.split(", ")]
    items = spark.createDataFrame([[r[c] for c in columns] for r in rows], ITEM)
    cases = spark.createDataFrame([(k, "low blood pressure") for k in worse] + [("no items", "hypotension"), ("no items", None)], "k string, event_query string")
    got = {(r.k, r.event_query): r.item for r in evaluate.primary_items(cases, items, ["k"], "item_id").collect()}
    assert {k: got[k, "low blood pressure"].item_id % 2 for k in worse} == dict.fromkeys(worse, 1)
    assert got["no items", "hypotension"] is None and got["no items", None] is None


def test_terms_of_the_query(spark):
    queries = ["Low Blood-Pressure ", "hypotensive episode", "QT prolongation", "torsade de pointes", "Dry  cough!", "orthostatic hypotension", "", None]
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    for r in df.select("q", evaluate.case_terms(df["q"]).alias("t")).collect():
        plan = event_plan(r.q or "")
        assert (r.t.direct, r.t.searched) == (list(plan.direct), plan.terms)


def check(spark, sf):
    items = defaultdict(list)
    for r in pq.read_table(f"{sf}/evidence_item.parquet").to_pylist():
        r["evidence_status"] = (r["evidence_status"] or "").strip().lower() or None
        items[r["set_id"].lower(), (r["normalized_event"] or "").strip().lower()].append(r)
    got = {r.case_no: r.item_id for r in gold_primary_items(spark, sf).collect()}
    want = {}
    for c in pq.read_table(f"{sf}/gold_case.parquet").to_pylist():
        own = items.get(((c["spl_set_id"] or "").lower(), c["normalized_event"].strip().lower()), [])
        want[c["case_no"]] = min(own, key=lambda i: key(i, c["event_query"]))["item_id"] if own else None
    return got, want


def test_gold_cases(spark, sf):
    got, want = check(spark, sf)
    assert got == want


def test_determinism(spark):
    rows = [("a", 1, "x", 5), ("a", 2, "y", 5), ("b", 3, "z", 5)]
    frame = lambda rs: spark.createDataFrame(rs, "k string, item_order int, v string, retrieved_at int")
    other = [("a", 2, "y", 9), ("a", 1, "x", 9), ("b", 3, "Z", 9), ("c", 1, None, 1)]
    got = evaluate.determinism([frame(rows), frame(rows[::-1]), frame(other)], ["k"]).collect()
    assert {r.k: r.deterministic for r in got} == {"a": True, "b": False, "c": False}
    twice = evaluate.determinism([frame(rows), frame(rows + rows[:1])], ["k"]).collect()
    assert {r.k: r.deterministic for r in twice} == {"a": False, "b": True}


def test_figures_without_cases(spark, sf):
    from labelloom.queries.evaluation import scores

    empty = scores(spark, sf).limit(0)
    row = evaluate.summary(empty).first()
    assert row.cases == 0 and all(v is None for c, v in row.asDict().items() if c != "cases")
    matrix = evaluate.confusion(empty, "expected_status", "predicted_status")
    assert evaluate.macro_f1(evaluate.status_metrics(matrix)).first().status_macro_f1 is None
    df = spark.createDataFrame([(None,), (0.12345,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(evaluate.metric_text(df["v"])).collect()] == ["N/A", "0.123", "N/A"]


def test_missed_status_is_skipped_in_the_mean(spark):
    rows = [("negated", "negated"), ("explicit_positive", "not_found"), ("not_found", "not_found")]
    metrics = evaluate.status_metrics(evaluate.confusion(spark.createDataFrame(rows, "e string, p string"), "e", "p"))
    got = {r.status: r for r in metrics.collect()}
    assert got["explicit_positive"].f1 is None and got["explicit_positive"].recall == 0 and got["comparator_only"].support == 0
    assert abs(evaluate.macro_f1(metrics).first().status_macro_f1 - (1 + 2 / 3) / 2) < 1e-12


def test_sections(spark):
    cases = [(("Adverse Reactions", None, ["5.1 Rash & fever"]), "rash fever", True), (("X", "6.1 Trials", None), "6.1 trials", True), (("X", None, None), None, False), (None, None, True), (None, "x", False), ((None, None, None), "x", False)]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, item struct<section_title:string,subsection_title:string,mentioned_in_sections:array<string>>, expected string")
    assert {r.i: r.m for r in df.select("i", evaluate.section_matches("item", "expected").alias("m")).collect()} == {i: c[2] for i, c in enumerate(cases)}


def test_scenarios(spark):
    ok, bad = "fixed_spl_version_verified", "missing_fixed_spl_version"
    rows = [("s1", "e", "partial_or_mixed_label_evidence", True, [("1", ok), ("2", ok)]), ("s2", "e", "x", True, [("1", ok), ("2", bad)]), ("s3", "e", "x", None, [("1", ok)]), ("s4", "e", "no_explicit_mentions_found", True, [("9", ok)])]
    scenarios = spark.createDataFrame(rows, "scenario_id string, event string, expected_class_assessment string, gold_review_complete boolean, drugs array<struct<rxcui:string,state:string>>")
    statuses = spark.createDataFrame([("e", "1", "explicit_positive"), ("e", "2", "negated")], "event string, rxcui string, evidence_status string")
    got = {r.scenario_id: (r.evaluated, r.reason, r.predicted, r.correct) for r in evaluate.scenario_results(scenarios, statuses).collect()}
    assert got == {"s1": (True, None, "partial_or_mixed_label_evidence", True), "s2": (False, bad, None, False), "s4": (True, None, "no_explicit_mentions_found", True)}

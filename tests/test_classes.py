import random

import pytest
from pyspark.sql import functions as F

from labelloom.plans import classes, labels
from labelloom.queries import classes as class_queries

RELATIONS = "drug_rxcui string, drug_name string, ord int, class_id string, class_name string, class_type string, rela_source string, rela string, rxcui string, name string, tty string"


@pytest.fixture(scope="module")
def found(spark):
    row = lambda ord, class_id, name, kind, source, rela, rxcui, member, tty: ("1", "Velorin", ord, class_id, name, kind, source, rela, rxcui, member, tty)
    rows = [
        row(0, "E1", "Lorin Receptor Agents", "EPC", "DAILYMED", "has_EPC", "1", "velorin", "IN"),
        row(1, "E1", "Other name", "EPC", "FDASPL", "has_EPC", "2", "velorin sodium", "PIN"),
        row(2, "E1", "Lorin Receptor Agents", "EPC", "FDASPL", "has_EPC_extended", "3", "velorin 5 MG Tablet", "SCD"),
        row(3, "M1", "Lorin Receptor Interactions", "MOA", "MEDRT", "has_MoA", "1", "velorin", "IN"),
        row(4, "M2", "Cytochrome P450 2D6 Inhibitors", "MOA", "MEDRT", "has_MoA", "1", "velorin", "IN"),
        row(5, "A1", "antihypertensives", "ATC1-4", "ATC", None, "9", "velorin / zolarex", "MIN"),
        row(6, "C1", "Amines", "CHEM", "odd", " ", "1", "velorin", "IN"),
        row(7, "D1", "Gout", "DISEASE", "MEDRT", "may_treat", "7", "other 5 MG", "SCD"),
        row(8, "D1", "Gout", "DISEASE", "MEDRT", "ci_with", "7", None, None),
        row(9, " ", "x", "EPC", "ATC", "r", "1", "velorin", "IN"),
        row(10, "X", None, "EPC", "ATC", "r", "1", "velorin", "IN"),
    ]
    df = spark.createDataFrame([*rows, rows[0]], RELATIONS)
    return classes.classes_by_drug(df)


def test_classes_of_a_drug(found):
    got = {r.class_id: r for r in found.collect()}
    assert sorted(got, key=lambda c: got[c].position) == ["E1", "M2", "M1", "C1", "D1", "A1"]
    e = got["E1"]
    assert (e.class_name, e.rela_source, e.rela, e.relations, e.rela_sources, e.additional_sources) == ("Lorin Receptor Agents", "FDASPL", "has_EPC", ["has_EPC", "has_EPC_extended"], ["FDASPL", "DAILYMED"], ["DAILYMED"])
    assert e.membership_examples == ["velorin", "velorin sodium", "velorin 5 MG Tablet"] and e.source_relations == {"DAILYMED": ["has_EPC"], "FDASPL": ["has_EPC", "has_EPC_extended"]}
    assert {c: r.why_shown for c, r in got.items()} == {
        "E1": "Direct ingredient membership", "M1": "Mechanism classification", "M2": "Mechanism classification", "A1": "Appears through combination products", "C1": "Chemical classification",
        "D1": "Treatment indication relationship; Contraindication-related relationship",
    }
    assert {c: r.membership_category for c, r in got.items()} == {"E1": "other", "M1": "other", "M2": "other", "A1": "combination", "C1": "technical", "D1": "other"}
    assert (got["C1"].rela, got["C1"].relations, got["C1"].source_relations) == (None, [], {})


def test_enrichment_and_groups(spark, found):
    members = spark.createDataFrame([("E1", "1", "b"), ("E1", "5", "A"), ("M1", "1", "b"), ("M1", "5", "A"), ("M2", "1", "b"), ("M2", "8", "c"), ("C1", "1", "b")], "class_id string, rxcui string, name string")
    rich = classes.enrich(found, members)
    got = {r.class_id: r for r in rich.collect()}
    assert (got["E1"].member_count, got["E1"].example_members, got["E1"].recommended_for_analysis, got["E1"].membership_category) == (2, ["A", "b"], True, "recommended")
    assert got["D1"].member_count is None and not got["D1"].recommended_for_analysis and got["C1"].membership_category == "technical"
    assert {r.class_id: r.member_count for r in classes.enrich(found, members, limit=1).collect()} == {"E1": 2, "M1": None, "M2": None, "A1": None, "C1": None, "D1": None}
    out = {r.class_id: r for r in classes.refine_mechanisms(rich, members).withColumns({"g": classes.display_group(), "t": classes.is_technical()}).collect()}
    assert {c: r.g for c, r in out.items()} == {"E1": "recommended", "M1": "recommended", "M2": "mechanistic", "A1": "combination", "C1": "technical", "D1": "other"}
    assert out["M2"].why_shown == "Secondary enzyme-inhibition classification" and out["C1"].t and not out["D1"].t
    empty = classes.refine_mechanisms(classes.enrich(found.limit(0), members), members)
    assert empty.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_members_without_pairs(spark, seed):
    """Equal to the relations of all pairs: drugs with two names or none, that are no members, products and combinations under one name."""
    r = random.Random(seed)
    names = ["velorin", "velorin sodium", "Velorin-Sodium", "zolarex", "velorin / zolarex", "zolarex sodium / velorin", "sodium", "", None, "a b velorin", "xandol 5 MG", "xandol"]
    members = []
    for ord in range(240):
        c = r.randrange(9)
        rela = r.choice([("FDASPL", "has_EPC"), ("DAILYMED", "has_EPC_extended"), ("MEDRT", "has_MoA"), ("ATC", None), (None, "x")])
        kind = r.choice(["EPC", "EPC", "MOA"]) if c == 0 else ["EPC", "MOA", "ATC1-4", "VA"][c % 4]
        tty = r.choice(["MIN", "GPCK"]) if c == 8 else r.choice(["IN", "PIN", "MIN", "SCD", "GPCK", "BN", None] if c % 2 else ["PIN", "MIN", "SCD", "IN"])
        members.append((ord, f"C{c}" if c != 7 else r.choice([" C7", "C7"]), r.choice(["One", "Two", None]), kind, *rela, str(r.randrange(10)) if r.random() < 0.95 else None, r.choice(names), tty))
    drugs = [(str(d), n, f"C{c}") for d in range(14) for n in {r.choice(names), r.choice(names)} for c in range(9) if r.random() < 0.7]
    columns = "ord bigint, class_id string, class_name string, class_type string, rela_source string, rela string, rxcui string, name string, tty string"
    m, d = spark.createDataFrame(members, columns), spark.createDataFrame(drugs, "drug_rxcui string, drug_name string, class_id string")
    pairs = d.withColumnRenamed("class_id", "id").join(m, F.col("id") == F.trim("class_id")).drop("id")
    plain = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    want = plain(classes.classes_by_drug(pairs))
    assert want and plain(classes.classes_of_members(d, m)) == want
    by_source = [*classes.KEY, "source_relations"]
    assert plain(classes.relations_by_source(d, m)) == plain(classes.classes_by_drug(pairs).select(by_source))


def test_relations_are_not_paired(spark, sf):
    """As many relations are landed as there are members, not pairs of them."""
    members = class_queries.class_members(spark, sf)
    assert class_queries.relations(spark, sf).count() == members.count() < members.join(members.select("class_id"), "class_id").count()


@pytest.mark.parametrize("narrow", [0, 2, 50])
def test_shared_members(spark, monkeypatch, narrow):
    """A mechanism agrees by two members that it shares with one primary class, in however many classes these are; those with one or with two classes don't."""
    monkeypatch.setattr(classes, "NARROW", narrow)
    rows = [("1", "M1", "MOA"), ("1", "M2", "MOA"), ("1", "M3", "MOA"), ("1", "E1", "EPC"), ("1", "E2", "EPC"), ("2", "M1", "MOA"), ("2", "E2", "EPC")]
    df = spark.createDataFrame([(*r, r[1], "FDASPL", ["has_MoA"], True, False, 2, False, "other", "") for r in rows], "drug_rxcui string, class_id string, class_type string, class_name string, rela_source string, relations array<string>, direct_membership boolean, combination_membership boolean, member_count bigint, recommended_for_analysis boolean, membership_category string, why_shown string")
    members = {"M1": "1 2 7", "M2": "1 8", "M3": "1 3 9", "E1": "1 2 4", "E2": "1 3", "X1": "1 2", "X2": "1 2"}
    m = spark.createDataFrame([(c, r) for c, listed in members.items() for r in listed.split()], "class_id string, rxcui string")
    out = {(r.drug_rxcui, r.class_id): r.recommended_for_analysis for r in classes.refine_mechanisms(df, m).collect() if r.class_type == "MOA"}
    assert out == {("1", "M1"): True, ("1", "M2"): False, ("1", "M3"): True, ("2", "M1"): False}


def test_browse(spark):
    rows = [("1", "Beta Agents", "EPC", "FDASPL", 5), ("2", "alpha-agents", "EPC", "FDASPL", None), ("3", "Gamma agents", "MOA", "MEDRT", 60), ("4", None, "EPC", "VA", 12)]
    catalog = spark.createDataFrame(rows, "class_id string, class_name string, class_type string, rela_source string, member_count int")
    names = lambda **kw: [r.class_id for r in classes.browse(catalog, **kw).orderBy("position").collect()]
    assert names(keyword="AGENTS") == ["2", "1", "3"] and names(keyword="alpha agents") == ["2"]
    assert names(size="unknown") == ["2"] and names(size="1-9") == ["1"] and names(size="10-49") == ["4"] and names(size="50+") == ["3"] and len(names(size="known")) == 3
    assert names(class_type="EPC", source="FDASPL", letter="B") == ["1"] and len(names(limit=2)) == 2


def test_drug_scans(spark):
    properties = spark.createDataFrame([("1", "Velorin", "IN"), ("2", "velorin sodium", "PIN"), ("3", " ", "IN"), ("4", "Brand", "BN"), ("5", "pack", "SCD")], "rxcui string, name string, tty string")
    payload = spark.createDataFrame([("q", (["5", "2", " ", "1", "2", "3", "9", None],)), ("none", None)], "query string, idGroup struct<rxnormId:array<string>>")
    assert [(r.rxcui, r.position, r.score) for r in classes.exact_candidates(payload, properties).orderBy("position").collect()] == [("1", 1, 100.0), ("2", 2, 100.0), ("5", 3, 100.0)]
    best = spark.createDataFrame([("q", "5", 1, 9.0, "X", 1), ("q", "4", 2, 9.0, "X", 2), ("q", "7", 0, 1.0, "X", 3), ("z", "5", 1, 1.0, "X", 1)], "query string, rxcui string, rank int, score double, source string, position int")
    found = classes.approximate_candidates(best, properties)
    assert [(r.query, r.rxcui, r.position) for r in found.orderBy("query", "position").collect()] == [("q", "5", 1), ("q", "4", 2), ("z", "5", 1)]
    assert [(r.query, r.rxcui) for r in classes.drug_hints(found).collect()] == [("q", "4")]


def test_dataset(spark):
    own, old, new = (f"{c * 8}-1111-2222-3333-444444444444" for c in "abc")
    at = lambda i: f"https://host/data-api/v1/dataset/{i}/data"
    sets = [("Other", at(old), []), ("Usage", at(own), [("CSV", "2022-01-01/2022-12-31", at(old)), ("api", "2021-01-01", at(old)), ("API", "2022-01-01", at(own)), ("API", "2022-01-01", at(new)), ("API", "2022-06-01", at(old))]), ("Usage", at(old), None)]
    df = spark.createDataFrame([(sets,)], "dataset array<struct<title:string,identifier:string,distribution:array<struct<format:string,temporal:string,accessURL:string>>>>")
    assert [tuple(r) for r in classes.resolve_dataset(df, "Usage", 2022).collect()] == [(own, new)]
    assert [tuple(r) for r in classes.resolve_dataset(df, "Usage", 1999).collect()] == [(own, None)]
    assert classes.resolve_dataset(df, "Absent", 2022).count() == 0


def test_values_and_lists(spark):
    cases = {'["a"," ","b",null]': ["a", "b"], " x ": ["x"], "": [], None: [], "[]": [], "[broken": ["[broken"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in df.withColumn("v", labels.filled(F.col("t"))).collect()} == cases


RECORD = {"query": "Velorin", "query_rxcui": "1", "search_field": "rxcui", "position": 0, "id": None, "effective_time": "20240101", "openfda": {}}


def record(**kw):
    out = {**RECORD, **kw}
    out["openfda"] = tuple(out["openfda"].get(f) for f in ("spl_id", "spl_set_id", "set_id", "rxcui", "generic_name", "brand_name", "substance_name"))
    columns = [c.split()[0] for c in labels.LABELS.split(" openfda")[0].replace(",", "").split("string") if c.strip()]
    names = ["query", "query_rxcui", "search_field", "position", "id", "effective_time", "spl_set_id", "set_id", "warnings", "warnings_and_cautions", "adverse_reactions", "contraindications", "drug_interactions", "openfda"]
    assert columns
    return tuple(out.get(n) for n in names)


def choose(spark, records):
    usage = spark.createDataFrame([("1", "Velorin", ["Velorin Sodium", None]), ("2", "none", [])], "rxcui string, name string, generic_names array<string>")
    return labels.select_labels(spark.createDataFrame([record(**r) for r in records], labels.LABELS), usage).collect()


def test_steps_of_the_search(spark):
    generic = lambda name, i, **kw: {"search_field": "generic_name", "position": i, "id": f"g{i}", "openfda": {"generic_name": name}, **kw}
    brand = {"search_field": "brand_name", "position": 0, "id": "b", "openfda": {"rxcui": "1"}}
    # a generic search without the exact name goes on, the better record of a later step wins
    assert [r.id for r in choose(spark, [generic("velorin sodium", 0), brand])] == ["b"]
    # an exact name stops the search
    assert [r.id for r in choose(spark, [generic('["velorin sodium","VELORIN"]', 0), brand])] == ["g0"]
    # equal records: the one retrieved first; the same id counts once
    assert [(r.id, r.position) for r in choose(spark, [generic("velorin", 3), generic("velorin", 1), {**generic("velorin", 1), "position": 2}])] == [("g1", 1)]
    # records without any id are told apart by their place
    assert [r.position for r in choose(spark, [generic("x", 0, id=None), generic("velorin", 1, id="")])] == [1]
    assert choose(spark, []) == []


def test_score_and_reasons(spark):
    full = {"id": "f", "warnings": '["w"]', "adverse_reactions": "a", "contraindications": " ", "spl_set_id": '[" ","S"]', "openfda": {"rxcui": '["9","1"]', "generic_name": "velorin", "substance_name": '["velorin sodium"]'}}
    (r,) = choose(spark, [full])
    assert (r.label_match_score, r.label_match_confidence, r.spl_set_id_found, r.spl_set_id_place, r.safety_fields) == (100, "moderate", "S", "root.spl_set_id", ["warnings", "adverse_reactions"])
    assert r.label_match_reasons[0] == "Exact RxClass RXCUI match in openFDA." and "CMS product/salt: velorin sodium." in r.label_match_reasons[2] and "2/5" in r.label_match_reasons[3]
    (r,) = choose(spark, [{"id": "n", "openfda": {"set_id": "Z"}}])
    assert (r.label_match_score, r.label_match_confidence, r.spl_set_id_place) == (5, "low", "openfda.set_id")
    assert r.label_match_reasons == [
        "No exact base-ingredient RXCUI was present in this product label.", "Product/salt compatibility with the CMS matches is uncertain.", "Safety coverage: 0/5 requested sections present.", "SPL set identifier found at openfda.set_id.",
    ]

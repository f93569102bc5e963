import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from labelloom.llm import duplicates, survivors
from labelloom.llm.canonical import canonical_fields, canonical_sql, canonical_text, composed
from labelloom.llm.queries import p4_found, p5_found


def test_canonical_text(spark):
    cases = {" A-b,\tC % d! ": "a b c % d", "Ünï—CÖDE ½ 5mg": "ünï cöde ½ 5mg", "...": "", "": "", None: None, "x" * 50_000: "x" * 50_000}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.c for r in df.withColumn("c", canonical_text(F.col("t"))).collect()} == cases
    fields = spark.createDataFrame([("B: 2 | A: 1",), ("a  1|| b-2 ",), ("|",), (None,)], "t string")
    assert [r[0] for r in fields.select(canonical_fields(F.col("t"))).collect()] == ["a 1 b 2", "a 1 b 2", "", None]


def test_strict_form_keeps_what_changes_the_meaning(spark):
    apart = [("dose < 5 mg", "dose > 5 mg"), ("1.5 mg", "1 5 mg"), ("1,5", "15"), ("-5 units", "5 units"), ("± 5", "5"), ("a+b", "a b"), ("cafe\u0301", "cafe"), ("5 °C", "5 C"), ("1.2.3", "1 2.3")]
    alike = [("cafe\u0301s", "Cafés"), ("A-b,  c.", "a b c"), ("(dose) - 5 mg", "dose 5 mg"), ("x-5", "X 5"), ("5 mg.", "5 MG"), ("“Rash”; 1.5%", "rash 1.5%"), ("3-5", "3 5"), ("end. 5", "end 5")]
    df = spark.createDataFrame([(a, b) for a, b in apart + alike], "a string, b string")
    form = lambda c: canonical_text(composed(F.col(c)), strict=True)
    got = [(r.x, r.y) for r in df.select(form("a").alias("x"), form("b").alias("y")).collect()]
    assert [x != y for x, y in got[: len(apart)]] == [True] * len(apart), got
    assert [x == y for x, y in got[len(apart) :]] == [True] * len(alike), got
    rows = df.toPandas()  # noqa: F841
    assert duckdb.sql(f"select {canonical_sql('nfc_normalize(a)', True)}, {canonical_sql('nfc_normalize(b)', True)} from rows").fetchall() == got


def test_a_key_of_a_third_of_the_rows_is_salted(spark):
    """At the default settings; its rows never meet in one task."""
    df = spark.range(75_000).selectExpr("id", "if(id % 3 = 1, 'hot', concat('k', id div 4)) k")
    out = duplicates.collapse(df, "id", duplicates.key_of(F.col("k")))
    assert out.hot.count() == 1
    counts = {(r.first_id, r.copies): r["count"] for r in out.members.groupBy("first_id", "copies").count().filter("count > 4").collect()}
    assert counts == {(1, 25_000): 25_000}
    assert out.members.count() == 75_000
    assert out.representatives().agg(F.sum("copies")).first()[0] == 75_000


def test_hot_and_other_keys_against_brute_force(spark):
    pick = random.Random(1)
    rows = [(i, "hot" if pick.random() < 0.35 else f"k{pick.randrange(300)}" if pick.random() < 0.9 else None, "x") for i in range(3000)]
    rows += rows[:20] + [(None, "hot", "x")]
    df = spark.createDataFrame(rows, "i bigint, k string, first_id string")
    out = duplicates.collapse(df, "i", duplicates.key_of(F.col("k")), hot_share=0.05, hot_rows=100, salts=4)
    groups = defaultdict(list)
    for i, k, _ in rows:
        if k is not None and i is not None:
            groups[k].append(i)
    want = sorted((i, min(g), len(g)) for g in groups.values() for i in g)
    assert sorted(tuple(r) for r in out.members.collect()) == want
    assert out.hot.count() == 1
    assert sorted(tuple(r) for r in out.representatives().collect()) == sorted((min(g), len(g)) for g in groups.values())


def test_no_rows(spark):
    df = spark.createDataFrame([], "i bigint, k string")
    assert duplicates.collapse(df, "i", duplicates.key_of(F.col("k"))).members.count() == 0


def test_found(spark, sf):
    got = {(r.first_chunk_id, r.chunk_id) for r in p4_found(spark, sf).collect()}
    import re

    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/label_chunk.parquet").collect():
        fold = lambda t: " ".join("".join(c if c.isalnum() or c == "%" else " " for c in t.lower()).split())
        text = " ".join(sorted(f for f in map(fold, re.split(r"\|", r.text)) if f)) if r.chunk_type == "table_row" else fold(r.text)
        groups[r.set_id.lower(), text].append(r.chunk_id)
    assert got == {(min(g), i) for g in groups.values() for i in g if i != min(g)}


SCHEMA = "i bigint, g string, a string, b array<string>, seen timestamp, trust string, first_id string"


def test_survivors(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, n)
    rows = [
        (1, "g", "x", ["s1"], day(1), "low", "c"),
        (2, "g", " ", ["s2", "s1", ""], day(3), "HIGH ", "c"),
        (3, "g", " y ", [], day(2), "high", "c"),
        (4, "g", "z", None, day(2), "high", "c"),
        (5, "one", "x", None, day(1), None, "c"),
        (6, None, "x", None, day(1), None, "c"),
        (7, "h", None, None, None, None, "c"),
        (8, "h", None, None, None, None, "c"),
        (9, "r", "q", None, day(1), None, "c"),
        (9, "r", "q", None, day(1), None, "c"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    merged = lambda d: {r.first_id: (r.survivor_id, r.copies, r.a, r.b) for r in survivors.merge(d, "i", survivors.F.col("g"), ["a", "b"], "seen", "trust", ("high", "medium", "low"), ["a"], ["b"]).collect()}
    assert merged(df) == {1: (1, 4, "y", ["s1", "s2"]), 7: (7, 2, None, None), 9: (9, 2, "q", None)}
    assert merged(df.limit(0)) == {}
    two = df.withColumn("c", F.array(F.lit("z"), F.concat(F.lit("c"), "a")))
    out = survivors.merge(two, "i", F.col("g"), ["a", "b"], "seen", "trust", ("high", "medium", "low"), ["a", "trust"], ["b", "c"]).collect()
    assert {r.first_id: (r.a, r.trust, r.b, r.c) for r in out} == {1: ("y", "HIGH", ["s1", "s2"], ["c ", "c y ", "cx", "cz", "z"]), 7: (None, None, None, ["z"]), 9: ("q", None, None, ["cq", "z"])}


def test_survivors_found(spark, sf):
    rows = p5_found(spark, sf).collect()
    assert rows and all(r.first_item_id <= r.survivor_item_id for r in rows)
    assert len({r.first_item_id for r in rows}) == len(rows)

from pyspark.sql import functions as F

from labelloom.plans import discover
from labelloom.sources import snapshots


def test_name_match(spark):
    cases = [
        ("Metoprolol", "IN", "metoprolol", "exact"),
        ("metoprolol", "IN", "Metoprolol Succinate", "salt-normalized"),
        ("metoprolol tartrate", "PIN", "Metoprolol", None),
        ("hydrochlorothiazide / lisinopril", "MIN", "Lisinopril/Hydrochlorothiazide", "combination-normalized"),
        ("lisinopril", "IN", "Lisinopril/Hydrochlorothiazide", None),
        ("", "IN", "", None),
        (None, "IN", "x", None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "name string, tty string, generic_name string")
    assert [r.q for r in df.withColumn("q", discover.name_match("name", "tty", "generic_name")).collect()] == [c[3] for c in cases]
    matched = discover.match_usage(df.select("name", "tty").distinct(), df.select("generic_name").distinct())
    assert {(r.name, r.generic_name) for r in matched.collect()} >= {("metoprolol", "Metoprolol Succinate"), ("Metoprolol", "metoprolol")}


def test_usage_rollup(spark):
    rows = [("1", "A", "b x", 5, None, "exact"), ("1", "A", "B x", 6, None, "salt-normalized"), ("2", "B", "c", 11, 3, "exact"), ("3", "C", "d", 11, 3, "exact")]
    got = discover.usage_rollup(spark.createDataFrame(rows, "rxcui string, name string, generic_name string, claims bigint, beneficiaries bigint, match_quality string")).orderBy("rank").collect()
    assert [(r.rxcui, r.total_claims, r.total_beneficiaries, r.match_quality, r.approximate_match, r["rank"]) for r in got] == [("2", 11, 3, "exact", False, 1), ("3", 11, 3, "exact", False, 2), ("1", 11, None, "exact, salt-normalized", True, 3)]
    assert got[2].generic_names == ["B x", "b x"]


def test_class_search(spark):
    catalog = spark.createDataFrame([("1", "HMG-CoA Reductase Inhibitors", "EPC"), ("2", "Statin agents", "EPC"), ("3", "Old statin agents", "MOA"), ("4", "Agents of statin", "PE"), ("5", "Statyn agents", "VA")], "class_id string, class_name string, class_type string")
    found = lambda q: [(r.class_id, r.bucket) for r in discover.search_classes(catalog, q).orderBy("match_strength", "position").collect()]
    assert found("statin agents") == [("2", 0), ("3", 2), ("4", 2), ("5", 3)]
    assert found("Statins") == [("1", 0)]
    assert found("zzz") == []


def test_cascade_and_options(spark):
    rows = [("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 2, False), ("b", 3, False)]
    df = spark.createDataFrame(rows, "k string, o int, s boolean")
    assert sorted((r.k, r.o) for r in discover.cascade(df, "k", "o", F.col("s")).collect()) == [("a", 1), ("a", 2), ("b", 2), ("b", 3)]
    assert sorted((r.k, r.o) for r in discover.first_option(df, ["k"], "o").collect()) == [("a", 1), ("b", 2)]


def test_overlap(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9), ("a", 2)], "k string, i int")
    right = spark.createDataFrame([("g", 1), ("g", 2), ("h", 2), ("h", 2)], "g string, i int")
    assert sorted(tuple(r) for r in discover.max_overlap(left, right, ["k"], "i", "g").collect()) == [("a", 2), ("b", 0)]


def test_label_score(spark):
    df = spark.createDataFrame([(True, True, True, True, True, 5, True), (False, False, False, False, True, 2, False), (False, None, False, False, False, 5, True)], "a boolean, b boolean, c boolean, d boolean, e boolean, n int, s boolean")
    columns = [F.col(c) for c in "abcde"]
    df = df.select(discover.label_score(*columns, F.col("n"), F.col("s")).alias("score"), discover.label_confidence(*columns, F.col("n")).alias("confidence"))
    assert [tuple(r) for r in df.collect()] == [(100, "high"), (24, "moderate"), (15, "low")]


def test_snapshots(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"rxclassMinConceptList":{"rxclassMinConcept":[{"classId":"1","className":"B","classType":"EPC"},{"classId":"1","className":"dup","classType":"EPC"},{"classId":" ","className":"x"},{"classId":"2","className":"A","classType":"ATC1-4"},{"classId":"3","className":"C","classType":"TC"}]}}')
    got = snapshots.class_catalog(snapshots.read_json(spark, str(tmp_path / "c.json"), snapshots.CATALOG)).orderBy("class_id").collect()
    assert [tuple(r) for r in got] == [("1", "B", "EPC", "FDASPL", "has_EPC"), ("2", "A", "ATC1-4", "ATC", None), ("3", "C", "TC", "Resolve on selection", None)]
    (tmp_path / "m.json").write_text('[{"class_id":"1","option":1,"drugMemberGroup":{"drugMember":[]}},{"class_id":"1","option":2,"drugMemberGroup":{"drugMember":[{"minConcept":{"tty":"IN","rxcui":"7","name":"X"}},{"minConcept":{"tty":"SCD","rxcui":"8","name":"Y"}},{"minConcept":{"tty":"IN","rxcui":"7","name":"x "}}]}},{"class_id":"1","option":3,"drugMemberGroup":{"drugMember":[{"minConcept":{"tty":"IN","rxcui":"9","name":"Z"}}]}}]')
    assert [tuple(r) for r in snapshots.class_members(snapshots.read_json(spark, str(tmp_path / "m.json"), snapshots.MEMBERS)).collect()] == [("1", "7", "X", "IN")]
    (tmp_path / "a.json").write_text('{"query":"q","approximateGroup":{"candidate":[{"rxcui":"1","rank":"2","score":"9","source":"X"},{"rxcui":"1","rank":"3","score":"9","source":"RXNORM"},{"rxcui":"1","rank":"4","score":"8","source":"Y"},{"rxcui":"2","score":"1","source":"X"}]}}')
    assert [(r.rxcui, r["rank"], r.position) for r in snapshots.best_candidates(snapshots.read_json(spark, str(tmp_path / "a.json"), snapshots.CANDIDATES)).orderBy("position").collect()] == [("1", 3, 1), ("2", 999999, 2)]
    (tmp_path / "u.json").write_text('[{"Gnrc_Name":" A ","Tot_Clms":"2.5","Tot_Benes":"","Prscrbr_Geo_Lvl":"National"},{"Gnrc_Name":"B","Tot_Clms":"x","Tot_Benes":"7","Prscrbr_Geo_Lvl":"National"},{"Gnrc_Name":"C","Prscrbr_Geo_Lvl":"State"}]')
    assert [tuple(r) for r in snapshots.national_usage(snapshots.read_json(spark, str(tmp_path / "u.json"), snapshots.USAGE)).collect()] == [("A", 2, None), ("B", 0, 7)]
    (tmp_path / "bad.json").write_text("{nope")
    assert snapshots.class_catalog(snapshots.read_json(spark, str(tmp_path / "bad.json"), snapshots.CATALOG)).count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, t int")
    assert sorted(tuple(r) for r in snapshots.upsert(old, new, ["k"], "t").collect()) == [(1, "a", 1), (2, "c", 1), (3, "d", 0)]
    nested = spark.createDataFrame([(1, {"a": 1}, None)], "id int, m map<string,int>, n string")
    snapshots.append_run(nested, str(tmp_path / "runs"))
    snapshots.append_run(nested, str(tmp_path / "runs"))
    assert [r.m for r in spark.read.parquet(str(tmp_path / "runs")).collect()] == ['{"a":1}'] * 2
    snapshots.write_json(nested, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"id":1,"m":{"a":1},"n":null}'
    row = spark.createDataFrame([("https://x/y?a=1&API_KEY=abc&token=t#z", "secret abc")], "u string, m string").select(snapshots.redact(F.col("u")), snapshots.scrub(F.col("m"), ["abc", ""])).first()
    assert tuple(row) == ("https://x/y?a=1&API_KEY=***&token=***#z", "secret ***")
    assert snapshots.markdown([(1.0, None)], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 1.000 | N/A |"


def test_stream(spark, tmp_path):
    from labelloom.streaming import ingest

    schema = "chunk_id bigint, set_id string, chunk_hash string, feed string, loaded_at timestamp"
    rows = "values (1, 'A', 'h', 'f', timestamp'2024-01-01'), (2, 'a', 'h', 'f', timestamp'2024-01-02'), (3, 'b', 'h', 'f', timestamp'2024-01-02')"
    spark.sql(f"select cast(col1 as bigint) chunk_id, col2 set_id, col3 chunk_hash, col4 feed, col5 loaded_at from {rows}").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.chunk_stream(spark, str(tmp_path / "in"), schema)
    merge = ingest.merge_into(str(tmp_path / "table"), ["set_id", "chunk_hash"], "loaded_at")
    run = stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted((r.set_id, r.chunk_hash) for r in spark.read.parquet(str(tmp_path / "table/v00000000")).collect()) == [("a", "h"), ("b", "h")]

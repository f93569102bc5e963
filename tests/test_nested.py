import json
import random

from pyspark.sql import functions as F

from labelloom.operators import nested
from labelloom.queries.problems import p7_found


def brute(value, path="$", parent="$"):
    out = set()
    if isinstance(value, dict):
        for k, v in value.items():
            if k in nested.LIST_KEYS:
                if isinstance(v, str):
                    try:
                        v = json.loads(v)
                    except ValueError:
                        pass
                v = [v] if isinstance(v, dict) else v
            out |= brute(v, f"{path}.{k}", parent)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            here = f"{path}[{i}]"
            if isinstance(x, dict):
                out |= {(parent, here)} | brute(x, here, here)
            else:
                out |= brute(x, here, parent)
    return out


def random_value(pick, depth):
    kind = pick.random()
    if depth == 0 or kind < 0.2:
        return pick.choice([None, 1, 2.5, "x", "", "{", True, "[1]"])
    if kind < 0.6:
        keys = pick.sample([*nested.LIST_KEYS, "a", "b", "odd key", "ключ"], pick.randrange(4))
        out = {k: random_value(pick, depth - 1) for k in keys}
        return {k: json.dumps(v) if k in nested.LIST_KEYS and pick.random() < 0.3 else v for k, v in out.items()}
    return [random_value(pick, depth - 1) for _ in range(pick.randrange(4))]


def test_random_against_brute_force(spark):
    pick = random.Random(5)
    texts = [json.dumps(random_value(pick, 7), ensure_ascii=pick.random() < 0.5) for _ in range(400)]
    deep = "[" * 60 + '{"a":[{}]}' + "]" * 60
    texts += [deep, None, "", "  ", '{"a":[{}', "nope", "[]", "{}", '{"labels":{"labels":{}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id bigint, t string")
    got = {}
    for r in nested.links(nested.json_nodes(df, "record_id", "t")).collect():
        got.setdefault(r.record_id, []).append((r.parent_path, r.child_path))
    for i, t in enumerate(texts):
        try:
            want = brute(json.loads(t or ""))
        except ValueError:
            want = set()
        assert sorted(got.get(i, [])) == sorted(want), t


def test_repeated_keys_trailing_text_and_depth(spark):
    deep = lambda n: "[" * (n - 3) + '{"a":[{}]}' + "]" * (n - 3)
    wide = '{"a":[' + ",".join(["{}"] * 1200) + "]}"
    cases = [
        ('{"labels":[{}],"labels":[{"x":1},{"y":"]"}]}', 2),
        (' {"labels":"[{},{}]"}\n', 2),
        ('{"labels":"[{}] x"}', None),
        *[('{"labels":[{}]}' + after, None) for after in (" x", "]", "}", ", {}", "{}", ',"w":1')],
        (wide, 1200),
        (wide + " x", None),
        (wide + wide, None),
        *[(deep(n), 2) for n in (998, 999, nested.DEEPEST)],
        (deep(nested.DEEPEST) + " x", None),
        (deep(nested.DEEPEST) + "[]", None),
        (deep(nested.DEEPEST + 1), None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "record_id bigint, t string")
    got = {r.record_id: r.n for r in nested.links(nested.json_nodes(df, "record_id", "t")).groupBy("record_id").agg(F.count("*").alias("n")).collect()}
    assert [got.get(i) for i in range(len(cases))] == [n for _, n in cases]


def test_table(spark):
    text = '{"labels":[null,{"rxcui":"1","spl_chunks":"[{\\"text\\":\\"a\\",\\"chunk_index\\":3},{\\"text\\":{}}]"}]}'
    nodes = nested.json_nodes(spark.createDataFrame([(7, text)], "id bigint, t string"), "id", "t")
    assert [tuple(r) for r in nested.table(nodes, "spl_chunks", {"text": "string", "chunk_index": "bigint"}).collect()] == [
        (7, "$.labels[1]", "$.labels[1].spl_chunks[0]", 0, "a", 3),
        (7, "$.labels[1]", "$.labels[1].spl_chunks[1]", 1, "{}", None),
    ]
    assert nested.table(nodes, "labels", {"rxcui": "string"}).first().rxcui == "1"


def test_unread_texts_and_fields_within_objects(spark):
    rows = [(1, '{"labels":[{"a":{"b":"x"}},{"a":7}]}', "k"), (2, "", "k"), (3, None, "k"), (4, " \n", "k"), (5, '{"labels":[', "k"), (6, "{} x", "k"), (7, "[]", "k"), (8, "nope", "k"), (8, "nope", "k")]
    df = spark.createDataFrame(rows, "id bigint, t string, error string")
    nodes = nested.json_nodes(df, "id", "t")
    assert sorted((r.record_id, r.error) for r in nested.unread(nodes, df, "id", "t").collect()) == [(2, "blank"), (3, "blank"), (4, "blank"), (5, "not JSON"), (6, "not JSON"), (8, "not JSON"), (8, "not JSON")]
    assert [(r.path, r.a_b) for r in nested.table(nodes, "labels", {"a.b": "string"}).collect()] == [("$.labels[0]", "x"), ("$.labels[1]", None)]


def test_paths(spark):
    rows = [(1, "/Section[1]//SubSection[2]/ table[1] /row[3]/"), (2, "section[1]/paragraph[1]"), (3, None), (4, ""), (5, "subsection[1]"), (5, "subsection[1]")]
    got = [tuple(r) for r in nested.path_links(spark.createDataFrame(rows, "i bigint, p string"), "i", "p").collect()]
    assert got == [(1, "section[1]/subsection[2]", "section[1]/subsection[2]/table[1]/row[3]"), (5, "subsection[1]", "subsection[1]"), (5, "subsection[1]", "subsection[1]")]


def test_section_tree(spark):
    df = spark.createDataFrame([(1, "section[1]/subsection[2]/subsection[3]/row[1]", "A › B > C")], "i bigint, p string, t string")
    assert [tuple(r) for r in nested.subsections(df, "i", "p", "t").collect()] == [
        (1, "", "section[1]", 0, None),
        (1, "section[1]", "section[1]/subsection[2]", 1, "A"),
        (1, "section[1]/subsection[2]", "section[1]/subsection[2]/subsection[3]", 2, "B"),
    ]


def test_found(spark, sf):
    assert {r.source_table for r in p7_found(spark, sf).select("source_table").distinct().collect()} == {"analysis_run", "label_chunk"}

from datetime import datetime

from labelloom.streaming import ingest

COLUMNS = "chunk_id bigint, set_id string, chunk_hash string, text string, loaded_at timestamp"
ROWS = [
    (1, "A", None, "one"), (2, "a", None, "two"), (3, "a", "", "three"), (4, "a", " ", "four"),  # no hash: all differ
    (5, "a", "old", "five"), (6, "a", "old", "six"),  # outdated hash on two texts
    (7, "a", "h1", "seven"), (8, "A", "h2", "seven"), (9, "a", None, "seven"),  # one text
    (10, "b", "h1", "seven"),  # of another label
    (11, "a", "h", None), (12, "a", None, None), (12, "a", None, None),  # no text: by id
    (13, None, "h", "x"), (14, None, "h", "x"), (15, "", "h", "x"),  # no label: by id
    (None, "a", None, None), (None, "a", None, None), (None, "c", None, None),  # by all columns
]


def run(spark, folder, columns):
    names = [c.split()[0] for c in columns.split(", ")]
    rows = [(*r, datetime(2024, 1, 1 + i % 3)) for i, r in enumerate(ROWS)]
    spark.createDataFrame(rows, COLUMNS).select(*names).coalesce(1).write.parquet(str(folder / "in"))
    stream = ingest.chunk_stream(spark, str(folder / "in"), columns)
    merge = ingest.merge_into(str(folder / "table"), ["chunk_key"], "loaded_at")
    assert stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(str(folder / "table/v00000000")).collect()


def test_null_blank_and_outdated_hashes(spark, tmp_path):
    got = run(spark, tmp_path, COLUMNS)
    pairs = sorted((r.set_id or "", r.text or "") for r in got if r.text)
    assert pairs == sorted([("a", t) for t in ("one", "two", "three", "four", "five", "six", "seven")] + [("b", "seven")] + [("", "x")] * 3)
    assert sorted((r.chunk_id or 0, r.set_id) for r in got if r.text is None) == [(0, "a"), (0, "c"), (11, "a"), (12, "a")]


def test_without_texts(spark, tmp_path):
    got = run(spark, tmp_path, COLUMNS.replace(" text string,", ""))
    assert sorted(r.chunk_id or 0 for r in got if not (r.chunk_hash or "").strip()) == [0, 0, 1, 2, 3, 4, 9, 12]
    assert sorted((r.set_id or "", r.chunk_hash) for r in got if (r.chunk_hash or "").strip()) == [("", "h")] * 3 + [("a", "h"), ("a", "h1"), ("a", "h2"), ("a", "old"), ("b", "h1")]

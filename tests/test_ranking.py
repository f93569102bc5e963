import random

from pyspark.sql import functions as F

from labelloom.operators.ranking import ranked


def test_positions(spark):
    pick = random.Random(6)
    rows = [(i, pick.choice([None, *range(50)]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, v int, extra string").repartition(7)
    got = {r.i: r.pos for r in ranked(df, [F.desc_nulls_last("v"), F.col("i")], "pos").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    assert ranked(df.limit(0), [F.col("i")], "pos").count() == 0
    assert sorted(r.pos for r in ranked(spark.createDataFrame([(1,)] * 5, "i int"), [F.col("i")], "pos").collect()) == [1, 2, 3, 4, 5]

"""Positions in one total order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import written


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``, each row's position by ``order`` from 1.

    Rows are partitioned by ranges of the order and numbered inside each range;
    the sizes of the smaller ranges, one number a range, are added. ``order``
    should break all ties; rows that it doesn't tell apart get successive
    positions in any order. An empty frame stays empty.
    """
    parts = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = parts.withColumn("__in", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    sizes = parts.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range, so the sizes are few whatever the data
    starts = sizes.select(F.col("__range").alias("__r"), before.alias("__before"))
    joined = inside.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    return joined.withColumn(out, (F.col("__before") + F.col("__in")).cast("bigint")).drop("__range", "__in", "__r", "__before")

"""Records that differ only in formatting, collapsed into one with its number of copies.

Hot keys are detected exactly by summing partial counts. They are salted and
aggregated in two levels; all other keys take one shuffle. The smallest
identifier represents its group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import written

#: A key is hot from this share of all rows, and from this number of rows at least.
HOT_SHARE, HOT_ROWS = 1e-4, 20_000
SALTS = 64


@dataclass
class Collapsed:
    """``members``: id, first_id and copies of every row with a key; ``hot``: the hot keys."""

    members: DataFrame
    hot: DataFrame

    def representatives(self) -> DataFrame:
        """One row per distinct record: its smallest id and its number of copies."""
        return self.members.filter(F.col("id") == F.col("first_id")).select("id", "copies").dropDuplicates(["id"])


def key_of(*parts: Column) -> Column:
    """A 128-bit key of the parts; null if a part is null."""
    return F.when(~F.isnull(F.concat(*parts)), F.unhex(F.md5(F.concat_ws("\u001f", *parts))))


def collapse(df: DataFrame, id_column: str, key: Column, hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> Collapsed:
    """Groups of rows with equal ``key``; rows with a null key or id are in no group.

    ``members`` has a row for every other row of ``df``, repeated rows
    included. At most 1 / ``hot_share`` keys are hot, so they may be broadcast.
    """
    keyed = df.select(F.col(id_column).alias("id"), key.alias("k")).filter(F.col("k").isNotNull() & F.col("id").isNotNull())
    keyed = written(keyed, "keys")  # it is read for counting, for the hot keys and for the rest
    counts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # partial counts are made before the shuffle
    rows = keyed.agg(F.greatest(F.lit(hot_rows), F.count(F.lit(1)) * F.lit(hot_share)).alias("least"))
    hot = counts.join(F.broadcast(rows), F.col("n") >= F.col("least"), "inner").select("k")
    # the flag separates the two ways; the hot keys are few by their definition
    flagged = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "k", "left")
    group = Window.partitionBy("k")
    rest = flagged.filter(F.col("hot").isNull()).select("id", F.min("id").over(group).alias("first_id"), F.count(F.lit(1)).over(group).alias("copies"))
    salted = flagged.filter(F.col("hot")).groupBy("k", (F.pmod(F.xxhash64("id"), F.lit(salts))).alias("salt")).agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    tops = salted.groupBy("k").agg(F.min("m").alias("first_id"), F.sum("n").alias("copies"))
    warm = keyed.join(F.broadcast(tops), "k").select("id", "first_id", "copies")
    return Collapsed(rest.unionByName(warm), hot)

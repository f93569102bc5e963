"""One surviving record per group of duplicates, with the best value of each field.

Records are ranked by completeness, trust and recency in one window with a
deterministic tie-break: a record takes part once in the ranking of survivors
and once in that of each field it fills. Only the top of each ranking is kept,
so the ranks are limited before the shuffle and a hot group never meets in one
task; united fields are reduced to distinct values in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_filled(df: DataFrame, name: str) -> Column:
    """Not null, blank or empty."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(F.trim(name)) > 0, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(name) > 0, F.lit(False))
    return F.col(name).isNotNull()


def completeness(df: DataFrame, names: list[str]) -> Column:
    """Number of filled fields."""
    return sum((is_filled(df, n).cast("int") for n in names), F.lit(0))


def trust(column: str, order: tuple[str, ...]) -> Column:
    """Position in ``order`` counted from its end; anything else is 0."""
    out = F.lit(0)
    for i, name in enumerate(order):
        out = F.when(F.lower(F.trim(F.col(column))) == name, len(order) - i).otherwise(out)
    return out


def top_records(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first record of each key by ``order``, which must break all ties."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def united(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``key`` and, for each array column, its sorted distinct values, blanks left out (null without any)."""
    entry = lambda i: lambda v: F.struct(F.lit(i).alias("__f"), v.alias("__v"))
    each = F.flatten(F.array(*[F.transform(F.coalesce(n, F.array().cast("array<string>")), entry(i)) for i, n in enumerate(names)]))
    values = df.select(key, F.inline(each)).filter(F.length(F.trim("__v")) > 0).distinct()
    lists = values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__f", "__v"))).alias("__l"))
    own = lambda i: F.transform(F.filter("__l", lambda x: x["__f"] == i), lambda x: x["__v"])
    return lists.select(key, *[F.when(F.size(own(i)) > 0, own(i)).alias(n) for i, n in enumerate(names)])


def merge(
    df: DataFrame,
    id_column: str,
    key: Column,
    fields: list[str],
    recency: str,
    trusted: str,
    trust_order: tuple[str, ...],
    best: list[str] = (),
    unite: list[str] = (),
) -> DataFrame:
    """One row per group of two or more records with equal ``key``.

    first_id, survivor_id, copies, the ``best`` fields (the filled value of
    highest trust, then recency, then smallest id; trimmed if text) and the
    ``unite`` arrays. The survivor has most of ``fields`` filled, then the
    latest ``recency`` (null last), then the smallest id. A null key is in no
    group. Ties and repeated rows are settled by the id; extra columns are not
    read.
    """
    used = list(dict.fromkeys([*fields, recency, trusted, *best, *unite]))
    rows = df.select(F.col(id_column).alias("__id"), key.alias("__k"), *used).filter(F.col("__k").isNotNull() & F.col("__id").isNotNull())
    sizes = rows.groupBy("__k").agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # the rankings a record takes part in, with its score there: 0 is the survivors', i + 1 that of the field best[i]
    entry = lambda i, score: F.struct(F.lit(i).alias("__i"), score.cast("int").alias("__score"))
    taken = F.array(entry(0, completeness(rows, fields)), *[F.when(is_filled(rows, n), entry(i + 1, trust(trusted, trust_order))) for i, n in enumerate(best)])
    value = lambda n: F.trim(n) if isinstance(rows.schema[n].dataType, T.StringType) else F.col(n)
    ranked = rows.select("__k", "__id", recency, *[value(n).alias(f"__v{i + 1}") for i, n in enumerate(best)], F.inline(F.filter(taken, lambda e: e.isNotNull())))
    # a record carries a field's value only in that field's ranking
    ranked = ranked.select("__k", "__i", "__score", F.col(recency).alias("__late"), "__id", *[F.when(F.col("__i") == i + 1, F.col(f"__v{i + 1}")).alias(f"__v{i + 1}") for i in range(len(best))])
    tops = top_records(ranked, ["__k", "__i"], [F.col("__score").desc(), F.col("__late").desc_nulls_last(), F.col("__id").asc()])
    tops = tops.groupBy("__k").agg(F.max(F.when(F.col("__i") == 0, F.col("__id"))).alias("survivor_id"), *[F.any_value(f"__v{i + 1}", True).alias(n) for i, n in enumerate(best)])
    out = sizes.join(tops, "__k")
    if unite:
        out = out.join(united(rows, "__k", list(unite)), "__k", "left")
    return out.select("first_id", "survivor_id", "copies", *best, *unite)

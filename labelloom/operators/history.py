"""History of changing attributes from periodic snapshots.

Consecutive snapshots are compared by a null-safe full outer join, which tells
inserted, changed and deleted keys; the change events get their validity
period from the next event of the key. Numbering and lead work in two levels
(time bucket, then buckets of a key), so no task holds all rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import written

FOREVER = "9999-12-31 00:00:00"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def _bucketed(df: DataFrame, keys: list[str], at: str, bucket: str) -> DataFrame:
    return df.withColumn("__bucket", F.date_trunc(bucket, F.col(at)))


def _with_buckets(df: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` joined with one row per key and bucket, keys compared null-safely."""
    right = per_bucket.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__bucket").alias("__r_bucket"), *[c for c in per_bucket.columns if c not in (*keys, "__bucket")])
    on = F.col("__bucket") == F.col("__r_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return df.join(right, on).drop("__r_bucket", *[f"__r_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], at: str, bucket: str = "month") -> DataFrame:
    """``df`` with ``__seq``, the position of the row in its key by ``at``, from 1."""
    df = _bucketed(df, keys, at, bucket)
    inside = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(at)))
    sizes = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    return _with_buckets(inside, starts, keys).withColumn("__seq", F.col("__start") + F.col("__rn")).drop("__bucket", "__rn", "__start")


def with_lead(df: DataFrame, keys: list[str], at: str, out: str, bucket: str = "month") -> DataFrame:
    """``df`` with ``out``, the next larger ``at`` of the same key, or null."""
    df = _bucketed(df, keys, at, bucket)
    inside = df.withColumn("__next", F.lead(at).over(Window.partitionBy(*keys, "__bucket").orderBy(at)))
    firsts = df.groupBy(*keys, "__bucket").agg(F.min(at).alias("__first"))
    after = firsts.select(*keys, "__bucket", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__after"))
    return _with_buckets(inside, after, keys).withColumn(out, F.coalesce("__next", "__after")).drop("__bucket", "__next", "__after")


def change_events(df: DataFrame, keys: list[str], at: str, state: list[str], scope: str = "entity", bucket: str = "month") -> DataFrame:
    """One row per change: ``keys``, ``at``, ``state`` and ``change``.

    ``scope="entity"``: the snapshots of a key are the moments at which it was
    seen, and not being seen means nothing. ``scope="global"``: every moment in
    the data is a snapshot of all keys, and a key missing from the next one was
    deleted then.

    ``change`` is ``inserted``, ``changed`` or ``deleted`` (state null). Rows with a null
    ``at`` belong to no snapshot and are left out; null keys are a key of their
    own; null is a state value equal to itself. If rows of one key and moment
    differ, the smallest state counts (nulls first), so repeated rows change
    nothing. Other columns are not read.
    """
    rows = df.select(*keys, at, F.struct(*state).alias("__state")).filter(F.col(at).isNotNull())
    # written once: numbering reads it twice, and telling the state may be dear
    snapshots = written(rows.groupBy(*keys, at).agg(F.min("__state").alias("__state")), "states")
    if scope == "entity":
        snapshots = written(numbered(snapshots, keys, at, bucket), "snapshots")
        moments = None
    elif scope == "global":
        moments = numbered(snapshots.select(at).distinct().withColumn("__all", F.lit(0)), ["__all"], at, bucket).select(F.col(at).alias("__at"), "__seq")
        snapshots = snapshots.join(moments, F.col(at) == F.col("__at")).drop("__at")
    else:
        raise ValueError(f"scope {scope!r} is neither entity nor global")
    new = snapshots.select(*keys, at, F.col("__state").alias("__new"), F.col("__seq"))
    old = snapshots.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__state").alias("__old"), (F.col("__seq") + 1).alias("__o_seq"))
    on = F.col("__seq") == F.col("__o_seq")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    both = new.join(old, on, "full_outer")
    kind = F.when(F.col("__o_seq").isNull(), "inserted").when(F.col("__seq").isNull(), "deleted").when(~F.col("__new").eqNullSafe(F.col("__old")), "changed")
    events = both.withColumn("change", kind).filter(F.col("change").isNotNull())
    if moments is None:
        events = events.filter(F.col("change") != "deleted")
    else:
        gone = moments.select(F.col("__at").alias("__gone"), F.col("__seq").alias("__g_seq"))
        events = events.join(gone, F.col("__o_seq") == F.col("__g_seq"), "left").filter((F.col("change") != "deleted") | F.col("__gone").isNotNull())
        events = events.withColumn(at, F.coalesce(at, "__gone"))
    names = [F.when(F.col("change") == "deleted", F.col(f"__o_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return events.select(*names, at, "change", *[F.col(f"__new.{c}").alias(c) for c in state])


def history(df: DataFrame, keys: list[str], at: str, state: list[str], scope: str = "entity", bucket: str = "month") -> DataFrame:
    """Gapless versions of each key: ``keys``, ``state``, ``valid_from``, ``valid_to``.

    A version holds from the moment its state was first seen until the next
    change, or for ever (``valid_to`` null). Deleted periods have no row. See
    ``change_events`` for nulls, repeated rows and the two scopes.
    """
    events = written(change_events(df, keys, at, state, scope, bucket), "events")
    spans = with_lead(events, keys, at, "valid_to", bucket)
    return spans.filter(F.col("change") != "deleted").select(*keys, *state, F.col(at).alias("valid_from"), "valid_to")

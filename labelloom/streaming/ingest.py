"""Label chunks as a stream (an extension): late and repeated deliveries dropped, newest kept.

Not part of what the engine must match; for feeds that arrive continuously.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.snapshots import upsert


def chunk_key(columns: list[str]) -> Column:
    """What makes two deliveries the same chunk.

    The label and its text, whatever chunk_hash says, for that may be outdated.
    A filled chunk_hash counts only where the rows have no text column. Rows
    without label, text or hash are the same if their chunk_id is, and without
    that if all but loaded_at is.
    """
    filled = lambda c: F.when(F.length(F.trim(c)) > 0, F.col(c))
    content = F.sha2("text", 256) if "text" in columns else filled("chunk_hash")
    keys = [F.concat(F.lit("content "), "set_id", F.lit(" "), F.when(filled("set_id").isNotNull(), content))]
    if "chunk_id" in columns:
        keys.append(F.concat(F.lit("id "), F.col("chunk_id").cast("string")))
    rest = F.to_json(F.struct(*[c for c in columns if c != "loaded_at"]))
    return F.coalesce(*keys, F.concat(F.lit("row "), F.sha2(rest, 256)))


def chunk_stream(spark: SparkSession, folder: str, schema: str, delay: str = "7 days") -> DataFrame:
    """Parquet files of ``folder`` as a stream; the same chunk counts once within ``delay`` of loaded_at.

    ``chunk_key`` tells which chunks are the same; it is kept as a column, to merge by.
    """
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("set_id", F.lower("set_id"))
    return rows.withColumn("chunk_key", chunk_key(rows.columns)).withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["chunk_key"])


def daily_counts(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Chunks per day of loading and feed, final once the watermark has passed."""
    return stream.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", "1 day").alias("day"), "feed").agg(F.count(F.lit(1)).alias("n"))


def merge_into(path: str, keys: list[str], version: str):
    """A foreachBatch function that keeps the newest row of each key in a versioned Parquet table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/v{number:08d}"
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), version).alias("r")).select(*keys, "r.*")
        if number:
            newest = upsert(spark.read.parquet(f"{path}/v{number - 1:08d}"), newest, keys, version)
        newest.write.mode("overwrite").parquet(target)

    return merge

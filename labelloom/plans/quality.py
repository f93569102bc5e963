"""Quality assurance of the chunks of label documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.plans.extract import document, normalized_text, reading_order


def checked(chunks: DataFrame) -> DataFrame:
    """``chunks`` with norm (text without headings, folded), state (kept, duplicate or empty), new_index and new_hash.

    The first chunk of equal text in a document is kept and numbered again.
    """
    keys, order = document(chunks), reading_order(chunks)
    df = normalized_text(chunks, "norm").repartition(*keys)
    same = Window.partitionBy(*keys, "norm").orderBy(*order)
    state = F.when(F.length("norm") == 0, "empty").when(F.row_number().over(same) > 1, "duplicate").otherwise("kept")
    df = df.withColumn("state", state)
    index = F.row_number().over(Window.partitionBy(*keys, "state").orderBy(*order)) - 1
    hashed = F.sha2(F.concat_ws("\u001f", F.lower(F.coalesce("set_id", F.lit(""))), F.coalesce("section_code", F.lit("")), F.coalesce("source_path", F.lit("")), F.coalesce("norm", F.lit(""))), 256)
    return df.withColumns({"new_index": F.when(F.col("state") == "kept", index), "new_hash": F.when(F.col("state") == "kept", hashed)})


def diagnostics(chunks: DataFrame) -> DataFrame:
    """One row per document: numbers of chunks by state, sections, and the lengths of kept ones (exact quantiles, zeros if none)."""
    df = checked(chunks).withColumn("__n", F.when(F.col("state") == "kept", F.length("text")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.groupBy(*document(chunks)).agg(
        F.count_distinct(F.struct("section_code", "section_title", "subsection_title")).alias("section_count"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.col("state") == "kept").alias("unique_chunks"),
        F.count_if(F.col("state") == "duplicate").alias("duplicate_chunks"),
        F.count_if(F.col("state") == "empty").alias("empty_chunks"),
        (F.count_if(F.col("state") == "duplicate") / F.count(F.lit(1))).alias("duplicate_rate"),
        zero(F.min("__n")).alias("minimum_characters"),
        F.coalesce(F.percentile("__n", 0.5), F.lit(0.0)).alias("median_characters"),
        F.coalesce(F.percentile("__n", 0.9), F.lit(0.0)).alias("p90_characters"),
        zero(F.max("__n")).alias("maximum_characters"),
        F.count_if(F.col("__n") > 2000).alias("chunks_over_2000_characters"),
        F.count_if(F.col("__n") > 5000).alias("chunks_over_5000_characters"),
    )

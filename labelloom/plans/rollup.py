"""Evidence items merged, and rolled up to drugs and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import rules as R
from labelloom.functions import text as X
from labelloom.functions.assertion import section_key
from labelloom.plans.extract import EventPlan

UNITED = ("evidence_context", "dose_context", "temporal_context", "route_context", "mentioned_in_sections", "source_paths", "chunk_hashes")

# Notes on the limits of a result.
ABSENCE = "Absence of an event in the reviewed label sections does not establish absence of risk."
NOTE_RULES = "Drug-level status is derived only from deterministic structured SPL evidence rules."
NOTE_NO_LABEL = "No selected openFDA label was available for this drug."
NOTE_LOW = "The selected label match has low confidence."
NOTE_FALLBACK = "DailyMed SPL XML was unavailable; the same deterministic rules were applied to openFDA fallback sections."
NOTE_POSITIVE = "A label mention does not establish causality or a class-wide adverse-event relationship."
NOTE_RELATED = "A related concept was found, but the requested event was not explicitly identified."


def merge_key() -> list[Column]:
    """What two items must share, in any letter case, to be one."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    many = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    quote = F.expr(f"lower({X.collapse('coalesce(supporting_quote, \'\')')})")
    return [
        low("drug_name"), low("normalized_event"), F.col("evidence_status"), F.col("assertion"), F.col("subject"), many("route_context"), low("section_code"), low("subsection_title"),
        low("source_path"), low("chunk_hash"), quote, low("frequency_text"), low("comparator_text"), many("population_context"), many("interaction_context"),
    ]


def merge_items(items: DataFrame, order: str = "item_order") -> DataFrame:
    """One item per merge key: scalars of the first by ``order``, lists united in order of first sight, ``merged`` items each.

    Distinct values are found by aggregation before they are gathered, so a
    hot key never gathers its rows. Postmarketing-only holds if it holds in all.
    """
    keyed = items.withColumn("__k", F.sha2(F.to_json(F.struct(*merge_key()), {"ignoreNullFields": "false"}), 256))
    scalars = [c for c in items.columns if c not in (*UNITED, order, "postmarketing_only")]
    united = [c for c in UNITED if c in items.columns]
    one = keyed.groupBy("__k").agg(F.min_by(F.struct(*scalars), F.struct(order)).alias("__s"), F.min(order).alias(order), F.bool_and("postmarketing_only").alias("postmarketing_only"), F.count(F.lit(1)).alias("merged"))
    entry = lambda field: lambda v, i: F.struct(F.lit(field).alias("field"), i.alias("i"), v.alias("v"))
    each = F.flatten(F.array(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), entry(c)) for c in united]))
    values = keyed.select("__k", F.col(order).alias("__o"), F.inline(each)).filter(F.length("v") > 0)
    firsts = values.groupBy("__k", "field", "v").agg(F.min(F.struct("__o", "i")).alias("at"))
    lists = firsts.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("field", "at", "v"))).alias("__l"))
    out = one.join(lists, "__k", "left")
    pick = lambda c: F.transform(F.filter(F.coalesce("__l", F.array().cast(lists.schema["__l"].dataType)), lambda x: x["field"] == c), lambda x: x["v"])
    return out.select(order, *[F.col(f"__s.{c}").alias(c) for c in scalars], *[pick(c).alias(c) for c in united], "postmarketing_only", "merged")


def priority(status: str) -> Column:
    """Place of a status in order of priority; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in R.STATUSES]), F.col(status)), F.lit(0)), F.lit(99))


def drug_status(drugs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and evidence_status of every drug: its items' first status by priority, not_found without items."""
    best = items.groupBy(*keys).agg(F.min_by("evidence_status", priority("evidence_status")).alias("evidence_status"), F.count(F.lit(1)).alias("n_items"))
    return drugs.join(best, keys, "left").withColumns({"evidence_status": F.coalesce("evidence_status", F.lit("not_found")), "n_items": F.coalesce("n_items", F.lit(0))})


def drug_evidence(drugs: DataFrame, labels: DataFrame, items: DataFrame, plan: EventPlan, snippets: int = 10) -> DataFrame:
    """One row per drug: status, sections with evidence, the first ``snippets`` quotes and notes on limits.

    ``drugs`` has rxcui, drug_name and rank; ``labels`` one row per rxcui with
    label_match_confidence, extraction_source, spl_version,
    selected_spl_set_id, effective_time, spl_effective_time and has_chunks.
    """
    best = drug_status(drugs, items, ["rxcui"])
    order = Window.partitionBy("rxcui").orderBy("item_order")
    quotes = items.filter(F.length("supporting_quote") > 0).withColumn("section", F.coalesce(F.nullif(F.expr(section_key("section_code")), F.lit("")), F.col("section_title")))
    sections = quotes.groupBy("rxcui", "section").agg(F.min("item_order").alias("o")).groupBy("rxcui").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "section"))), lambda x: x["section"]).alias("matched_sections"))
    first = quotes.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= snippets)
    snippet = F.struct(F.col("__n").alias("n"), "section", "matched_term", F.col("supporting_quote").alias("text"), "section_code", "subsection_title", F.coalesce(F.nullif(F.col("chunk_type"), F.lit("")), F.lit("structured_evidence_item")).alias("chunk_type"), "source_path", "chunk_hash")
    shown = first.groupBy("rxcui").agg(F.array_sort(F.collect_list(snippet)).alias("evidence_snippets"))
    named = labels.withColumn("__label", F.lit(True))
    df = best.join(named, "rxcui", "left").join(sections, "rxcui", "left").join(shown, "rxcui", "left")
    s = F.col("evidence_status")
    notes = [
        F.lit(NOTE_RULES),
        F.when(F.col("__label").isNull(), NOTE_NO_LABEL).when(F.lower("label_match_confidence") == "low", NOTE_LOW).when((F.col("extraction_source") != "dailymed_spl_xml") | ~F.coalesce("has_chunks", F.lit(False)), NOTE_FALLBACK),
        F.when(s == "explicit_positive", NOTE_POSITIVE).when(s == "related_but_not_explicit", NOTE_RELATED),
        F.when(s.isin("negated", "historical_or_preexisting", "comparator_only", "not_found", "insufficient_label_data"), ABSENCE),
    ]
    return df.select(
        "drug_name", "rxcui", F.col("rank").alias("cms_rank"), "selected_spl_set_id", F.coalesce("spl_effective_time", "effective_time").alias("label_effective_time"),
        F.lit(plan.query).alias("event_query"), F.array(*[F.lit(t) for t in plan.terms]).cast("array<string>").alias("searched_terms"), "evidence_status", "n_items",
        F.coalesce("matched_sections", F.array().cast("array<string>")).alias("matched_sections"), "evidence_snippets",
        F.coalesce("label_match_confidence", F.lit("unavailable")).alias("label_match_confidence"), F.coalesce("extraction_source", F.lit("openfda_fallback")).alias("extraction_source"), "spl_version",
        F.array_distinct(F.filter(F.array(*notes), lambda n: n.isNotNull())).alias("limitations"),
    )


def class_summary(drug_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: drugs by status (all statuses, zeros included) and the class assessment."""
    counts = [F.count_if(F.col("evidence_status") == s).alias(f"n_{s}") for s in R.STATUSES]
    df = drug_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("drugs_analyzed"), *counts) if keys else drug_rows.agg(F.count(F.lit(1)).alias("drugs_analyzed"), *counts)
    n, explicit = F.col("drugs_analyzed"), F.col("n_explicit_positive")
    assessment = (
        F.when((n == 0) | (2 * F.col("n_insufficient_label_data") > n), "insufficient_class_evidence")
        .when((explicit >= 2) & (3 * explicit >= 2 * n), "consistent_label_evidence")
        .when(explicit >= 1, "partial_or_mixed_label_evidence")
        .otherwise("no_explicit_mentions_found")
    )
    spread = F.map_from_arrays(F.array(*[F.lit(s) for s in R.STATUSES]), F.array(*[F.col(f"n_{s}") for s in R.STATUSES]))
    return df.withColumns({"class_assessment": assessment, "evidence_distribution": spread})

"""The library's entry point: drugs, labels and chunks to items, drug rows and a class row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import rules as R
from labelloom.functions import text as X
from labelloom.plans import discover, evaluate, extract, rollup
from labelloom.session import if_small, written


@dataclass
class Analysis:
    items: DataFrame
    drugs: DataFrame
    summary: DataFrame


@dataclass
class Run:
    """A whole run: ranked usage, the representative drugs, their analysis, and the counts of its items."""

    usage: DataFrame
    selected: DataFrame
    analysis: Analysis
    counters: DataFrame


def fallback_chunks(labels: DataFrame) -> DataFrame:
    """Chunks of labels without parsed XML, from their ``sections`` map in fixed order of keys; empty sections give none."""
    rows = ", ".join(f"named_struct('i', {i}, 'k', {X.lit(k)}, 'c', {X.lit(R.FALLBACK_CODES[k])}, 'n', {X.lit(R.SECTIONS[R.FALLBACK_CODES[k]][1])})" for i, k in enumerate(R.FALLBACK_KEYS))
    df = labels.withColumn("__x", F.explode(F.expr(f"array({rows})"))).withColumn("text", F.expr(X.collapse("sections[__x.k]"))).filter(F.length("text") > 0)
    df = df.withColumns({"set_id": F.coalesce("selected_spl_set_id", F.lit("openfda-set-id-unavailable")), "source_path": F.concat(F.lit("/openfda/sections/"), F.col("__x.k"))})
    df = df.withColumn("__n", extract.fold_parts("text"))
    return df.select(
        "rxcui", "set_id", F.col("spl_version").alias("version"), F.coalesce("spl_effective_time", "effective_time").alias("effective_time"), F.col("__x.c").alias("section_code"),
        F.initcap(F.replace(F.col("__x.k"), F.lit("_"), F.lit(" "))).alias("section_title"), F.col("__x.n").alias("loinc_display_name"), F.lit(None).cast("string").alias("subsection_title"), F.lit("section_text").alias("chunk_type"), F.col("__x.i").alias("chunk_index"),
        "text", F.array().cast("array<string>").alias("column_headers"), F.array().cast("array<string>").alias("row_cells"), "source_path", F.sha2(F.concat_ws("|", "set_id", "__x.c", "source_path", "__n"), 256).alias("chunk_hash"),
    )


def product_context(drugs: DataFrame, labels: DataFrame) -> DataFrame:
    """rxcui, drug_name, drug_names and product_context (distinct names of drug and label)."""
    df = drugs.join(labels.select("rxcui", "requested_name", "generic_names", "brand_names", "substance_names", "selected_label_product"), "rxcui", "left")
    none = F.array().cast("array<string>")
    names = F.concat(F.array("drug_name", "requested_name"), *[F.coalesce(c, none) for c in ("cms_generic_names", "generic_names", "brand_names", "substance_names")], F.coalesce(F.map_values("selected_label_product"), none))
    clean = F.array_distinct(F.filter(F.transform(names, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: F.length(v) > 0))
    return df.select("rxcui", "drug_name", F.concat(F.array("drug_name"), F.coalesce("cms_generic_names", none)).alias("drug_names"), F.array_join(clean, " ").alias("product_context"))


def analyze(drugs: DataFrame, labels: DataFrame, chunks: DataFrame, event: str) -> Analysis:
    """Items, drug rows and the class row of an event.

    ``drugs``: rxcui, drug_name, cms_generic_names, rank. ``labels``: one row
    per rxcui (see ``rollup.drug_evidence``, ``fallback_chunks`` and
    ``product_context`` for its columns). ``chunks``: chunks with set_id. A
    drug without a label, with a low-confidence label or without any chunk
    gets one placeholder item and is insufficient_label_data; a completed
    search without a mention is not_found.
    """
    plan = extract.event_plan(event)
    usable = labels.filter(F.coalesce(F.lower("label_match_confidence") != "low", F.lit(False)))
    parsed = usable.filter(F.col("extraction_source") == "dailymed_spl_xml").select("rxcui", F.lower("selected_spl_set_id").alias("__set"))
    own = extract.parent_context(extract.searchable(chunks)).join(if_small(parsed), F.lower("set_id") == F.col("__set")).drop("__set")
    other = fallback_chunks(usable.filter(F.col("extraction_source") != "dailymed_spl_xml"))
    other = other.withColumns({"section_key": F.expr(extract.A.section_key("section_code")), "pos": F.col("chunk_index"), "parent_context": F.lit(None).cast("string")})
    wanted = [c for c in other.columns if c in own.columns]
    every = own.select(*wanted).unionByName(other.select(*wanted))
    named = product_context(drugs, labels)
    every = written(every, "chunks")  # searched for the event, and for the drugs that have any
    found = written(extract.items(every, [plan], named, "rxcui"), "items")  # merging reads the items twice
    searched = every.select("rxcui").distinct().withColumn("__searched", F.lit(True))
    lacking = drugs.join(searched, "rxcui", "left").filter(F.col("__searched").isNull())
    event_name = F.lit(plan.event)
    placeholder = {"normalized_event": event_name, "matched_term": event_name, "evidence_status": F.lit("insufficient_label_data"), "assertion": F.lit("uncertain"), "subject": F.lit("unclear"), "extraction_confidence": F.lit("low"), "postmarketing_only": F.lit(False)}
    merged = rollup.merge_items(found)
    # one placeholder a drug, so they aren't merged: drugs of the same name keep theirs apart
    columns = [
        (placeholder[f.name] if f.name in placeholder else F.lit(1) if f.name == "merged" else F.col(f.name) if f.name in ("rxcui", "drug_name") else F.lit("") if f.name == "supporting_quote" else F.array() if f.dataType.typeName() == "array" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in merged.schema
    ]
    items = merged.unionByName(lacking.select(*columns))
    has = searched.withColumnRenamed("__searched", "has_chunks")
    rows = rollup.drug_evidence(drugs, labels.join(has, "rxcui", "left"), items, plan)
    return Analysis(items, rows, rollup.class_summary(rows, []))


def run(members: DataFrame, usage: DataFrame, labels: DataFrame, chunks: DataFrame, event: str, top: int = 3) -> Run:
    """From a class's members to its class row: usage matched by name and ranked, the ``top`` drugs, their labels searched for the event.

    ``members``: rxcui, name, tty. ``usage``: generic_name, claims,
    beneficiaries. ``labels`` and ``chunks`` as in ``analyze``.
    """
    ranked = written(discover.usage_by_member(members, usage), "usage")
    selected = discover.representatives(ranked, top)
    drugs = selected.select("rxcui", F.col("name").alias("drug_name"), F.col("generic_names").alias("cms_generic_names"), "rank")
    result = analyze(drugs, labels, chunks, event)
    return Run(ranked, selected, result, evaluate.result_counters(result.items))

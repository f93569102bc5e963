"""Predictions scored against reviewed cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import rules as R
from labelloom.functions import text as X
from labelloom.plans.extract import EVENT_OF, event_plan
from labelloom.plans.rollup import priority

# Orders of preference of a case's primary item.
SUBJECTS = ("selected_drug", "general_class_statement", "concomitant_drug", "comparator", "patient_history", "unclear")
CONTEXTS = ("boxed_warning", "warning", "adverse_reaction", "contraindication", "drug_interaction", "general_safety_statement")
LAST = 2**31 - 1


def place(values: tuple[str, ...], column: Column) -> Column:
    """Position in a list of preferences, from 0; 99 if it isn't there."""
    found = F.array_position(F.array(*[F.lit(v) for v in values]), column)
    return F.when(F.coalesce(found, F.lit(0)) > 0, found - 1).otherwise(99).cast("int")


def quote_incomplete(quote: Column) -> Column:
    """1 for a quote that is blank, begins in the middle or closes more brackets than it opens."""
    count = lambda c: F.length(quote) - F.length(F.replace(quote, F.lit(c), F.lit("")))
    first = F.substring(F.trim(quote), 1, 1)
    broken = (F.length(F.trim(quote)) == 0) | first.rlike(r"^[\p{Ll}\)\]},;:]") | (count(")") > count("(")) | (count("]") > count("["))
    return F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0)


def path_indices(path: Column) -> Column:
    """The numbers in brackets of a path; a path without any comes last."""
    found = F.transform(F.regexp_extract_all(path, F.lit(r"\[([0-9]+)\]"), 1), lambda x: x.try_cast("int"))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(LAST)))


def case_terms(query: Column) -> Column:
    """``direct`` and ``searched`` terms of an event query as in ``event_plan``."""
    wanted = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))
    terms = lambda direct, searched: F.struct(direct.alias("direct"), searched.alias("searched"))
    array = lambda values: F.array(*[F.lit(v) for v in values])
    own = F.when(F.length(wanted) > 0, F.array(wanted)).otherwise(F.array().cast("array<string>"))
    table = [c for t in EVENT_OF for c in (F.lit(t), terms(array(event_plan(t).direct), array(event_plan(t).terms)))]
    return F.coalesce(F.try_element_at(F.create_map(*table), wanted), terms(own, own))


def classification_supported(p: str = "") -> Column:
    """Whether an item's quote or fields bear out its status; ``p`` is the item's struct with a point."""
    says = lambda *words: "(" + " or ".join(f"contains(lower({p}supporting_quote), {X.lit(w)})" for w in words) + ")"
    return F.expr(
        f"""coalesce(case {p}evidence_status when 'negated' then {says("no cases", "not observed", "none observed")}
        when 'historical_or_preexisting' then {says("pre-existing", "preexisting", "history of")}
        when 'comparator_only' then {says("placebo", "comparator", "control")}
        when 'interaction_dependent' then coalesce(size({p}interaction_context) > 0, false) or coalesce(array_contains({p}evidence_context, 'drug_interaction'), false)
        when 'explicit_positive' then {p}assertion = 'present' and length({p}matched_term) > 0
        when 'related_but_not_explicit' then {p}assertion = 'uncertain' and length({p}matched_term) > 0 else true end, false)"""
    )


def direct_statement() -> Column:
    """0 if a clause of the quote names the drug and a direct term, 2 for other interactions and conditions, else 1."""
    both = f"exists(split(supporting_quote, {X.lit('(?U)(?<=[.!?;])\\s+')}), c -> c rlike {X.term_pattern('drug_name')} and exists(__terms.direct, t -> c rlike {X.term_pattern('t')}))"
    return F.expr(f"case when {both} then 0 when evidence_status = 'interaction_dependent' or assertion = 'conditional' or size(interaction_context) > 0 then 2 else 1 end")


def selection_key(order: str, source_text: str | None = None) -> Column:
    """Key by which the primary item of a case is the smallest.

    In this order: status, direct term, confidence, subject, context,
    traceability, wholeness, direct statement, path, place of the quote in
    ``source_text`` (last without one), chunk index (the path's last number),
    path as text, ``order``. ``__terms`` holds the terms of the case.
    """
    holds = lambda text, list_: F.coalesce(F.length(text) > 0, F.lit(False)) | F.coalesce(F.size(list_) > 0, F.lit(False))
    quote = F.coalesce("supporting_quote", F.lit(""))
    path = F.coalesce(F.nullif("source_path", F.lit("")), F.get("source_paths", F.lit(0)), F.lit(""))
    context = F.coalesce(F.array_min(F.transform("evidence_context", lambda c: place(CONTEXTS, c))), F.lit(99))
    checks = [
        F.length(F.trim(quote)) > 0,
        holds(F.col("source_path"), F.col("source_paths")),
        holds(F.col("chunk_hash"), F.col("chunk_hashes")),
        F.exists("__terms.searched", lambda t: F.contains(F.lower(quote), t)),
        classification_supported(),
    ]
    at = F.lit(0)
    if source_text:
        flat = lambda c: F.expr(f"lower({X.collapse(c)})")
        at = F.when(F.length(flat("supporting_quote")) > 0, F.instr(flat(source_text), flat("supporting_quote")))
    return F.struct(
        priority("evidence_status").alias("a"),
        F.when(F.array_contains("__terms.direct", F.lower("matched_term")), 0).otherwise(1).alias("b"),
        place(R.CONFIDENCES, F.col("extraction_confidence")).alias("c"),
        place(SUBJECTS, F.col("subject")).alias("d"),
        context.alias("e"),
        (-sum(c.cast("int") for c in checks)).alias("f"),
        quote_incomplete(F.col("supporting_quote")).alias("g"),
        direct_statement().alias("h"),
        path_indices(path).alias("i"),
        F.when(at > 0, at).otherwise(LAST).alias("j"),
        F.element_at(path_indices(path), -1).alias("k"),
        path.alias("l"),
        F.col(order).alias("m"),
    )


def primary_items(cases: DataFrame, items: DataFrame, keys: list[str], order: str, query: str = "event_query") -> DataFrame:
    """Every case with its primary item in ``item`` (null without items), chosen without looking at the expected values.

    Direct and searched terms are those of the case's ``query``. Candidates are
    reduced by partial aggregation, so a case with many items needs no more memory.
    """
    cases = cases.withColumn("__query", F.coalesce(query, F.lit("")))
    wanted = cases.select(*keys, "__query").distinct().withColumn("__terms", case_terms(F.col("__query")))
    key = selection_key(order, "source_text" if "source_text" in items.columns else None)
    best = items.join(wanted, keys).groupBy(*keys, "__query").agg(F.min_by(F.struct(*[c for c in items.columns if c not in keys]), key).alias("item"), F.count(F.lit(1)).alias("n_items"))
    return cases.join(best, [*keys, "__query"], "left").drop("__query")


def quote_match(expected: Column, predicted: Column) -> Column:
    """matched, or why a quote isn't scored or doesn't match."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return (
        F.when(F.length(fold(expected)) == 0, "not_scored_no_expected_supporting_quote")
        .when(F.length(fold(predicted)) == 0, "predicted_supporting_quote_missing")
        .when(F.contains(fold(predicted), fold(expected)), "matched")
        .otherwise("expected_quote_not_fully_contained")
    )


def same_set(left: Column, right: Column) -> Column:
    """Whether two arrays hold the same values; null and empty are alike."""
    sorted_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return sorted_set(left) == sorted_set(right)


def confusion(scored: DataFrame, expected: str, predicted: str) -> DataFrame:
    """expected, predicted and n of every pair of statuses, zeros included."""
    spark = scored.sparkSession
    labels = spark.createDataFrame([(s, t) for s in R.STATUSES for t in R.STATUSES], "expected string, predicted string")
    counts = scored.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def status_metrics(matrix: DataFrame) -> DataFrame:
    """support, precision, recall and f1 per status; null where a denominator is zero."""
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("expected").alias("status")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    columns = matrix.groupBy(F.col("predicted").alias("status")).agg(F.sum("n").alias("predicted_n"))
    df = rows.join(columns, "status").withColumns({"precision": F.try_divide("tp", "predicted_n"), "recall": F.try_divide("tp", "support")})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return df.select("status", "support", "precision", "recall", f1.alias("f1"))


def identity(fixed_version: Column, fixed_time: Column, actual_version: Column, actual_time: Column) -> Column:
    """Whether a declared label version is the one at hand; dates count by their first eight digits."""
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    day = lambda c: F.when(F.length(digits(c)) >= 8, F.left(digits(c), F.lit(8)))
    version = F.nullif(F.trim(fixed_version), F.lit(""))
    return (
        F.when(version.isNull(), "missing_fixed_spl_version")
        .when(~F.coalesce(F.trim(actual_version), F.lit("")).eqNullSafe(version), "fixed_spl_version_unavailable")
        .when(day(fixed_time).isNotNull() & day(actual_time).isNull(), "fixed_spl_effective_time_unavailable")
        .when(day(fixed_time) != day(actual_time), "fixed_spl_effective_time_mismatch")
        .otherwise("fixed_spl_version_verified")
    )


def same_value(left: Column, right: Column) -> Column:
    """Whether two texts agree; null and empty are alike."""
    return F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit(""))


def section_folded(text: Column) -> Column:
    """Letters and digits in lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def section_matches(item: str, expected: str) -> Column:
    """Whether the expected section is named by an item's section, subsection or mentions; without an item, whether none was expected."""
    whole = F.concat_ws(" ", F.coalesce(f"{item}.section_title", F.lit("")), F.coalesce(f"{item}.subsection_title", F.lit("")), F.coalesce(f"{item}.mentioned_in_sections", F.array().cast("array<string>")))
    wanted = section_folded(F.coalesce(expected, F.lit("")))
    return F.when(F.col(item).isNull(), F.col(expected).isNull()).otherwise((F.length(wanted) > 0) & F.contains(section_folded(whole), wanted))


def traceability(terms: str = "searched", prefix: str = "") -> Column:
    """The six checks of an item, as a struct of booleans; ``terms`` is the array of searched terms, ``prefix`` the item's struct with a point."""
    at = lambda c: F.col(prefix + c)
    filled = lambda one, many: F.coalesce(F.length(at(one)) > 0, F.lit(False)) | F.coalesce(F.size(at(many)) > 0, F.lit(False))
    quote = F.coalesce(at("supporting_quote"), F.lit(""))
    return F.struct(
        (F.length(F.trim(quote)) > 0).alias("supporting_quote"),
        filled("source_path", "source_paths").alias("source_path"),
        filled("chunk_hash", "chunk_hashes").alias("chunk_hash"),
        F.coalesce(F.length(F.trim("set_id")) > 0, F.lit(False)).alias("set_id"),
        F.exists(terms, lambda t: F.contains(F.lower(quote), t)).alias("event_or_synonym"),
        classification_supported(prefix).alias("classification_supported"),
    )


def all_hold(checks: str) -> Column:
    names = ("supporting_quote", "source_path", "chunk_hash", "set_id", "event_or_synonym", "classification_supported")
    out = F.lit(True)
    for name in names:
        out = out & F.col(f"{checks}.{name}")
    return out


def case_scores(predictions: DataFrame, query: str = "event_query") -> DataFrame:
    """``predictions`` (cases with their primary ``item``) with one boolean per compared field and the item's traceability.

    The cases have the expected_ fields of the reviewed cases and set_id. A
    case without an item is predicted ``not_found``. Fields that no reviewer
    filled agree with empty ones; traceability is null where nothing was found.
    """
    df = predictions.withColumn("searched", case_terms(F.col(query))["searched"])
    status = F.coalesce("item.evidence_status", F.when(F.col("item").isNull(), "not_found"))
    df = df.withColumns({"predicted_status": status, "checks": F.when(F.col("item").isNotNull() & ~F.coalesce("item.evidence_status", F.lit("")).isin("not_found", "insufficient_label_data"), traceability("searched", "item."))})
    text = lambda name: same_value(F.col(f"item.{name}"), F.col(f"expected_{name}"))
    quote = quote_match(F.col("expected_supporting_quote"), F.col("item.supporting_quote"))
    return df.withColumns(
        {
            "status_correct": same_value(F.col("predicted_status"), F.col("expected_status")),
            "assertion_correct": text("assertion"),
            "subject_correct": text("subject"),
            "context_correct": same_set(F.col("item.evidence_context"), F.col("expected_context")),
            "frequency_correct": text("frequency_text"),
            "comparator_correct": text("comparator_text"),
            "section_correct": section_matches("item", "expected_section"),
            "quote_match": quote,
            "traceable": F.when(F.col("checks").isNotNull(), all_hold("checks")),
        }
    )


def accuracy(correct: str, where: Column | None = None) -> Column:
    """Share of rows that are correct among those that count; null if none do."""
    flag = F.col(correct).cast("double")
    return F.avg(F.when(where, flag) if where is not None else flag)


def summary(scores: DataFrame) -> DataFrame:
    """One row of figures over the scored cases; null where nothing counts."""
    expected = F.col("expected_status")
    return scores.agg(
        F.count(F.lit(1)).alias("cases"),
        accuracy("status_correct").alias("micro_f1"),
        accuracy("status_correct", expected == "negated").alias("negation_accuracy"),
        accuracy("status_correct", expected == "interaction_dependent").alias("interaction_accuracy"),
        accuracy("assertion_correct").alias("assertion_accuracy"),
        accuracy("subject_correct").alias("subject_accuracy"),
        accuracy("context_correct").alias("context_accuracy"),
        accuracy("frequency_correct", F.coalesce("score_frequency", F.lit(False))).alias("frequency_accuracy"),
        accuracy("comparator_correct", F.coalesce("score_comparator", F.lit(False))).alias("comparator_accuracy"),
        accuracy("section_correct", F.length("expected_section") > 0).alias("section_accuracy"),
        F.avg(F.when(F.col("quote_match") != "not_scored_no_expected_supporting_quote", (F.col("quote_match") == "matched").cast("double"))).alias("quote_accuracy"),
        F.avg(F.col("checks.source_path").cast("double")).alias("source_path_completeness"),
        F.avg(F.col("checks.supporting_quote").cast("double")).alias("quote_completeness"),
        accuracy("traceable").alias("traceability"),
    )


def macro_f1(metrics: DataFrame) -> DataFrame:
    """Mean F1 (``status_macro_f1``) of ``status_metrics`` over statuses with support; a status without an F1 is skipped."""
    return metrics.filter("support > 0").agg(F.avg("f1").alias("status_macro_f1"))


def unsupported_positives(items: DataFrame) -> DataFrame:
    """Number of explicit positives that fail a check; ``items`` has ``searched``, the terms of its case."""
    return items.filter("evidence_status = 'explicit_positive'").withColumn("checks", traceability()).agg(F.count_if(~all_hold("checks")).alias("unsupported_positive_count"))


TIMES_LEFT_OUT = ("created_at", "retrieved_at", "timestamp")


def determinism(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """``keys`` and whether all runs gave the same rows, times left out; a key that a run lacks isn't deterministic.

    Rows are hashed and the hashes added, so no group is gathered.
    """
    hashed = []
    for i, run in enumerate(runs):
        columns = sorted(c for c in run.columns if c not in (*keys, *TIMES_LEFT_OUT))
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        part = lambda at: F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(20,0)")  # noqa: B023, E731
        hashed.append(run.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b")).withColumn("run", F.lit(i)))
    every = hashed[0]
    for one in hashed[1:]:
        every = every.unionByName(one)
    same = (F.count(F.lit(1)) == len(runs)) & (F.count_distinct(F.struct("n", "a", "b")) == 1)
    return every.groupBy(*keys).agg(same.alias("deterministic"))


AXES = {
    "explicit_positive": "expected_status = 'explicit_positive'",
    "interaction_or_conditional": "expected_status = 'interaction_dependent' or expected_assertion = 'conditional'",
    "negation_historical_or_comparator": "expected_status in ('negated', 'historical_or_preexisting', 'comparator_only')",
    "frequency_or_comparator": "score_frequency or score_comparator",
    "not_found": "expected_status = 'not_found' or benchmark_group = 'not_found'",
}


def completeness(cases: DataFrame, evaluated: DataFrame, id_column: str) -> DataFrame:
    """One row: cases, those reviewed, evaluated and neither, the coverage of each axis by evaluated cases, and the axes without any.

    ``evaluated`` has the ids of the cases that could be evaluated; it is a
    set, so repeated ids count once.
    """
    ids = evaluated.select(id_column).distinct().withColumn("__evaluated", F.lit(True))
    df = cases.join(ids, id_column, "left").withColumns({"__done": F.coalesce("gold_review_complete", F.lit(False)), "__evaluated": F.coalesce("__evaluated", F.lit(False))})
    eligible = F.col("__done") & F.col("__evaluated")
    axes = {name: F.count_if(eligible & F.coalesce(F.expr(rule), F.lit(False))) for name, rule in AXES.items()}
    row = df.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("__done").alias("completed"), F.count_if(~F.col("__done")).alias("needing_review"), F.count_if(eligible).alias("evaluated"), F.count_if(F.col("__done") & ~F.col("__evaluated")).alias("not_evaluated"),
        *[c.alias(name) for name, c in axes.items()],
    )
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(name) == 0, name) for name in AXES]), lambda a: a.isNotNull()), "|")
    return row.withColumn("missing_axes", missing)


def scenario_results(scenarios: DataFrame, statuses: DataFrame) -> DataFrame:
    """Reviewed class scenarios with their assessment: evaluated, reason, predicted and correct.

    ``scenarios``: scenario_id, event, expected_class_assessment,
    gold_review_complete and drugs (array of struct with rxcui and state, the
    identity of the drug's label). A scenario with a label that isn't verified
    isn't evaluated; the first such state is the reason. ``statuses``: event,
    rxcui and evidence_status of drugs with items; a drug without is not_found.
    """
    from labelloom.plans.rollup import class_summary

    done = scenarios.filter("gold_review_complete")
    bad = F.get(F.filter("drugs", lambda d: d["state"] != "fixed_spl_version_verified"), F.lit(0))["state"]
    done = done.withColumn("reason", bad)
    drugs = done.filter("reason is null").select("scenario_id", "event", F.inline("drugs")).drop("state")
    rows = drugs.join(statuses, ["event", "rxcui"], "left").withColumn("evidence_status", F.coalesce("evidence_status", F.lit("not_found")))
    found = class_summary(rows, ["scenario_id"]).select("scenario_id", F.col("class_assessment").alias("predicted"))
    df = done.join(found, "scenario_id", "left")
    return df.select("scenario_id", F.col("reason").isNull().alias("evaluated"), "reason", "expected_class_assessment", "predicted", F.coalesce(F.col("predicted") == F.col("expected_class_assessment"), F.lit(False)).alias("correct"))


def metric_text(value: Column) -> Column:
    """A figure with three decimals, N/A if there is none."""
    return F.when(value.isNull() | F.isnan(value), "N/A").otherwise(F.format_string("%.3f", value))


def result_counters(items: DataFrame) -> DataFrame:
    """Items before and after merging (``merged`` of each), and how many are positive, negated or depend on an interaction."""
    of = lambda status: F.count_if(F.col("evidence_status") == status)
    return items.agg(
        F.coalesce(F.sum("merged"), F.lit(0)).alias("items_before_merge"), F.count(F.lit(1)).alias("items"), of("explicit_positive").alias("positive"), of("negated").alias("negated"), of("interaction_dependent").alias("interaction_dependent")
    )

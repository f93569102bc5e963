"""Queries of the evaluation against reviewed cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.plans import evaluate, rollup
from labelloom.queries.labels import CHECKS, EVIDENCE, GOLD, MATRIX, PRIORITY, evidence, gold_predictions, query, scored
from labelloom.session import load, written

FLAGS = ("status", "assertion", "subject", "context", "frequency", "comparator", "section")
_same = lambda a, b: f"coalesce({a}, '') = coalesce({b}, '')"
_fold = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_flat = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
_none = "coalesce(trim(expected_supporting_quote), '') = ''"
SCORES = f"""{EVIDENCE}, {GOLD}, sc as (select *, case when item_id is null then 'not_found' else evidence_status end predicted_status, item_id is not null and coalesce(evidence_status, '') not in ('not_found', 'insufficient_label_data') traced,
  {_same("case when item_id is null then 'not_found' else evidence_status end", 'expected_status')} status_correct, {_same('assertion', 'expected_assertion')} assertion_correct, {_same('subject', 'expected_subject')} subject_correct,
  list_sort(list_distinct(coalesce(evidence_context, []))) = list_sort(list_distinct(coalesce(expected_context, []))) context_correct, {_same('frequency_text', 'expected_frequency_text')} frequency_correct, {_same('comparator_text', 'expected_comparator_text')} comparator_correct,
  case when item_id is null then expected_section is null else length({_fold("coalesce(expected_section, '')")}) > 0 and contains({_fold("concat_ws(' ', coalesce(section_title, ''), coalesce(subsection_title, ''), array_to_string(coalesce(mentioned_in_sections, []), ' '))")}, {_fold("coalesce(expected_section, '')")}) end section_correct,
  case when {_none} then null when coalesce(trim(supporting_quote), '') = '' then false else contains({_flat('supporting_quote')}, {_flat('expected_supporting_quote')}) end quote_correct from best where gold_review_complete),
sd as (select *, case when traced then {' and '.join(f'has_{c}' for c in CHECKS)} and has_set_id end traceable from sc)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.case_scores(gold_predictions(spark, sf_dir).filter("gold_review_complete"))


@query(f"with {SCORES} select case_no, item_id, predicted_status, {', '.join(f'{f}_correct' for f in FLAGS)}, traceable from sd")
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reviewed case with its prediction, compared field by field, and whether the prediction can be traced."""
    return scores(spark, sf_dir).select("case_no", F.col("item.item_id").alias("item_id"), "predicted_status", *[f"{f}_correct" for f in FLAGS], "traceable")


_avg = lambda c, where="true": f"avg(({c})::int) filter ({where})"


@query(
    f"""with {SCORES} select count(*) cases, {_avg('status_correct')} micro_f1, {_avg('status_correct', "expected_status = 'negated'")} negation_accuracy, {_avg('status_correct', "expected_status = 'interaction_dependent'")} interaction_accuracy,
  {_avg('assertion_correct')} assertion_accuracy, {_avg('subject_correct')} subject_accuracy, {_avg('context_correct')} context_accuracy, {_avg('frequency_correct', 'score_frequency')} frequency_accuracy, {_avg('comparator_correct', 'score_comparator')} comparator_accuracy,
  {_avg('section_correct', 'length(expected_section) > 0')} section_accuracy, {_avg('quote_correct', 'quote_correct is not null')} quote_accuracy, {_avg('has_source_path', 'traced')} source_path_completeness, {_avg('has_supporting_quote', 'traced')} quote_completeness, {_avg('traceable', 'traced')} traceability from sd"""
)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro figures, accuracies by kind of case, completeness and traceability over all reviewed cases."""
    return evaluate.summary(scores(spark, sf_dir))


@query(
    f"""with {EVIDENCE}, {MATRIX}, r as (select expected s, sum(n) support, sum(n) filter (expected = predicted) tp from m group by 1), c as (select predicted s, sum(n) pn from m group by 1), x as (select case when pn > 0 then tp / pn end pr, tp / support re from r join c using (s) where support > 0)
select avg(case when pr + re > 0 then 2 * pr * re / (pr + re) end) status_macro_f1 from x"""
)
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean F1 over statuses with cases; statuses without an F1 are skipped."""
    return evaluate.macro_f1(evaluate.status_metrics(evaluate.confusion(scored(spark, sf_dir), "expected", "predicted")))


@query(f"with {EVIDENCE}, {GOLD} select count(*) filter (not ({' and '.join(f'has_{c}' for c in CHECKS)} and has_set_id)) unsupported_positive_count from p where evidence_status = 'explicit_positive'")
def unsupported_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit positives of all cases' items that fail a check."""
    gold = load(spark, sf_dir, "gold_case").select("case_no", F.lower(F.trim("normalized_event")).alias("normalized_event"), F.lower("spl_set_id").alias("set_id"), evaluate.case_terms(F.col("event_query"))["searched"].alias("searched"))
    return evaluate.unsupported_positives(evidence(spark, sf_dir).join(gold, ["set_id", "normalized_event"]))


_axis = lambda rule: f"count(*) filter (done and has and ({rule}))"


@query(
    f"""with {EVIDENCE}, c as (select *, coalesce(gold_review_complete, false) done, exists (select 1 from evidence e where e.set_id = lower(spl_set_id)) has from gold_case),
a as (select count(*) cases, count(*) filter (done) completed, count(*) filter (not done) needing_review, count(*) filter (done and has) evaluated, count(*) filter (done and not has) not_evaluated, {', '.join(f'{_axis(r)} {n}' for n, r in evaluate.AXES.items())} from c)
select *, concat_ws('|', {', '.join(f"case when {n} = 0 then '{n}' end" for n in evaluate.AXES)}) missing_axes from a"""
)
def gold_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases are reviewed and have evidence, and which axes they cover."""
    cases = load(spark, sf_dir, "gold_case")
    with_items = cases.withColumn("set_id", F.lower("spl_set_id")).join(evidence(spark, sf_dir).select("set_id"), "set_id", "left_semi")
    return evaluate.completeness(cases, with_items, "case_no")


@query("select distinct lower(set_id) set_id, true deterministic from evidence_item")
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of the merge over differently partitioned items give every label the same items."""
    items = evidence(spark, sf_dir).drop("item_id")
    runs = [rollup.merge_items(items.repartition(n, "item_order") if n else items) for n in (0, 3, 7)]
    return evaluate.determinism(runs, ["set_id"])


@query(f"with {EVIDENCE} select count(*) n, count(*) filter (evidence_status = 'explicit_positive') positive, count(*) filter (evidence_status = 'negated') negated, count(*) filter (evidence_status = 'interaction_dependent') interaction_dependent from evidence")
def result_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a run in all and by kind."""
    counters = evaluate.result_counters(evidence(spark, sf_dir).withColumn("merged", F.lit(1)))
    return counters.select(F.col("items").alias("n"), "positive", "negated", "interaction_dependent")


SCENARIOS = f"""{EVIDENCE}, sn as (select concat(benchmark_group, ':', lower(trim(normalized_event))) scenario_id, lower(trim(normalized_event)) ev, min(case_no) first_case, bool_or(gold_review_complete) gold_review_complete from gold_case group by all),
sdg as (select distinct concat(benchmark_group, ':', lower(trim(normalized_event))) scenario_id, lower(trim(normalized_event)) ev, rxcui, case when expected_status = 'not_found' then 'missing_fixed_spl_version' else 'fixed_spl_version_verified' end st from gold_case),
stt as (select normalized_event ev, rxcui, arg_min(evidence_status, {PRIORITY.replace("nullif(lower(trim(evidence_status)), '')", 'evidence_status')}) evidence_status from evidence group by all),
cnt as (select scenario_id, count(*) n, count(*) filter (coalesce(evidence_status, 'not_found') = 'explicit_positive') x, count(*) filter (evidence_status = 'insufficient_label_data') i from sdg left join stt using (ev, rxcui) group by scenario_id),
bad as (select scenario_id, min(st) reason from sdg where st <> 'fixed_spl_version_verified' group by scenario_id)"""


@query(
    f"""with {SCENARIOS}, z as (select sn.scenario_id, reason, case when first_case % 2 = 0 then 'partial_or_mixed_label_evidence' else 'no_explicit_mentions_found' end expected_class_assessment,
  case when reason is null then case when 2 * i > n then 'insufficient_class_evidence' when x >= 2 and 3 * x >= 2 * n then 'consistent_label_evidence' when x >= 1 then 'partial_or_mixed_label_evidence' else 'no_explicit_mentions_found' end end predicted
  from sn join cnt using (scenario_id) left join bad using (scenario_id) where gold_review_complete) select scenario_id, reason is null evaluated, reason, expected_class_assessment, predicted, coalesce(predicted = expected_class_assessment, false) correct from z"""
)
def class_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios of a group's drugs and an event: the predicted assessment against the expected one; a label that isn't verified leaves its scenario out."""
    gold = load(spark, sf_dir, "gold_case").withColumn("event", F.lower(F.trim("normalized_event")))
    state = F.when(F.col("expected_status") == "not_found", "missing_fixed_spl_version").otherwise("fixed_spl_version_verified")
    drugs = F.array_sort(F.collect_set(F.struct("rxcui", state.alias("state"))))
    scenarios = gold.groupBy(F.concat_ws(":", "benchmark_group", "event").alias("scenario_id"), "event").agg(drugs.alias("drugs"), F.min("case_no").alias("first"), F.bool_or("gold_review_complete").alias("gold_review_complete"))
    scenarios = scenarios.withColumn("expected_class_assessment", F.when(F.col("first") % 2 == 0, "partial_or_mixed_label_evidence").otherwise("no_explicit_mentions_found"))
    items = evidence(spark, sf_dir)
    statuses = items.groupBy(F.col("normalized_event").alias("event"), "rxcui").agg(F.min_by("evidence_status", rollup.priority("evidence_status")).alias("evidence_status"))
    return evaluate.scenario_results(scenarios, written(statuses, "statuses"))


@query(
    f"""with {SCORES}, f as (select unnest(['micro', 'negated', 'frequency']) metric, unnest([avg(status_correct::int), avg(status_correct::int) filter (expected_status = 'negated'), avg(frequency_correct::int) filter (expected_status = 'no such status')]) v from sd)
select metric, case when v is null then 'N/A' else printf('%.3f', v) end shown from f"""
)
def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures as they are reported: three decimals, N/A without cases."""
    row = scores(spark, sf_dir).agg(evaluate.accuracy("status_correct").alias("micro"), evaluate.accuracy("status_correct", F.col("expected_status") == "negated").alias("negated"), evaluate.accuracy("frequency_correct", F.col("expected_status") == "no such status").alias("frequency"))
    return row.unpivot([], ["micro", "negated", "frequency"], "metric", "v").select("metric", evaluate.metric_text(F.col("v")).alias("shown"))


def queries() -> dict:
    """Registered with those of ``labels``."""
    return {}


def oracle_sql() -> dict[str, str]:
    return {}

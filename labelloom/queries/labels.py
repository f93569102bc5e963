"""Queries of the label-evidence operators over the label tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions import assertion as A
from labelloom.functions import numeric as N
from labelloom.functions import rules as R
from labelloom.functions import text as X
from labelloom.operators.ranking import ranked
from labelloom.plans import discover, evaluate, extract, quality, rollup
from labelloom.session import load, written

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it can be told in SQL."""

    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def joined(column: str) -> F.Column:
    return F.array_join(column, "|").alias(column)


STATUS = "nullif(lower(trim(evidence_status)), '')"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence items with clean keys: event and status in lower case, blank statuses null, item_id as their order."""
    df = load(spark, sf_dir, "evidence_item")
    return df.withColumns({"normalized_event": F.lower(F.trim("normalized_event")), "evidence_status": F.expr(STATUS), "set_id": F.lower("set_id"), "item_order": F.col("item_id")})


EVIDENCE = f"evidence as (select * replace (lower(trim(normalized_event)) as normalized_event, {STATUS} as evidence_status, lower(set_id) as set_id) from evidence_item)"


@query(
    f"""with {EVIDENCE}, k as (select *, concat_ws(chr(31), lower(coalesce(drug_name, '')), coalesce(normalized_event, ''), coalesce(evidence_status, chr(1)), coalesce(assertion, chr(1)), coalesce(subject, chr(1)),
  array_to_string(list_transform(coalesce(route_context, []), lambda x: lower(x)), chr(30)), lower(coalesce(section_code, '')), lower(coalesce(subsection_title, '')), lower(coalesce(source_path, '')), lower(coalesce(chunk_hash, '')),
  lower(trim(regexp_replace(coalesce(supporting_quote, ''), '\\s+', ' ', 'g'))), lower(coalesce(frequency_text, '')), lower(coalesce(comparator_text, '')),
  array_to_string(list_transform(coalesce(population_context, []), lambda x: lower(x)), chr(30)), array_to_string(list_transform(coalesce(interaction_context, []), lambda x: lower(x)), chr(30))) k from evidence),
g as (select k, min(item_id) item_order, count(*) merged, bool_and(postmarketing_only) postmarketing_only, arg_min(evidence_status, item_id) evidence_status from k group by k),
u as (select k, 's' f, item_id o, unnest(range(len(mentioned_in_sections))) i, unnest(mentioned_in_sections) v from k union all select k, 'p', item_id, unnest(range(len(source_paths))), unnest(source_paths) from k),
d as (select k, f, v, min((o, i)) o from u where length(v) > 0 group by k, f, v),
l as (select k, string_agg(v, '|' order by o) filter (f = 's') s, string_agg(v, '|' order by o) filter (f = 'p') p from d group by k)
select item_order, evidence_status, merged, postmarketing_only, coalesce(s, '') mentioned_in_sections, coalesce(p, '') source_paths from g left join l using (k)"""
)
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with equal merge keys as one, their lists united in order of first sight."""
    df = rollup.merge_items(evidence(spark, sf_dir).drop("item_id"))
    return df.select("item_order", "evidence_status", "merged", "postmarketing_only", joined("mentioned_in_sections"), joined("source_paths"))


PRIORITY = "coalesce(nullif(list_position([" + ", ".join(f"'{s}'" for s in R.STATUSES) + f"], {STATUS}), 0), 99)"
DRUG_STATUS = f"""d as (select distinct member.rxcui rxcui from drug_usage), s as (select rxcui, arg_min({STATUS}, {PRIORITY}) evidence_status, count(*) n_items from evidence_item group by rxcui),
drug as (select rxcui, coalesce(evidence_status, 'not_found') evidence_status, coalesce(n_items, 0) n_items from d left join s using (rxcui))"""


@query(f"with {DRUG_STATUS} select * from drug")
def drug_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first status by priority of every drug in use; not_found without items."""
    drugs = load(spark, sf_dir, "drug_usage").select("member.rxcui").distinct()
    return rollup.drug_status(drugs, evidence(spark, sf_dir), ["rxcui"])


COUNTS = ", ".join(f"count(*) filter (evidence_status = '{s}') n_{s}" for s in R.STATUSES)


@query(
    f"""with {EVIDENCE}, s as (select normalized_event, rxcui, arg_min(evidence_status, {PRIORITY.replace(STATUS, 'evidence_status')}) evidence_status from evidence group by all),
c as (select normalized_event, count(*) drugs_analyzed, {COUNTS} from s group by normalized_event)
select *, case when 2 * n_insufficient_label_data > drugs_analyzed then 'insufficient_class_evidence' when n_explicit_positive >= 2 and 3 * n_explicit_positive >= 2 * drugs_analyzed then 'consistent_label_evidence'
  when n_explicit_positive >= 1 then 'partial_or_mixed_label_evidence' else 'no_explicit_mentions_found' end class_assessment from c"""
)
def class_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs by status and the assessment of each event."""
    items = evidence(spark, sf_dir)
    drugs = items.select("normalized_event", "rxcui").distinct()
    return rollup.class_summary(rollup.drug_status(drugs, items, ["normalized_event", "rxcui"]).withColumn("evidence_status", F.coalesce("evidence_status", F.lit("not_found"))), ["normalized_event"]).drop("evidence_distribution")


USED = """u as (select member.rxcui rxcui, member.name as name, total_claims claims, total_beneficiaries beneficiaries, trim(match_quality) match_quality, unnest(cms_generic_names) generic_name, usage_no from drug_usage)"""


@query(
    """with f as (select member.rxcui rxcui, min(member.name) as name, sum(total_claims)::bigint total_claims, sum(total_beneficiaries)::bigint total_beneficiaries, string_agg(distinct match_quality, ', ' order by match_quality) match_quality from drug_usage group by 1),
n as (select rxcui, string_agg(g, '|' order by lower(g), g) generic_names from (select distinct member.rxcui rxcui, unnest(cms_generic_names) g from drug_usage) group by rxcui)
select rxcui, name, total_claims, total_beneficiaries, match_quality, coalesce(match_quality <> 'exact', null) approximate_match, coalesce(generic_names, '') generic_names, row_number() over (order by total_claims desc, coalesce(total_beneficiaries, 0) desc, lower(name), rxcui) as rank
from f left join n using (rxcui)"""
)
def usage_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and beneficiaries per drug with its generic names, ranked."""
    rows = load(spark, sf_dir, "drug_usage").select("member.rxcui", "member.name", "cms_generic_names", F.col("total_claims").alias("claims"), F.col("total_beneficiaries").alias("beneficiaries"), "match_quality")
    # one usage row counts once, however many generic names it has
    named = rows.select("rxcui", "name", F.explode_outer(F.when(F.size("cms_generic_names") > 0, F.col("cms_generic_names"))).alias("generic_name"), F.lit(None).cast("bigint").alias("claims"), F.lit(None).cast("bigint").alias("beneficiaries"), F.lit(None).cast("string").alias("match_quality"))
    counted = rows.select("rxcui", "name", F.lit(None).cast("string").alias("generic_name"), "claims", "beneficiaries", "match_quality")
    df = discover.usage_rollup(counted.unionByName(named))
    return df.select("rxcui", "name", "total_claims", "total_beneficiaries", "match_quality", "approximate_match", joined("generic_names"), F.col("rank").cast("bigint"))


LABEL = """label as (select * from drug_label qualify row_number() over (partition by rxcui order by label_match_score desc nulls last, case label_match_confidence when 'high' then 3 when 'moderate' then 2 when 'low' then 1 else 0 end desc, effective_time desc nulls last, label_no) = 1)"""


def selected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("label_match_confidence") == "high", 3).when(F.col("label_match_confidence") == "moderate", 2).when(F.col("label_match_confidence") == "low", 1).otherwise(0)
    return discover.best_label(load(spark, sf_dir, "drug_label"), [F.col("label_match_score"), confidence, F.col("effective_time")])


@query(f"with {LABEL} select rxcui, label_no, label_match_score, selected_spl_set_id from label")
def label_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per drug: highest score, confidence and effective time."""
    return selected_labels(spark, sf_dir).select("rxcui", "label_no", "label_match_score", "selected_spl_set_id")


@query(
    f"""with {LABEL}, d as (select member.rxcui rxcui, min(member.name) as name from drug_usage group by 1)
select d.rxcui, name, selected_spl_set_id, case when label_no is null or label_match_confidence = 'low' then 'insufficient_label_data' else 'usable' end state from d left join label using (rxcui)"""
)
def usage_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drug in use with its label; without one, or with a low-confidence one, a placeholder state."""
    drugs = load(spark, sf_dir, "drug_usage").groupBy("member.rxcui").agg(F.min("member.name").alias("name"))
    df = drugs.join(selected_labels(spark, sf_dir), "rxcui", "left")
    state = F.when(F.col("label_no").isNull() | (F.col("label_match_confidence") == "low"), "insufficient_label_data").otherwise("usable")
    return df.select("rxcui", "name", "selected_spl_set_id", state.alias("state"))


@query("select distinct lower(set_id) set_id from label_chunk c where not exists (select 1 from drug_label l where lower(l.selected_spl_set_id) = lower(c.set_id))")
def chunks_without_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered labels that no drug has selected (anti join)."""
    sets = load(spark, sf_dir, "label_chunk").select(F.lower("set_id").alias("set_id")).distinct()
    return sets.join(load(spark, sf_dir, "drug_label").select(F.lower("selected_spl_set_id").alias("set_id")), "set_id", "left_anti")


@query("select label_no, rxcui from drug_label l where exists (select 1 from evidence_item e where e.rxcui = l.rxcui)")
def labels_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of drugs with evidence (semi join)."""
    return load(spark, sf_dir, "drug_label").join(load(spark, sf_dir, "evidence_item").select("rxcui"), "rxcui", "left_semi").select("label_no", "rxcui")


@query(
    """with l as (select distinct rxcui from drug_label), u as (select distinct member.rxcui rxcui from drug_usage), e as (select distinct rxcui from evidence_item)
select 'union' op, rxcui from (select * from l union select * from u) union all select 'intersect', rxcui from (select * from l intersect select * from e) union all select 'except', rxcui from (select * from u except select * from e)"""
)
def drug_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of the drugs of three tables."""
    label, usage, items = load(spark, sf_dir, "drug_label").select("rxcui"), load(spark, sf_dir, "drug_usage").select("member.rxcui"), load(spark, sf_dir, "evidence_item").select("rxcui")
    named = lambda op, df: df.select(F.lit(op).alias("op"), "rxcui")
    return named("union", label.union(usage).distinct()).unionByName(named("intersect", label.intersect(items))).unionByName(named("except", usage.subtract(items)))


@query(
    """select lower(set_id) set_id, count(*) n, min(length(text)) shortest, median(length(text))::double median_length, quantile_cont(length(text), 0.9)::double p90_length, max(length(text)) longest,
count(*) filter (length(text) > 300) over_300 from label_chunk group by 1"""
)
def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of text lengths per label."""
    df = load(spark, sf_dir, "label_chunk").select(F.lower("set_id").alias("set_id"), F.length("text").cast("bigint").alias("n"))
    return df.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("n").alias("shortest"), F.percentile("n", 0.5).alias("median_length"), F.percentile("n", 0.9).alias("p90_length"), F.max("n").alias("longest"), F.count_if(F.col("n") > 300).alias("over_300")
    )


KEY = "case " + " ".join(f"when section_code = '{c}' then '{k}'" for c, (k, _) in R.SECTIONS.items()) + " else 'other' end"


@query(f"select {KEY} section_key, count(*) n, count(distinct concat_ws(chr(31), section_code, coalesce(section_title, chr(1)), coalesce(subsection_title, chr(1)))) n_sections from label_chunk group by 1")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and distinct sections by section key."""
    parts = [F.coalesce(c, F.lit("\x01")) for c in ("section_title", "subsection_title")]
    df = load(spark, sf_dir, "label_chunk").groupBy(F.expr(A.section_key("section_code")).alias("section_key"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat_ws("\x1f", "section_code", *parts)).alias("n_sections"))


def _tags(whole: str) -> str:
    like = lambda *w: " or ".join(f"{whole} like '%{x}%'" for x in w)
    kinds = {"boxed_warning": "boxed_warning", "warnings": "warning", "warnings_and_cautions": "warning", "contraindications": "contraindication", "drug_interactions": "drug_interaction", "adverse_reactions": "adverse_reaction"}
    kind = f"case {KEY} " + " ".join(f"when '{k}' then '{v}'" for k, v in kinds.items()) + " end"
    tags = f"concat_ws('|', {kind}, case when {like('clinical trial', 'clinical studies')} then 'clinical_trial' end, case when {like('postmarketing')} then 'postmarketing' end, case when {like('observational', 'cohort study', 'case-control')} then 'observational_statement' end)"
    return f"coalesce(nullif({tags}, ''), 'general_safety_statement')"


@query(f"select chunk_id, {_tags('lower(concat_ws(chr(32), section_title, coalesce(subsection_title, chr(0)), text))')} tags from label_chunk")
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of evidence told by each chunk's section and wording."""
    df = load(spark, sf_dir, "label_chunk").withColumn("section_key", F.expr(A.section_key("section_code")))
    return df.select("chunk_id", F.array_join(F.expr(A.evidence_context("section_key", "section_title", "subsection_title", "text")), "|").alias("tags"))


TERMS = sorted({t for d, r in R.EVENTS.values() for t in (*d, *r)})


@query(" union all ".join(f"select '{t}' term, count(*) n, min(chunk_id) first_chunk_id from label_chunk where regexp_matches(text, '(?i)(^|[^\\pL\\pN_]){t.replace(' ', chr(92) + 's+')}([^\\pL\\pN_]|$)') having count(*) > 0" for t in TERMS))
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that name each event term as whole words."""
    hits = ", ".join(f"case when {X.names_term('text', t)} then {X.lit(t)} end" for t in TERMS)
    df = load(spark, sf_dir, "label_chunk").select("chunk_id", "text")
    # only chunks with any term are exploded by the terms they hold
    df = df.withColumn("term", F.explode(F.expr(f"filter(array({hits}), t -> t is not null)")))
    return df.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_chunk_id"))


def drugs_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, rxcui, drug_name, drug_names and product_context of the selected labels."""
    df = selected_labels(spark, sf_dir).filter("label_match_confidence <> 'low'")
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.filter(F.concat(F.array("requested_name"), *[F.coalesce(c, none) for c in ("generic_names", "brand_names", "substance_names")]), lambda n: F.length(n) > 0))
    return df.select(F.lower("selected_spl_set_id").alias("set_id"), "rxcui", F.col("requested_name").alias("drug_name"), F.concat(F.array("requested_name"), F.coalesce("generic_names", none)).alias("drug_names"), F.array_join(names, " ").alias("product_context"))


@query()
def extracted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence items of all events of the rules found in all label chunks, merged."""
    chunks = load(spark, sf_dir, "label_chunk").withColumn("set_id", F.lower("set_id"))
    ready = extract.parent_context(extract.searchable(chunks))
    items = written(extract.items(ready, [extract.event_plan(e) for e in R.EVENTS], drugs_of_labels(spark, sf_dir)), "items")
    return rollup.merge_items(items).drop("source_text")


def _parts_sql() -> str:
    ex = lambda p, i: f"regexp_extract(frequency_text, '(?i){p}', {i})"
    m = lambda p: f"regexp_matches(frequency_text, '(?i){p}')"
    words = f"map {{{', '.join(f"'{w}': {i + 1}" for i, w in enumerate(R.NUMBER_WORDS))}}}"
    number = f"coalesce({words}[lower({ex(R.CASES_PER, 1)})]::double, try_cast({ex(R.CASES_PER, 1)} as double))"
    value = f"case when {m(R.PERCENT)} then {ex(R.PERCENT, 1)}::double when {m(R.OF_PATIENTS)} then {ex(R.OF_PATIENTS, 1)}::double when {m(R.CASES_PER)} then {number} when {m(R.COUNT_ONLY)} then replace({ex(R.COUNT_ONLY, 1)}, ',', '')::double when {m(R.RATIO)} then {ex(R.RATIO, 1)}::double end"
    unit = (
        f"case when {m(R.PERCENT)} then 'percent' when {m(R.OF_PATIENTS)} then concat('of ', {ex(R.OF_PATIENTS, 2)}, ' patients') when {m(R.CASES_PER)} then concat('per ', {ex(R.CASES_PER, 2)}, ' ', {ex(R.CASES_PER, 3)}) when {m(R.COUNT_ONLY)} then {ex(R.COUNT_ONLY, 2)}"
        f" when {m(R.RATIO)} then rtrim(concat('per ', {ex(R.RATIO, 2)}, ' ', {ex(R.RATIO, 3)})) when lower(frequency_text) in ('common', 'uncommon', 'rare', 'rarely', 'frequency cannot be estimated') then 'qualitative' end"
    )
    return f"select item_id, {value} as value, {unit} as unit from evidence_item where frequency_text is not null"


@query(_parts_sql())
def frequency_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and unit of every frequency text by the label rules."""
    df = load(spark, sf_dir, "evidence_item").select("item_id", "frequency_text").filter("frequency_text is not null")
    return df.select("item_id", F.expr(N.parts("frequency_text")).alias("p")).select("item_id", "p.value", "p.unit")


_list = lambda values: "[" + ", ".join(repr(v) for v in values) + "]"
PLANS = "plans(wanted, direct, searched) as (values " + ", ".join(f"('{k}', {_list(extract.event_plan(k).direct)}, {_list(extract.event_plan(k).terms)})" for k in extract.EVENT_OF) + ")"
_says = lambda *words: "(" + " or ".join(f"contains(lower(e.supporting_quote), '{w}')" for w in words) + ")"
SUPPORTED = f"""coalesce(case e.evidence_status when 'negated' then {_says('no cases', 'not observed', 'none observed')} when 'historical_or_preexisting' then {_says('pre-existing', 'preexisting', 'history of')} when 'comparator_only' then {_says('placebo', 'comparator', 'control')}
      when 'interaction_dependent' then coalesce(len(e.interaction_context) > 0, false) or coalesce(list_contains(e.evidence_context, 'drug_interaction'), false) when 'explicit_positive' then e.assertion = 'present' and length(e.matched_term) > 0
      when 'related_but_not_explicit' then e.assertion = 'uncertain' and length(e.matched_term) > 0 else true end, false)"""
CHECKS = {
    "supporting_quote": "coalesce(length(trim(e.supporting_quote)), 0) > 0",
    "source_path": "(coalesce(length(e.source_path), 0) > 0 or coalesce(len(e.source_paths), 0) > 0)",
    "chunk_hash": "(coalesce(length(e.chunk_hash), 0) > 0 or coalesce(len(e.chunk_hashes), 0) > 0)",
    "event_or_synonym": "len(list_filter(searched, lambda t: contains(lower(coalesce(e.supporting_quote, '')), t))) > 0",
    "classification_supported": SUPPORTED,
}
_word = lambda text, term: f"regexp_matches({text}, concat('(?i)(^|[^\\pL\\pM\\p{{Nd}}_])', replace({term}, ' ', '\\s+'), '([^\\pL\\pM\\p{{Nd}}_]|$)'))"
_path = "coalesce(nullif(e.source_path, ''), e.source_paths[1], '')"
_numbers = f"case when regexp_matches({_path}, '\\[[0-9]+\\]') then list_transform(regexp_extract_all({_path}, '\\[([0-9]+)\\]', 1), lambda x: x::int) else [{evaluate.LAST}] end"
_clauses = "string_split(regexp_replace(coalesce(e.supporting_quote, ''), '([.!?;])\\s+', concat('\\1', chr(10)), 'g'), chr(10))"
GOLD = f"""{PLANS}, gold as (select g.*, coalesce(direct, case when length(w) > 0 then [w] else [] end) direct, coalesce(searched, case when length(w) > 0 then [w] else [] end) searched from (select * replace (lower(trim(normalized_event)) as normalized_event, nullif(lower(trim(expected_status)), '') as expected_status),
  lower(spl_set_id) set_id, trim(regexp_replace(lower(coalesce(event_query, '')), '[^a-z0-9]+', ' ', 'g')) w from gold_case) g left join plans on wanted = w),
p as (select g.case_no, g.expected_status, g.expected_supporting_quote, g.gold_review_complete, g.expected_assertion, g.expected_subject, g.expected_context, g.expected_frequency_text, g.expected_comparator_text, g.expected_section, g.score_frequency, g.score_comparator, e.*, count(e.item_id) over (partition by g.case_no) n_items,
  {", ".join(f"{c} has_{n}" for n, c in CHECKS.items())}, coalesce(length(trim(g.set_id)), 0) > 0 has_set_id,
  row_number() over (partition by g.case_no order by coalesce(nullif(list_position({_list(R.STATUSES)}, e.evidence_status), 0), 99), case when list_contains(direct, lower(e.matched_term)) then 0 else 1 end,
    coalesce(list_position(['high', 'medium', 'low'], e.extraction_confidence) - 1, 99), coalesce(list_position({_list(evaluate.SUBJECTS)}, e.subject) - 1, 99),
    coalesce(list_min(list_transform(e.evidence_context, lambda c: coalesce(list_position({_list(evaluate.CONTEXTS)}, c) - 1, 99))), 99), -({" + ".join(f"({c})::int" for c in CHECKS.values())}),
    (coalesce(length(trim(e.supporting_quote)), 0) = 0 or regexp_matches(trim(e.supporting_quote), '^[\\p{{Ll}}\\)\\]}},;:]') or length(replace(e.supporting_quote, '(', '')) - length(replace(e.supporting_quote, ')', '')) > 0 or length(replace(e.supporting_quote, '[', '')) - length(replace(e.supporting_quote, ']', '')) > 0)::int,
    case when len(list_filter({_clauses}, lambda c: {_word('c', 'e.drug_name')} and len(list_filter(direct, lambda t: {_word('c', 't')})) > 0)) > 0 then 0 when e.evidence_status = 'interaction_dependent' or e.assertion = 'conditional' or coalesce(len(e.interaction_context), 0) > 0 then 2 else 1 end,
    {_numbers}, {_numbers}[-1], {_path}, e.item_id) r
  from gold g left join evidence e on e.set_id = g.set_id and e.normalized_event = g.normalized_event),
best as (select * from p where r = 1)"""


def gold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = load(spark, sf_dir, "gold_case").withColumns({"normalized_event": F.lower(F.trim("normalized_event")), "set_id": F.lower("spl_set_id"), "expected_status": F.nullif(F.lower(F.trim("expected_status")), F.lit(""))})
    gold = gold.drop("drug_name", "rxcui")
    items = evidence(spark, sf_dir).drop("item_order")
    return evaluate.primary_items(gold, items, ["set_id", "normalized_event"], "item_id")


@query(
    f"""with {EVIDENCE}, {GOLD} select case_no, item_id, evidence_status, n_items, case when coalesce(trim(expected_supporting_quote), '') = '' then 'not_scored_no_expected_supporting_quote'
  when coalesce(trim(supporting_quote), '') = '' then 'predicted_supporting_quote_missing'
  when contains(trim(regexp_replace(lower(supporting_quote), '\\s+', ' ', 'g')), trim(regexp_replace(lower(expected_supporting_quote), '\\s+', ' ', 'g'))) then 'matched' else 'expected_quote_not_fully_contained' end quote_match from best"""
)
def gold_primary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary item of every reviewed case, chosen by a composite key, and whether its quote holds the expected one."""
    df = gold_predictions(spark, sf_dir)
    return df.select("case_no", F.col("item.item_id").alias("item_id"), F.col("item.evidence_status").alias("evidence_status"), F.coalesce("n_items", F.lit(0)).alias("n_items"), evaluate.quote_match(F.col("expected_supporting_quote"), F.col("item.supporting_quote")).alias("quote_match"))


MATRIX = f"""{GOLD}, s as (select case when expected_status = 'not_found_in_reviewed_sections' then 'not_found' else expected_status end expected, case when item_id is null then 'not_found' when evidence_status = 'not_found_in_reviewed_sections' then 'not_found' else evidence_status end predicted from best where gold_review_complete),
l as (select unnest([{', '.join(repr(s) for s in R.STATUSES)}]) s), m as (select a.s expected, b.s predicted, (select count(*) from s where s.expected = a.s and s.predicted = b.s) n from l a, l b)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda c: F.when(c == "not_found_in_reviewed_sections", "not_found").otherwise(c)
    df = gold_predictions(spark, sf_dir).filter("gold_review_complete")
    return df.select(same(F.col("expected_status")).alias("expected"), F.when(F.col("item").isNull(), "not_found").otherwise(same(F.col("item.evidence_status"))).alias("predicted"))


@query(f"with {EVIDENCE}, {MATRIX} select * from m")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against predicted statuses, zeros included."""
    return evaluate.confusion(scored(spark, sf_dir), "expected", "predicted")


@query(
    f"""with {EVIDENCE}, {MATRIX}, r as (select expected status, sum(n)::bigint support, sum(n) filter (expected = predicted)::bigint tp from m group by 1), c as (select predicted status, sum(n)::bigint pn from m group by 1),
x as (select status, support, case when pn > 0 then tp::double / pn end as precision, case when support > 0 then tp::double / support end recall from r join c using (status))
select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) end f1 from x"""
)
def status_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, precision, recall and F1 per status."""
    return evaluate.status_metrics(evaluate.confusion(scored(spark, sf_dir), "expected", "predicted"))


@query(
    """select count(*) cases, count(*) filter (gold_review_complete) completed, count(*) filter (not coalesce(gold_review_complete, false)) needing_review, count(*) filter (gold_review_complete and expected_status = 'explicit_positive') explicit_positive,
count(*) filter (gold_review_complete and (expected_status = 'interaction_dependent' or expected_assertion = 'conditional')) interaction_or_conditional, count(*) filter (gold_review_complete and expected_status in ('negated', 'historical_or_preexisting', 'comparator_only')) negation_historical_or_comparator,
count(*) filter (gold_review_complete and (score_frequency or score_comparator)) frequency_or_comparator, count(*) filter (gold_review_complete and (expected_status like 'not_found%' or benchmark_group = 'not_found')) not_found from gold_case"""
)
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed cases and how many cover each axis."""
    done, status = F.col("gold_review_complete"), F.col("expected_status")
    axis = lambda c, name: F.count_if(done & c).alias(name)
    return load(spark, sf_dir, "gold_case").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(done).alias("completed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("needing_review"), axis(status == "explicit_positive", "explicit_positive"),
        axis((status == "interaction_dependent") | (F.col("expected_assertion") == "conditional"), "interaction_or_conditional"), axis(status.isin("negated", "historical_or_preexisting", "comparator_only"), "negation_historical_or_comparator"),
        axis(F.col("score_frequency") | F.col("score_comparator"), "frequency_or_comparator"), axis(status.like("not_found%") | (F.col("benchmark_group") == "not_found"), "not_found"),
    )


DAY = "case when length(regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g')) >= 8 then left(regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g'), 8) end"


@query(
    f"""with a as (select lower(set_id) set_id, arg_max(coalesce(version, chr(1)), (retrieved_at, loaded_at, chunk_id)) v, arg_max(coalesce(effective_time, chr(1)), (retrieved_at, loaded_at, chunk_id)) t from label_chunk group by 1),
j as (select case_no, nullif(trim(fixed_spl_version), '') fv, {DAY.format('fixed_spl_effective_time')} fd, trim(replace(v, chr(1), '')) v, {DAY.format('t')} ad, fixed_spl_version from gold_case left join a on a.set_id = lower(spl_set_id))
select case_no, case when fv is null then 'missing_fixed_spl_version' when coalesce(v, '') <> fv then 'fixed_spl_version_unavailable' when fd is not null and ad is null then 'fixed_spl_effective_time_unavailable'
  when fd <> ad then 'fixed_spl_effective_time_mismatch' else 'fixed_spl_version_verified' end state from j"""
)
def gold_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each case's declared version is the newest one delivered."""
    newest = load(spark, sf_dir, "label_chunk").groupBy(F.lower("set_id").alias("set_id")).agg(F.max_by(F.struct("version", "effective_time"), F.struct("retrieved_at", "loaded_at", "chunk_id")).alias("a"))
    df = load(spark, sf_dir, "gold_case").withColumn("set_id", F.lower("spl_set_id")).join(newest, "set_id", "left")
    return df.select("case_no", evaluate.identity(F.col("fixed_spl_version"), F.col("fixed_spl_effective_time"), F.col("a.version"), F.col("a.effective_time")).alias("state"))


NAME_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[–—]', '-', 'g'), '[-_/,+()]', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
CORE_SQL = "list_filter(string_split(" + NAME_SQL + ", ' '), lambda t: length(t) > 0 and t not in (" + ", ".join(f"'{s}'" for s in discover.SALTS) + "))"


@query(f"with n as (select distinct unnest(cms_generic_names) as name from drug_usage) select name, {NAME_SQL.format('name')} name_key, array_to_string(list_sort({CORE_SQL.format('name')}), ' ') core_key from n")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names and their sorted core tokens without salts."""
    df = load(spark, sf_dir, "drug_usage").select(F.explode("cms_generic_names").alias("name")).distinct()
    return df.select("name", discover.name_key("name").alias("name_key"), discover.core_key("name").alias("core_key"))


@query(
    f"""with m as (select distinct member.rxcui rxcui, member.name as name, member.tty tty from drug_usage), g as (select distinct unnest(cms_generic_names) generic_name from drug_usage),
x as (select *, {NAME_SQL.format('name')} a, {NAME_SQL.format('generic_name')} b, {CORE_SQL.format('name')} ca, {CORE_SQL.format('generic_name')} cb from m join g on array_to_string(list_sort({CORE_SQL.format('name')}), ' ') = array_to_string(list_sort({CORE_SQL.format('generic_name')}), ' ')),
y as (select rxcui, name, tty, generic_name, case when length(a) = 0 or length(b) = 0 then null when a = b then 'exact' when regexp_matches(generic_name, '[/+]') and tty <> 'MIN' then null
  when tty = 'IN' and string_split(a, ' ') = ca and ca = cb and len(string_split(b, ' ')) > len(cb) then 'salt-normalized' when tty = 'MIN' and list_sort(ca) = list_sort(cb) then 'combination-normalized' end match_quality from x)
select * from y where match_quality is not null"""
)
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs and generic names that match by name, with the quality of the match."""
    usage = load(spark, sf_dir, "drug_usage")
    members = usage.select("member.rxcui", "member.name", "member.tty").distinct()
    return discover.match_usage(members, usage.select(F.explode("cms_generic_names").alias("generic_name")).distinct())


CATALOG = "c as (select class_id, class_name, row_number() over (partition by class_id order by created_at, run_id) r from analysis_run where length(trim(class_id)) > 0 and length(trim(class_name)) > 0), k as (select class_id, class_name from c where r = 1)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all runs, the first name seen of each."""
    df = load(spark, sf_dir, "analysis_run").filter((F.length(F.trim("class_id")) > 0) & (F.length(F.trim("class_name")) > 0))
    first = Window.partitionBy("class_id").orderBy("created_at", "run_id")
    return df.withColumn("r", F.row_number().over(first)).filter("r = 1").select("class_id", "class_name", F.lit("EPC").alias("class_type"))


@query(f"with {CATALOG} select class_id, class_name, row_number() over (order by lower(class_name), class_id) as position from k")
def class_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct classes in order of name."""
    return ranked(catalog(spark, sf_dir), [F.lower("class_name"), F.col("class_id")], "position").select("class_id", "class_name", "position")


@query(
    f"""with {CATALOG}, n as (select *, {NAME_SQL.format('class_name')} n from k), b as (select *, case when n = 'agents' then 0 when starts_with(n, 'agents') then 1 when contains(n, 'agents') then 2 end bucket from n)
select class_id, class_name, bucket, row_number() over (order by bucket, length(n), lower(class_name), class_id) as position from b where bucket is not null qualify position <= 40"""
)
def class_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 best classes for a query by plain matches."""
    return discover.search_classes(catalog(spark, sf_dir), "agents", fuzzy=False).select("class_id", "class_name", "bucket", F.col("position").cast("bigint"))


@query()
def class_search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with a name similar to a mistyped one."""
    return discover.search_classes(catalog(spark, sf_dir), "Zanergik agents")


@query("select id, run_id, class_id, created_at from analysis_run qualify row_number() over (partition by id order by created_at desc, run_id desc) = 1")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of every run."""
    df = load(spark, sf_dir, "analysis_run").groupBy("id").agg(F.max_by(F.struct("run_id", "class_id", "created_at"), F.struct("created_at", "run_id")).alias("r"))
    return df.select("id", "r.run_id", "r.class_id", "r.created_at")


SEARCHED = "array_position(array('rxcui', 'generic_name', 'substance_name', 'brand_name'), query_field)"


@query(
    f"""with o as (select *, list_position(['rxcui', 'generic_name', 'substance_name', 'brand_name'], query_field) o, query_field in ('rxcui', 'brand_name') or (query_field = 'generic_name' and list_contains(list_transform(generic_names, lambda x: lower(x)), lower(requested_name)))
  or (query_field = 'substance_name' and list_contains(list_transform(substance_names, lambda x: lower(x)), lower(requested_name))) stops from drug_label), c as (select rxcui, min(o) filter (stops) cut from o group by rxcui)
select label_no, o.rxcui, query_field from o join c using (rxcui) where cut is null or o <= cut"""
)
def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels found by the steps of a search up to the first that settles it."""
    low = lambda c: F.array_contains(F.transform(c, F.lower), F.lower("requested_name"))
    field = F.col("query_field")
    stops = field.isin("rxcui", "brand_name") | ((field == "generic_name") & low("generic_names")) | ((field == "substance_name") & low("substance_names"))
    df = load(spark, sf_dir, "drug_label").withColumn("o", F.expr(SEARCHED))
    return discover.cascade(df, "rxcui", "o", stops).select("label_no", "rxcui", "query_field")


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) net from lineitem where l_returnflag in ('A', 'R') and l_quantity between 10 and 20")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pruned scan with pushed-down filters."""
    df = load(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10, 20))
    return df.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("with w as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) select user_id, event_type, event_id from w where r = 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    df = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return df.select("user_id", "event_type", "event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL

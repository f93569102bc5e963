"""Assertion, subject, route and context of an event mention, as SQL over SQL expressions."""

from __future__ import annotations

from labelloom.functions import rules as R
from labelloom.functions.numeric import places
from labelloom.functions.text import extract_all, has, has_any, lit, pattern, quoted, term_pattern

VERDICT = ("evidence_status", "assertion", "subject", "extraction_confidence")


def verdict(*values: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {lit(v) if not v.startswith('if(') else v}" for n, v in zip(VERDICT, values, strict=True)) + ")"


def negated(clause: str, term: str) -> str:
    return has_any(clause, R.NEGATED, t=quoted(term))


def historical(text: str, term: str) -> str:
    return "(" + has(text, r"\b{t}\b", t=quoted(term)) + f" and (lower({text}) like '%underlying condition%' or " + has_any(text, R.HISTORICAL, t=quoted(term)) + "))"


def historical_parent(context: str, term: str, drug: str) -> str:
    return "((" + has(context, R.HISTORICAL_PARENT) + " or " + has(context, R.HISTORICAL_DRUG, d=quoted(drug)) + ") and " + has(context, r"\b{t}\b", t=quoted(term)) + ")"


def first_at(text: str, patterns: tuple[str, ...]) -> str:
    """SQL of the place of the earliest match of any pattern, from 1, or null."""
    return "least(" + ", ".join(f"nullif(regexp_instr({text}, {pattern(p)}), 0)" for p in patterns) + ")"


def secondary_interaction(sentence: str, term: str, drug: str) -> str:
    """SQL: the interaction stands in a later clause that only modifies the event's own clause."""
    z = f"named_struct('i', {first_at(sentence, R.CORE_INTERACTIONS)}, 'a', nullif(regexp_instr({sentence}, {term_pattern(term)}), 0), 'n', length(regexp_extract({sentence}, {term_pattern(term)}, 0)))"
    between = f"substring({sentence}, z.a + z.n, z.i - z.a - z.n)"
    edge = f"regexp_instr({between}, {pattern(R.CLAUSE_BOUNDARY)})"
    primary = f"rtrim(' ;,:-', left({sentence}, z.a + z.n + {edge} - 2))"
    holds = f"z.a < z.i and {edge} > 0 and ({primary} rlike {term_pattern(drug)} or {has(primary, R.DRUG_EFFECT)})"
    return f"coalesce(transform(array({z}), z -> {holds})[0], false)"


def classify(sentence: str, term: str, drug: str, direct: str, interaction_section: str, context: str) -> str:
    """SQL of the verdict on a mention; rules in order, the first that holds wins."""
    own = f"coalesce(get(filter(split({sentence}, ';'), c -> c rlike {term_pattern(term)}), 0), {sentence})"
    interacts = f"({interaction_section} or {has_any(sentence, R.CORE_INTERACTIONS)}) and not {secondary_interaction(sentence, term, drug)}"
    subject = f"if({has(sentence, R.CONCOMITANT_SUBJECT)}, 'concomitant_drug', 'selected_drug')"
    of_class = f"not {sentence} rlike {term_pattern(drug)} and {has(sentence, R.CLASS_STATEMENT)}"
    return (
        f"case when {negated(own, term)} then {verdict('negated', 'absent', 'selected_drug', 'high')}"
        f" when {has(sentence, R.COMPARATOR_ONLY, t=quoted(term))} then {verdict('comparator_only', 'present', 'comparator', 'high')}"
        f" when {interacts} then {verdict('interaction_dependent', 'conditional', subject, 'high')}"
        f" when {historical(sentence, term)} or {historical_parent(context, term, drug)} then {verdict('historical_or_preexisting', 'historical', 'patient_history', 'high')}"
        f" when {has_any(sentence, R.DESCRIPTIVE, t=quoted(term))} or not {direct} then {verdict('related_but_not_explicit', 'uncertain', 'unclear', 'medium')}"
        f" when {of_class} then {verdict('explicit_positive', 'present', 'general_class_statement', 'high')}"
        f" else {verdict('explicit_positive', 'present', 'selected_drug', 'high')} end"
    )


def route_matches(text: str) -> str:
    """SQL of array<struct<s, e, clue, route>> of all route clues in order of place."""
    found = ", ".join(f"transform({places(text, pattern(p))}, q -> named_struct('s', q.at, 'e', q.at + length(q.m), 'clue', {lit(c)}, 'route', {lit(r)}))" for c, r, p in R.ROUTE_CLUES)
    none = "cast(array() as array<struct<s:int,e:int,clue:string,route:string>>)"
    # most texts name no route, which one pass tells
    return f"if({has_any(text, tuple(p for _, _, p in R.ROUTE_CLUES))}, array_sort(flatten(array({found}))), if({text} is null, null, {none}))"


def nearest_route(matches: str, text: str, term: str | None = None) -> str:
    """SQL of the route nearest to the event and its clues; without an event in the text only if there is one route."""
    alone = f"if(size(array_distinct(transform({matches}, m -> m.route))) = 1, {matches}[0].route, null)"
    route = alone
    if term:
        centre = f"(2 * (regexp_instr({text}, {term_pattern(term)}) - 1) + length(regexp_extract({text}, {term_pattern(term)}, 0)))"
        nearest = f"array_min(transform({matches}, (m, i) -> struct(abs(m.s + m.e - {centre}) as d, i as i, m.route as route))).route"
        route = f"if({text} rlike {term_pattern(term)}, {nearest}, {alone})"
    clues = f"transform(filter({matches}, m -> m.route = r), m -> m.clue)"
    return f"flatten(transform(filter(array({route}), r -> r is not null), r -> array_distinct(concat(array(r), {clues}))))"


def applicability(context: str, selected: str) -> str:
    """SQL: whether the mention's route fits the selected product's."""
    names = lambda x, values: f"array_intersect({x}, array({', '.join(lit(v) for v in values)}))"
    own, other = names(context, R.ROUTES), names(selected, R.ROUTES)
    form, forms = names(context, R.FORMULATIONS), names(selected, R.FORMULATIONS)
    return (
        f"case when size({own}) = 0 then 'unrestricted_route' when size({other}) = 0 then 'ambiguous_route' when not arrays_overlap({own}, {other}) then 'route_mismatch'"
        f" when size({form}) > 0 and size({forms}) > 0 and not arrays_overlap({form}, {forms}) then 'route_mismatch' else 'matching_route' end"
    )


def interaction_context(text: str, interaction_section: str) -> str:
    return f"if({interaction_section} or {has_any(text, R.CORE_INTERACTIONS)}, {extract_all(text, R.INTERACTIONS)}, cast(array() as array<string>))"


def evidence_context(section_key: str, section_title: str, subsection_title: str, text: str) -> str:
    """SQL of the kinds of evidence that section and wording tell."""
    whole = f"lower(concat_ws(' ', {section_title}, coalesce({subsection_title}, ''), {text}))"
    has_word = lambda *words: " or ".join(f"{whole} like '%{w}%'" for w in words)
    kind = (
        f"case when {section_key} = 'boxed_warning' then 'boxed_warning' when {section_key} in ('warnings', 'warnings_and_cautions') then 'warning'"
        f" when {section_key} = 'contraindications' then 'contraindication' when {section_key} = 'drug_interactions' then 'drug_interaction' when {section_key} = 'adverse_reactions' then 'adverse_reaction' end"
    )
    tags = (
        f"filter(array({kind}, case when {has_word('clinical trial', 'clinical studies')} then 'clinical_trial' end, case when {has_word('postmarketing')} then 'postmarketing' end,"
        f" case when {has_word('observational', 'cohort study', 'case-control')} then 'observational_statement' end), t -> t is not null)"
    )
    return f"if(size({tags}) = 0, array('general_safety_statement'), {tags})"


def section_key(code: str) -> str:
    """SQL of the key of a LOINC code, other if unknown."""
    return "case " + " ".join(f"when {code} = {lit(c)} then {lit(k)}" for c, (k, _) in R.SECTIONS.items()) + " else 'other' end"

"""Roles of numbers in label text, as SQL over SQL expressions.

A span is struct(m, before, after, cb, ca): the number's text, all text before
and after it, and the same within its clause.
"""

from __future__ import annotations

from labelloom.functions import rules as R
from labelloom.functions.text import collapse, has, has_any, lit, pattern, quoted, term_pattern, tokens

SPAN = "struct<m:string,before:string,after:string,cb:string,ca:string>"


def places(text: str, regex: str) -> str:
    """SQL of array<struct<m, at>>: the matches of a pattern and how many characters come before each."""
    z = f"named_struct('t', {text}, 'm', regexp_extract_all({text}, {regex}, 0), 'p', split({text}, {regex}))"
    at = "aggregate(slice(z.p, 1, i + 1), 0, (a, p) -> a + length(p)) + aggregate(slice(z.m, 1, i), 0, (a, p) -> a + length(p))"
    return f"transform(array({z}), z -> transform(z.m, (m, i) -> named_struct('m', m, 'at', {at})))[0]"


def span_of(text: str, m: str, at: str) -> str:
    """SQL of the span of ``m``, which begins after ``at`` characters."""
    before, after = f"left({text}, {at})", f"substr({text}, {at} + length({m}) + 1)"
    left, right = lit("[^.;|\\n]*$"), lit("^[^.;|\\n]*")
    return f"named_struct('m', {m}, 'before', {before}, 'after', {after}, 'cb', regexp_extract({before}, {left}, 0), 'ca', regexp_extract({after}, {right}, 0))"


def spans(text: str) -> str:
    """SQL of the spans of all frequency-like numbers and words of a text."""
    found = f"transform({places(text, pattern(R.FREQUENCY))}, q -> {span_of(text, 'q.m', 'q.at')})"
    return f"if({text} rlike {pattern(R.FREQUENCY)}, {found}, if({text} is null, null, cast(array() as array<{SPAN}>)))"


def role(s: str, term: str | None = None) -> str:
    """SQL of a span's role; rules in order, the first that holds wins.

    Each rule looks at the number and so many characters before and after it,
    in its clause (``cb``, ``ca``) or in the whole text.
    """
    w = R.WINDOWS
    before, after = (lambda n: f"right({s}.cb, {w[n]})"), (lambda n: f"left({s}.ca, {w[n]})")
    around = lambda left, right: f"concat({before(left)}, {s}.m, {after(right)})"
    wide = lambda right: f"concat(right({s}.before, {w['pressure']}), {s}.m, left({s}.after, {w[right]}))"
    population = has(f"{s}.m", R.POPULATION_RATIO)
    ratio = f"({s}.m like '%/%' and not {population})"
    strength = f"contains({s}.m, '%') and ({has(f'{s}.cb', R.STRENGTH_BEFORE)} or {has(f'{s}.ca', R.STRENGTH_AFTER)} or {has(f'{s}.ca', R.COMPOSITION_AFTER)} or {has(before('composition'), R.COMPOSITION)})"
    pressure = f"{ratio} and {has(wide('pressure'), R.BLOOD_PRESSURE)}"
    vital = has(around("vital_before", "vital_after"), R.LAB_OR_VITAL)
    dose = f"not {population} and ({ratio} and {has(wide('ratio_after'), R.DOSE_CONTEXT)} or {has(around('dose', 'dose'), R.ADMINISTERED)})"
    enrolled = f"{has(before('sample_before'), R.SAMPLE_CUE)} or {has(after('sample_after'), R.RECEIVED)}"
    sample = f"{has(f'{s}.m', rf'\b{R.PEOPLE}\b')} and case when {has(after('sample_after'), R.SAMPLE_THEN_COUNT)} then true when {has(after('sample_after'), R.OUTCOME)} then false else {enrolled} end"
    comparator = f"{has(before('comparator'), R.COMPARATOR_BEFORE)} or {has(after('comparator'), R.COMPARATOR_AFTER)}"
    relation = [has(f"{s}.m", R.CASES_PER_CUE), has(f"{s}.m", R.OF_PATIENTS_CUE), population, has(f"{s}.ca", R.OF_PEOPLE_AFTER), has(before("cue_before"), R.FREQUENCY_CUE), has(after("outcome_after"), R.OUTCOME)]
    if term:
        relation += [f"{before('event')} rlike {term_pattern(term)}", f"{after('event')} rlike {term_pattern(term)}"]
    words = ", ".join(lit(v) for v in (*R.QUALITATIVE, R.UNKNOWN_FREQUENCY))
    rules = [
        (f"lower({s}.m) in ({words})", "event_frequency"),
        (strength, "product_strength"),
        (f"{pressure} or {vital}", "laboratory_or_vital_value"),
        (dose, "administered_dose"),
        (sample, "sample_size"),
        (comparator, "comparator_frequency"),
        (" or ".join(relation), "event_frequency"),
    ]
    return "case " + " ".join(f"when {rule} then '{name}'" for rule, name in rules) + " else 'ambiguous_numeric_value' end"


def qualitative_applies(text: str, s: str, term: str | None) -> str:
    """SQL: a word such as rare must be bound to the event; numbers always apply."""
    if not term:
        return "true"
    words = ", ".join(lit(w) for w in R.QUALITATIVE)
    columns = {"q": quoted(f"{s}.m"), "t": quoted(term)}
    return f"(lower({s}.m) not in ({words}) or " + has(text, R.QUALITATIVE_BEFORE, **columns) + " or " + has(text, R.QUALITATIVE_AFTER, **columns) + ")"


def frequencies(text: str, term: str | None = None) -> str:
    """SQL of the texts of all event frequencies of a text."""
    words = ", ".join(lit(w) for w in R.QUALITATIVE)
    kept = f"filter({spans(text)}, s -> {role('s', term)} = 'event_frequency' and {qualitative_applies(text, 's', term)})"
    clean = collapse("s.m")
    return f"transform({kept}, s -> if(lower({clean}) in ({words}), lower({clean}), {clean}))"


def parts(f: str) -> str:
    """SQL of struct(value, unit) of a frequency text; forms in order."""
    group = lambda p, i: f"regexp_extract({f}, {pattern(p)}, {i})"
    number = f"coalesce(nullif(array_position(array({', '.join(lit(w) for w in R.NUMBER_WORDS)}), lower({group(R.CASES_PER, 1)})), 0), try_cast({group(R.CASES_PER, 1)} as bigint))"
    # wide digits count as digits, too
    out = lambda value, unit: f"named_struct('value', try_cast(translate({value}, '０１２３４５６７８９', '0123456789') as double), 'unit', {unit})"
    forms = [
        (R.PERCENT, group(R.PERCENT, 1), lit("percent")),
        (R.OF_PATIENTS, group(R.OF_PATIENTS, 1), f"concat('of ', {group(R.OF_PATIENTS, 2)}, ' patients')"),
        (R.CASES_PER, number, f"concat('per ', {group(R.CASES_PER, 2)}, ' ', {group(R.CASES_PER, 3)})"),
        (R.COUNT_ONLY, f"replace({group(R.COUNT_ONLY, 1)}, ',', '')", group(R.COUNT_ONLY, 2)),
        (R.RATIO, group(R.RATIO, 1), f"rtrim(concat('per ', {group(R.RATIO, 2)}, ' ', {group(R.RATIO, 3)}))"),
    ]
    quality = ", ".join(lit(w) for w in (*R.QUALITATIVE, R.UNKNOWN_FREQUENCY))
    legs = " ".join(f"when {has(f, p)} then {out(value, unit)}" for p, value, unit in forms)
    return f"case {legs} when lower({f}) in ({quality}) then {out('cast(null as string)', lit('qualitative'))} else {out('cast(null as string)', 'cast(null as string)')} end"


def comparator_name(header: str) -> str:
    """SQL of the kind of comparator that a header names, or null."""
    return "case " + " ".join(f"when {has(header, p)} then {lit(n)}" for p, n in R.COMPARATOR_NAMES) + " end"


def header_matches(header: str, names: str) -> str:
    """SQL: all name tokens of one of the drug names are among the header's."""
    ignored = ", ".join(lit(w) for w in R.HEADER_IGNORED)
    own = f"filter({tokens('n')}, k -> length(k) > 2 and k not in ({ignored}))"
    return f"exists({names}, n -> size({own}) > 0 and size(array_except({own}, {tokens(header)})) = 0)"


def cell_frequency(header: str, cell: str) -> str:
    """SQL of the frequency that a table cell states, or null."""
    clean, dashes = collapse(cell), ", ".join(lit(d) for d in R.CELL_DASHES)
    return (
        f"case when {has(clean, R.CELL_PERCENT)} then {clean} when size({frequencies(cell)}) > 0 then {frequencies(cell)}[0]"
        f" when {clean} in ({dashes}) then {clean} when {has(header, R.HEADER_PERCENT)} and {has(clean, R.CELL_NUMBER)} then concat({clean}, '%') end"
    )


VARIANT = "struct<frequency_text:string,value:double,unit:string,comparator_text:string,population:array<string>>"


def table_variants(headers: str, cells: str, names: str) -> str:
    """SQL of one variant per drug column of a table row that states a frequency."""
    columns = f"transform(zip_with({headers}, {cells}, (h, c) -> named_struct('h', h, 'c', c)), (x, i) -> named_struct('h', x.h, 'i', i, 'f', {cell_frequency('x.h', 'x.c')}, 'n', {comparator_name('x.h')}, 'own', i > 0 and {header_matches('x.h', names)}))"
    group = "trim(if(x.h like '%/%', split(x.h, '/')[0], ''))"
    others = "filter(cols, o -> o.i <> x.i and o.n is not null)"
    near = f"filter({others}, o -> startswith(lower(o.h), lower({group})))"
    chosen = f"coalesce(get({near}, 0), get({others}, 0))"
    population = f"if(length({group}) > 0 and {has(group, R.HEADER_POPULATION)}, array({group}), cast(array() as array<string>))"
    one = f"named_struct('frequency_text', x.f, 'value', {parts('x.f')}.value, 'unit', {parts('x.f')}.unit, 'comparator_text', if({chosen}.f is null, null, concat({chosen}.n, ' ', {chosen}.f)), 'population', {population})"
    made = f"transform(array({columns}), cols -> transform(filter(cols, x -> x.own and x.f is not null), x -> {one}))[0]"
    return f"if(size({headers}) = size({cells}) and size({headers}) > 0, {made}, cast(array() as array<{VARIANT}>))"


def text_comparator(text: str) -> str:
    """SQL of the comparator that a text states, or null."""
    forward, reverse, often = pattern(R.COMPARATOR_THEN_VALUE), pattern(R.VERSUS_VALUE), pattern(R.MORE_OFTEN_WITH)
    value = f"regexp_extract(q.m, {forward}, 2)"
    span = span_of(text, "v", "q.at + length(q.m) - length(v)")
    holds = f"transform(array({value}), v -> v = '-' or transform(array({span}), s -> {role('s')} = 'comparator_frequency')[0])[0]"
    first = f"transform(filter({places(text, forward)}, q -> {holds}), q -> concat(initcap(regexp_extract(q.m, {forward}, 1)), ': ', {collapse(value)}))"
    return (
        f"coalesce(if({text} rlike {forward}, get({first}, 0), null), case when {text} rlike {reverse} then concat(initcap(regexp_extract({text}, {reverse}, 2)), ' ', regexp_replace(regexp_extract({text}, {reverse}, 1), '\\\\s', ''))"
        f" when {text} rlike {often} then concat(initcap(regexp_extract({text}, {often}, 1)), ' (frequency not stated)') end)"
    )


def text_variants(text: str, comparator: str) -> str:
    """SQL of one variant per share of a named population in a text."""
    share = pattern(R.SHARE_OF_POPULATION)
    zipped = f"zip_with(regexp_extract_all({text}, {share}, 1), regexp_extract_all({text}, {share}, 2), (f, p) -> named_struct('f', f, 'p', p))"
    f = collapse("x.f")
    return f"transform({zipped}, x -> named_struct('frequency_text', {f}, 'value', {parts(f)}.value, 'unit', {parts(f)}.unit, 'comparator_text', {comparator}, 'population', array({collapse('x.p')})))"


__all__ = ["SPAN", "VARIANT", "cell_frequency", "comparator_name", "frequencies", "has_any", "header_matches", "parts", "places", "role", "spans", "table_variants", "text_comparator", "text_variants"]

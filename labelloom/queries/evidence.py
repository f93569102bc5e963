"""Queries of chunk quality and of the evidence rules over the label tables, with their SQL.

The SQL is for an engine without look-around in patterns: bounds of words are
spelled out, and places of matches are found by splitting at them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import assertion as A
from labelloom.functions import numeric as N
from labelloom.functions import rules as R
from labelloom.functions import text as X
from labelloom.plans import analyze, extract, quality, rollup
from labelloom.queries.labels import EVIDENCE, KEY, LABEL, PRIORITY, STATUS, drugs_of_labels, evidence, joined, query, selected_labels
from labelloom.session import load
from labelloom.sources import spl


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "label_chunk").withColumn("set_id", F.lower("set_id"))


# ---------------------------------------------------------------- quality of chunks

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
_clean = lambda x: f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F))
BOLD = "".join(chr(c) for c in range(0x1D400, 0x1D434)), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_sql = lambda s: "'" + s.replace("'", "''") + "'"


def fold_sql(x: str) -> str:
    """Compatibility form of wide and bold letters and of ligatures, as far as the tables hold them, without case and signs."""
    out = f"translate(translate({x}, {_sql(WIDE[0])}, {_sql(WIDE[1])}), {_sql(BOLD[0])}, {_sql(BOLD[1])})"
    for joint, apart in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = f"replace({out}, '{joint}', '{apart}')"
    return f"trim(regexp_replace(lower(nfc_normalize({out})), '[^\\p{{L}}\\p{{N}}%]+', ' ', 'g'))"


_heads = "list_filter(list_distinct(list_concat([section_title, subsection_title], string_split(subsection_title, '>'))), lambda h: h is not null)"
NORM = f"""f as (select * replace (lower(set_id) as set_id), {fold_sql("coalesce(text, '')")} t, list_filter(list_transform({_heads}, lambda h: {fold_sql('h')}), lambda h: length(h) > 0) hs from label_chunk),
n as (select *, case when len(hs) = 0 then t else trim(regexp_replace(t, concat('^(?:(?:', array_to_string(list_transform(list_sort(list_transform(hs, lambda h: {{'n': -length(h), 'h': h}})), lambda s: s.h), '|'), ')(?: |$))+'), '')) end norm from f)"""
ORDER = "chunk_index nulls first, source_path nulls first, chunk_id"
CHECKED = f"""{NORM}, st as (select *, case when norm = '' then 'empty' when row_number() over (partition by set_id, retrieved_at, norm order by {ORDER}) > 1 then 'duplicate' else 'kept' end state from n)"""


@query(
    f"""with {CHECKED}, k as (select *, row_number() over (partition by set_id, retrieved_at order by {ORDER}) - 1 new_index, sha256(concat_ws(chr(31), coalesce(set_id, ''), coalesce(section_code, ''), coalesce(source_path, ''), norm)) new_hash from st where state = 'kept')
select chunk_id, new_index, new_hash, lower(chunk_hash) = new_hash hash_holds from k"""
)
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks kept by quality assurance with their new index and hash, and whether the delivered hash was right."""
    df = quality.checked(chunks(spark, sf_dir)).filter("state = 'kept'")
    return df.select("chunk_id", F.col("new_index").cast("bigint"), "new_hash", (F.lower("chunk_hash") == F.col("new_hash")).alias("hash_holds"))


@query(
    f"""with {CHECKED} select set_id, retrieved_at, count(distinct (section_code, section_title, subsection_title)) section_count, count(*) total_chunks, count(*) filter (state = 'kept') unique_chunks, count(*) filter (state = 'duplicate') duplicate_chunks, count(*) filter (state = 'empty') empty_chunks,
  count(*) filter (state = 'duplicate') / count(*) duplicate_rate, coalesce(min(length(text)) filter (state = 'kept'), 0)::bigint minimum_characters, coalesce(median(length(text)) filter (state = 'kept'), 0)::double median_characters, coalesce(quantile_cont(length(text), 0.9) filter (state = 'kept'), 0)::double p90_characters,
  coalesce(max(length(text)) filter (state = 'kept'), 0)::bigint maximum_characters, count(*) filter (state = 'kept' and length(text) > 2000) chunks_over_2000_characters, count(*) filter (state = 'kept' and length(text) > 5000) chunks_over_5000_characters from st group by set_id, retrieved_at"""
)
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of every delivered document's chunks; text is compared in compatibility form without headings."""
    df = quality.diagnostics(chunks(spark, sf_dir))
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("minimum_characters", "maximum_characters")})


TYPES = ", ".join(f"'{t}'" for t in R.SEARCHABLE_TYPES)
SEARCHABLE = f"""{NORM}, sr as (select *, row_number() over (partition by set_id, retrieved_at, norm order by {ORDER}) dup from n where chunk_type in ({TYPES}) and {KEY} <> 'other' and norm <> ''),
ps as (select *, row_number() over (partition by set_id, retrieved_at order by {ORDER}) pos, case when chunk_type = 'list_item' then regexp_replace(source_path, '/item\\[[^/]*$', '') end lst from sr where dup = 1)"""


@query(
    f"""with {SEARCHABLE}, b as (select i.chunk_id, i.set_id, i.retrieved_at, i.section_code, i.section_title, i.subsection_title, max(r.pos) place from ps i join ps r on r.set_id = i.set_id and r.retrieved_at = i.retrieved_at and r.pos < i.pos
  and not (r.chunk_type = 'list_item' and r.lst is not distinct from i.lst and r.section_code is not distinct from i.section_code and r.section_title is not distinct from i.section_title and r.subsection_title is not distinct from i.subsection_title) where i.chunk_type = 'list_item' group by all)
select b.chunk_id, p.text parent_context from b join ps p on p.set_id = b.set_id and p.retrieved_at = b.retrieved_at and p.pos = b.place
where p.chunk_type = 'paragraph' and p.section_code is not distinct from b.section_code and p.section_title is not distinct from b.section_title and p.subsection_title is not distinct from b.subsection_title and p.text is not null"""
)
def parent_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items with the paragraph that introduces their list in the same document."""
    return extract.parent_context(extract.searchable(chunks(spark, sf_dir))).filter("parent_context is not null").select("chunk_id", "parent_context")


# ---------------------------------------------------------------- sentences, clauses, mentions

_guarded = _clean("text")
for _short in ("e.g.", "i.e.", "U.S.", "Dr."):
    _guarded = f"replace({_guarded}, '{_short}', '{_short.replace('.', chr(0xE000))}')"
_guarded = f"regexp_replace({_guarded}, '\\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St)\\.( [A-Z])', '\\1{chr(0xE000)}\\2', 'g')"
_sentences = f"list_filter(list_transform(string_split(regexp_replace({_guarded}, '([.!?]) ([A-Z0-9])', concat('\\1', chr(10), '\\2'), 'g'), chr(10)), lambda s: trim(replace(s, '{chr(0xE000)}', '.'))), lambda s: length(s) > 0)"
_clauses = "list_filter(list_transform(string_split_regex(s, '\\s*;\\s*'), lambda c: regexp_replace(trim(c), '(?i)^(?:and|but|while|whereas)\\s+', '')), lambda c: length(c) > 0)"
def _clause_sql(table: str, more: str = "") -> str:
    return f"""se as (select chunk_id, set_id, section_code, section_title, subsection_title{more}, unnest({_sentences}) s, unnest(range(len({_sentences})))::int sentence_index from {table}),
cc as (select *, unnest({_clauses}) c, unnest(range(len({_clauses})))::int clause_index from se)"""


CLAUSES = _clause_sql("label_chunk")


@query(f"with {CLAUSES} select chunk_id, sentence_index, clause_index, c clause from cc")
def sentence_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause of every sentence of the chunks."""
    df = load(spark, sf_dir, "label_chunk").select("chunk_id", F.posexplode(F.expr(X.sentences("text"))).alias("sentence_index", "s"))
    return df.select("chunk_id", "sentence_index", F.posexplode(F.expr(X.clauses("s"))).alias("clause_index", "clause"))


EDGE = r"[^\pL\pM\p{Nd}\p{Pc}\x{200c}\x{200d}]"
_term = lambda t: t.replace(" ", r"\s+")
_names = lambda text, t: f"regexp_matches({text}, '(?i)(^|{EDGE}){_term(t)}({EDGE}|$)')"
_first = lambda terms: "case " + " ".join(f"when {_names('c', t)} then '{t}'" for t in terms) + " end" if terms else "null::varchar"
HITS = f"""hits as ({" union all ".join(f"select *, '{e}' normalized_event, {_first(d)} d, {_first(r)} r from cc" for e, (d, r) in R.EVENTS.items())}),
direct as (select *, bool_or(d is not null) over (partition by chunk_id, normalized_event) direct from hits where d is not null or r is not null),
mn as (select *, case when direct then d else r end matched_term from direct where case when direct then d else r end is not null)"""
MENTIONS = f"{CLAUSES}, {HITS}"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.mentions(chunks(spark, sf_dir), [extract.event_plan(e) for e in R.EVENTS])


@query(f"with {MENTIONS} select chunk_id, normalized_event, sentence_index, clause_index, matched_term, direct, s sentence, c clause from mn")
def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that name an event of the rules: by a direct term or, in chunks without one, by a related term."""
    return mentions(spark, sf_dir).select("chunk_id", "normalized_event", "sentence_index", "clause_index", "matched_term", "direct", "sentence", "clause")


# ---------------------------------------------------------------- verdicts

_t = "replace(matched_term, ' ', '\\s+')"
_d = "regexp_escape(drug_name)"


def _pattern(template: str) -> str:
    """SQL of a pattern in which {t} and {d} stand for the term and the drug."""
    parts = _sql("(?i)" + template)
    return "concat(" + parts.replace("{t}", f"', {_t}, '").replace("{d}", f"', {_d}, '") + ", '')"


def _has(text: str, template: str) -> str:
    return f"regexp_matches({text}, {_pattern(template)})"


_any = lambda text, templates: "(" + " or ".join(_has(text, p) for p in templates) + ")"
_word = lambda text, w: f"regexp_matches({text}, concat('(?i)(^|{EDGE})', {w}, '({EDGE}|$)'))"
CORE = "|".join(f"(?:{p})" for p in R.CORE_INTERACTIONS)
_SCOPED = f"""md as (select mn.* exclude (set_id), dg.*, {KEY.replace('section_code', 'mn.section_code')} = 'drug_interactions' isec from mn join dg on dg.set_id = lower(mn.set_id))"""
_VERDICT = f"""pl as (select *, coalesce(list_filter(string_split(c, ';'), lambda x: {_word('x', _t)})[1], c) own, length(regexp_extract(c, concat('(?is)^(|.*?{EDGE})', {_t}, '(?:{EDGE}|$)'), 1)) + 1 a,
  length(regexp_extract(c, concat('(?i)(?:^|{EDGE})(', {_t}, ')(?:{EDGE}|$)'), 1)) tl, case when regexp_matches(c, {_sql('(?i)' + CORE)}) then length(regexp_extract(c, {_sql('(?is)^(.*?)(?:' + CORE + ')')}, 1)) + 1 end i from md),
ed as (select *, substring(c, a + tl, i - a - tl) btw from pl),
eb as (select *, case when a < i and {_has('btw', R.CLAUSE_BOUNDARY)} then left(c, a + tl - 1 + length(regexp_extract(btw, {_sql('(?is)^(.*?)' + R.CLAUSE_BOUNDARY)}, 1))) end prim from ed),
vd as (select *, case when {_any('own', R.NEGATED)} then 'negated' when {_has('c', R.COMPARATOR_ONLY)} then 'comparator_only'
  when (isec or i is not null) and not coalesce({_word('prim', _d)} or {_has('prim', R.DRUG_EFFECT)}, false) then 'interaction_dependent'
  when ({_has('c', r'\b{t}\b')} and (contains(lower(c), 'underlying condition') or {_any('c', R.HISTORICAL)})) or (({_has('cx', R.HISTORICAL_PARENT)} or {_has('cx', R.HISTORICAL_DRUG)}) and {_has('cx', r'\b{t}\b')}) then 'historical_or_preexisting'
  when {_any('c', R.DESCRIPTIVE)} or not direct then 'related_but_not_explicit' else 'explicit_positive' end evidence_status from eb)"""
VERDICTS = f"""{MENTIONS}, {LABEL}, dg as (select lower(selected_spl_set_id) set_id, rxcui, requested_name drug_name from label where label_match_confidence <> 'low'), {_SCOPED.replace("isec from", "isec, s cx from")}, {_VERDICT}"""


@query(
    f"""with {VERDICTS} select chunk_id, rxcui, normalized_event, sentence_index, clause_index, evidence_status, case evidence_status when 'negated' then 'absent' when 'interaction_dependent' then 'conditional' when 'historical_or_preexisting' then 'historical' when 'related_but_not_explicit' then 'uncertain' else 'present' end assertion,
  case evidence_status when 'comparator_only' then 'comparator' when 'historical_or_preexisting' then 'patient_history' when 'related_but_not_explicit' then 'unclear' when 'interaction_dependent' then case when {_has('c', R.CONCOMITANT_SUBJECT)} then 'concomitant_drug' else 'selected_drug' end
    when 'explicit_positive' then case when not {_word('c', _d)} and {_has('c', R.CLASS_STATEMENT)} then 'general_class_statement' else 'selected_drug' end else 'selected_drug' end subject,
  case when evidence_status = 'related_but_not_explicit' then 'medium' else 'high' end extraction_confidence from vd"""
)
def mention_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, assertion, subject and confidence of every mention of a drug's label, before its route is looked at."""
    df = mentions(spark, sf_dir).join(drugs_of_labels(spark, sf_dir), "set_id")
    df = df.withColumn("isec", F.expr(f"{A.section_key('section_code')} = 'drug_interactions'"))
    df = df.withColumn("v", F.expr(A.classify("clause", "matched_term", "drug_name", "direct", "isec", "sentence")))
    return df.select("chunk_id", "rxcui", "normalized_event", "sentence_index", "clause_index", "v.*")


RULES = {
    "negated": (_any("c", R.NEGATED), lambda: A.negated("clause", "matched_term")),
    "historical": (f"({_has('c', r'\b{t}\b')} and (contains(lower(c), 'underlying condition') or {_any('c', R.HISTORICAL)}))", lambda: A.historical("clause", "matched_term")),
    "historical_parent": (f"(({_has('s', R.HISTORICAL_PARENT)} or {_has('s', R.HISTORICAL_DRUG)}) and {_has('s', r'\b{t}\b')})", lambda: A.historical_parent("sentence", "matched_term", "drug_name")),
    "descriptive": (_any("c", R.DESCRIPTIVE), lambda: X.has_any("clause", R.DESCRIPTIVE, t=X.quoted("matched_term"))),
    "secondary": (f"coalesce({_word('prim', _d)} or {_has('prim', R.DRUG_EFFECT)}, false)", lambda: A.secondary_interaction("clause", "matched_term", "drug_name")),
    "class_statement": (f"(not {_word('c', _d)} and {_has('c', R.CLASS_STATEMENT)})", lambda: f"(not clause rlike {X.term_pattern('drug_name')} and {X.has('clause', R.CLASS_STATEMENT)})"),
}


@query(f"with {VERDICTS} select chunk_id, rxcui, normalized_event, sentence_index, clause_index, {', '.join(f'{sql} {name}' for name, (sql, _) in RULES.items())} from vd")
def mention_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the single rules hold for every mention."""
    df = mentions(spark, sf_dir).join(drugs_of_labels(spark, sf_dir), "set_id")
    return df.select("chunk_id", "rxcui", "normalized_event", "sentence_index", "clause_index", *[F.coalesce(F.expr(rule()), F.lit(False)).alias(name) for name, (_, rule) in RULES.items()])


def _all(text: str, patterns: tuple[str, ...]) -> str:
    """SQL of the distinct matches in order of patterns, then of places, joined."""
    every = f"list_filter(list_transform(flatten([{', '.join(f'regexp_extract_all({text}, {_sql("(?i)" + p)})' for p in patterns)}]), lambda m: trim(m)), lambda m: length(m) > 0)"
    return f"array_to_string(list_filter({every}, lambda m, i: list_position({every}, m) = i), '|')"


CONTEXTS = {"population": R.POPULATIONS, "dose": R.DOSES, "temporal": R.TIMES}


@query(f"with {MENTIONS} select chunk_id, normalized_event, sentence_index, clause_index, {', '.join(f'{_all("c", p)} {n}' for n, p in CONTEXTS.items())}, case when {KEY} = 'drug_interactions' or regexp_matches(s, {_sql('(?i)' + CORE)}) then {_all('s', R.INTERACTIONS)} else '' end interaction from mn")
def mention_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations, doses, times and interactions that each mention's clause and sentence state."""
    df = mentions(spark, sf_dir).withColumn("isec", F.expr(f"{A.section_key('section_code')} = 'drug_interactions'"))
    parts = [F.array_join(F.expr(X.extract_all("clause", p)), "|").alias(n) for n, p in CONTEXTS.items()]
    return df.select("chunk_id", "normalized_event", "sentence_index", "clause_index", *parts, F.array_join(F.expr(A.interaction_context("sentence", "isec")), "|").alias("interaction"))


# ---------------------------------------------------------------- routes

_centre = "2 * (length(regexp_extract(c, concat('(?is)^(|.*?" + EDGE + ")', " + _t + ", '(?:" + EDGE + "|$)'), 1))) + length(regexp_extract(c, concat('(?i)(?:^|" + EDGE + ")(', " + _t + ", ')(?:" + EDGE + "|$)'), 1))"
_clue = lambda i, clue, route, p: f"select chunk_id, normalized_event, sentence_index, clause_index, centre, '{clue}' clue, '{route}' route, unnest(regexp_extract_all(c, {_sql('(?i)' + p)})) m, unnest(range(1, len(regexp_extract_all(c, {_sql('(?i)' + p)})) + 1)) k, string_split_regex(c, {_sql('(?i)' + p)}) pieces, regexp_extract_all(c, {_sql('(?i)' + p)}) ms from mc"
ROUTES = f"""{MENTIONS}, mc as (select *, {_centre} centre from mn), cl as ({" union all ".join(_clue(i, *clue) for i, clue in enumerate(R.ROUTE_CLUES))}),
pc as (select *, list_sum(list_transform(pieces[1:k], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0)::bigint place from cl),
nr as (select chunk_id, normalized_event, sentence_index, clause_index, arg_min(route, (abs(2 * place + length(m) - centre), place, place + length(m), clue, route)) route from pc group by all)"""


@query(f"with {ROUTES}, cs as (select chunk_id, normalized_event, sentence_index, clause_index, any_value(nr.route) route, string_agg(distinct clue, '|' order by clue) clues from pc join nr using (chunk_id, normalized_event, sentence_index, clause_index) where pc.route = nr.route group by all) select * from cs")
def mention_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route whose clue stands nearest to each mention in its clause, with all clues of that route."""
    df = mentions(spark, sf_dir).withColumn("m", F.expr(A.route_matches("clause")))
    df = df.withColumn("r", F.expr(A.nearest_route("m", "clause", "matched_term"))).filter("size(r) > 0")
    clues = F.array_sort(F.array_distinct(F.transform(F.filter("m", lambda m: m["route"] == F.col("r")[0]), lambda m: m["clue"])))
    return df.select("chunk_id", "normalized_event", "sentence_index", "clause_index", F.col("r")[0].alias("route"), F.array_join(clues, "|").alias("clues"))


_routes = lambda x: f"list_filter(['oral', 'topical', 'ophthalmic', 'inhaled', 'intravenous', 'intramuscular', 'subcutaneous', 'transdermal'], lambda r: list_contains({x}, r))"
_found = lambda x: "list_filter([" + ", ".join(f"case when regexp_matches({x}, {_sql('(?i)' + p)}) then '{c}' end" for c, _, p in R.ROUTE_CLUES) + "], lambda v: v is not null)"
_of = lambda x: "list_distinct(list_filter([" + ", ".join(f"case when list_contains({x}, '{c}') then '{r}' end" for c, r, _ in R.ROUTE_CLUES) + "], lambda v: v is not null))"
_forms = lambda x: f"list_filter({x}, lambda v: v in ('gel', 'cream', 'tablet', 'capsule'))"


@query(
    f"""with k as (select chunk_id, {_found('text')} a, {_found("concat_ws(' ', subsection_title, section_title)")} b from label_chunk), r as (select *, {_of('a')} ra, {_of('b')} rb from k)
select chunk_id, case when len(ra) = 0 then 'unrestricted_route' when len(rb) = 0 then 'ambiguous_route' when len(list_intersect(ra, rb)) = 0 then 'route_mismatch' when len({_forms('a')}) > 0 and len({_forms('b')}) > 0 and len(list_intersect({_forms('a')}, {_forms('b')})) = 0 then 'route_mismatch' else 'matching_route' end applicability from r"""
)
def route_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the routes that a chunk's text names fit those of its headings."""
    clues = lambda text: f"transform({A.route_matches(text)}, m -> m.clue)"
    routes = lambda text: f"transform({A.route_matches(text)}, m -> m.route)"
    df = load(spark, sf_dir, "label_chunk").withColumn("heads", F.concat_ws(" ", "subsection_title", "section_title"))
    df = df.withColumns({"a": F.expr(f"concat({routes('text')}, {clues('text')})"), "b": F.expr(f"concat({routes('heads')}, {clues('heads')})")})
    return df.select("chunk_id", F.expr(A.applicability("a", "b")).alias("applicability"))


# ---------------------------------------------------------------- numbers

# digits and spaces of any kind count as plain ones; each stays one character, so places stay the same
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_plain = f"translate(supporting_quote, '０１２３４５６７８９{_SPACES}', '0123456789{' ' * len(_SPACES)}')"
# a ratio that ends its sentence is none, nor is one that goes on behind a point; its slash is blotted out
_blotted = "regexp_replace(" + _plain + ", '([0-9]\\s*)/(\\s*[0-9][0-9,]*(?:[.][0-9]+)?[.](?:$|[^0-9]))', '\\1\\x02\\2', 'g')".replace("\\x02", "\x02")
_frequency = R.FREQUENCY.replace(r"(?<![\d.])", "").replace(r"(?![\d.])", "")
_whole = lambda p: p.replace("(?<!\\w)", "").replace("(?!\\w)", "")
_w = R.WINDOWS
_rb, _la = (lambda n: f"right(cb, {_w[n]})"), (lambda n: f"left(ca, {_w[n]})")
_m = lambda text, p: f"regexp_matches({text}, {_sql('(?i)' + p)})"
_population = _m("m", R.POPULATION_RATIO)
_ratio = f"(contains(m, '/') and not {_population})"
_near = f"(length(trim(coalesce(matched_term, ''))) > 0 and ({_word(_rb('event'), _t)} or {_word(_la('event'), _t)}))"
ROLE = f"""case when lower(m) in ('common', 'uncommon', 'rare', 'rarely', 'frequency cannot be estimated') then 'event_frequency'
  when contains(m, '%') and ({_m('cb', R.STRENGTH_BEFORE)} or {_m('ca', R.STRENGTH_AFTER)} or {_m('ca', R.COMPOSITION_AFTER)} or {_m(_rb('composition'), R.COMPOSITION)}) then 'product_strength'
  when ({_ratio} and {_m(f"concat(right(bf, {_w['pressure']}), m, left(af, {_w['pressure']}))", R.BLOOD_PRESSURE)}) or {_m(f"concat({_rb('vital_before')}, m, {_la('vital_after')})", R.LAB_OR_VITAL)} then 'laboratory_or_vital_value'
  when not {_population} and (({_ratio} and {_m(f"concat(right(bf, {_w['pressure']}), m, left(af, {_w['ratio_after']}))", R.DOSE_CONTEXT)}) or {_m(f"concat({_rb('dose')}, m, {_la('dose')})", R.ADMINISTERED)}) then 'administered_dose'
  when {_m('m', rf'\b{R.PEOPLE}\b')} and case when {_m(_la('sample_after'), R.SAMPLE_THEN_COUNT)} then true when {_m(_la('sample_after'), R.OUTCOME)} then false else {_m(_rb('sample_before'), R.SAMPLE_CUE)} or {_m(_la('sample_after'), R.RECEIVED)} end then 'sample_size'
  when {_m(_rb('comparator'), R.COMPARATOR_BEFORE)} or {_m(_la('comparator'), R.COMPARATOR_AFTER)} then 'comparator_frequency'
  when {_m('m', R.CASES_PER_CUE)} or {_m('m', R.OF_PATIENTS_CUE)} or {_population} or {_m('ca', R.OF_PEOPLE_AFTER)} or {_m(_rb('cue_before'), R.FREQUENCY_CUE)} or {_m(_la('outcome_after'), R.OUTCOME)} or {_near} then 'event_frequency' else 'ambiguous_numeric_value' end"""
SPANS = f"""x as (select item_id, matched_term, supporting_quote o, {_plain} q, regexp_extract_all({_blotted}, {_sql('(?i)' + _frequency)}) ms, string_split_regex({_blotted}, {_sql('(?i)' + _frequency)}) pieces from evidence_item),
y as (select item_id, matched_term, o, q, ms, pieces, unnest(range(1, len(ms) + 1)) k from x),
z as (select *, list_sum(list_transform(pieces[1:k], lambda v: length(v)))::int + coalesce(list_sum(list_transform(ms[1:k-1], lambda v: length(v))), 0)::int place, length(ms[k]) n from y),
sp as (select item_id, matched_term, k - 1 span_no, place, substring(o, place + 1, n) shown, substring(q, place + 1, n) m, left(q, place) bf, substring(q, place + n + 1) af from z),
sc as (select *, regexp_extract(bf, '[^.;|\\n]*$') cb, regexp_extract(af, '^[^.;|\\n]*') ca from sp)"""


@query(f"with {SPANS} select item_id, span_no::int span_no, shown span, place as \"at\", {ROLE} as role from sc")
def numeric_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number or frequency word of the quotes with its role."""
    df = load(spark, sf_dir, "evidence_item").select("item_id", "matched_term", "supporting_quote")
    df = df.select("item_id", "matched_term", F.posexplode(F.expr(N.spans("supporting_quote"))).alias("span_no", "s"))
    return df.select("item_id", "span_no", F.col("s.m").alias("span"), F.length("s.before").alias("at"), F.expr(N.role("s", "nullif(trim(matched_term), '')")).alias("role"))


_q = lambda template: "concat(" + _sql("(?i)" + template).replace("{t}", f"', {_t}, '").replace("{q}", "', m, '") + ", '')"
BEFORE = rf"(?:^|{EDGE}){{q}}\s+(?:(?:cases?|events?|reports?)\s+of\s+)?{{t}}(?:{EDGE}|$)"
AFTER = rf"(?:^|{EDGE}){{t}}(?:(?:[^.;]{{0,60}}?\b(?:reported|observed|seen|occurred|occurs|occurring)\b[^.;]{{0,20}}?|\s+\b(?:is|are|was|were)\b\s+)){{q}}(?:{EDGE}|$)"
_binds = f"(lower(m) not in ('common', 'uncommon', 'rare', 'rarely') or regexp_matches(concat(bf, m, af), {_q(BEFORE)}) or regexp_matches(concat(bf, m, af), {_q(AFTER)}))"
_tidy = f"case when lower({_clean('shown')}) in ('common', 'uncommon', 'rare', 'rarely') then lower({_clean('shown')}) else {_clean('shown')} end"


@query(f"with {SPANS}, r as (select *, {ROLE} as role from sc where length(trim(matched_term)) > 0) select item_id, string_agg({_tidy}, '|' order by span_no) frequencies, count(*)::int n from r where role = 'event_frequency' and {_binds} group by item_id")
def event_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequencies that each quote states of its event; words such as rare must be bound to it."""
    df = load(spark, sf_dir, "evidence_item").filter("length(trim(matched_term)) > 0").select("item_id", F.expr(N.frequencies("supporting_quote", "matched_term")).alias("f")).filter("size(f) > 0")
    return df.select("item_id", F.array_join("f", "|").alias("frequencies"), F.size("f").alias("n"))


_role = ROLE.replace(f" or {_near}", "")
_forward = f"regexp_extract_all(supporting_quote, {_sql('(?i)' + R.COMPARATOR_THEN_VALUE)}"
COMPARED = f"""x as (select item_id, supporting_quote q, {_forward}) ms, {_forward}, 1) ws, {_forward}, 2) vs, string_split_regex(supporting_quote, {_sql('(?i)' + R.COMPARATOR_THEN_VALUE)}) pieces from evidence_item),
y as (select *, unnest(range(1, len(ms) + 1)) k from x), z as (select *, list_sum(list_transform(pieces[1:k], lambda v: length(v)))::int + coalesce(list_sum(list_transform(ms[1:k-1], lambda v: length(v))), 0)::int + length(ms[k]) - length(vs[k]) place from y),
sp as (select item_id, k, ws[k] w, vs[k] m, left(q, place) bf, substring(q, place + length(vs[k]) + 1) af, null::varchar matched_term from z), sc as (select *, regexp_extract(bf, '[^.;|\\n]*$') cb, regexp_extract(af, '^[^.;|\\n]*') ca from sp),
fw as (select item_id, arg_min(concat(upper(left(w, 1)), lower(substring(w, 2)), ': ', {_clean('m')}), k) c from (select *, {_role} as role from sc) where m = '-' or role = 'comparator_frequency' group by item_id)"""
_cap = lambda x: f"concat(upper(left({x}, 1)), lower(substring({x}, 2)))"
_versus = lambda i: f"regexp_extract(supporting_quote, {_sql('(?i)' + R.VERSUS_VALUE)}, {i})"
_often = f"regexp_extract(supporting_quote, {_sql('(?i)' + R.MORE_OFTEN_WITH)}, 1)"


@query(
    f"""with {COMPARED}, o as (select item_id, coalesce(c, case when {_m('supporting_quote', R.VERSUS_VALUE)} then concat({_cap(_versus(2))}, ' ', replace({_versus(1)}, ' ', '')) when {_m('supporting_quote', R.MORE_OFTEN_WITH)} then concat({_cap(_often)}, ' (frequency not stated)') end) comparator from evidence_item left join fw using (item_id))
select * from o where comparator is not null"""
)
def text_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparator that each quote states, with its value if it has one."""
    df = load(spark, sf_dir, "evidence_item").select("item_id", F.expr(N.text_comparator("supporting_quote")).alias("comparator"))
    return df.filter("comparator is not null")


_tokens = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
_own = f"list_filter({_tokens('nm')}, lambda t: length(t) > 2 and t not in ({', '.join(repr(w) for w in R.HEADER_IGNORED)}))"
_kind = "case " + " ".join(f"when {_m('h', p)} then '{n}'" for p, n in R.COMPARATOR_NAMES) + " end"


@query(
    f"""with {LABEL}, dg as (select lower(selected_spl_set_id) set_id, rxcui, requested_name nm from label where label_match_confidence <> 'low'), hd as (select chunk_id, lower(set_id) set_id, unnest(column_headers) h, unnest(range(len(column_headers)))::int column_no from label_chunk where len(column_headers) > 0)
select chunk_id, rxcui, column_no, h header, {_kind} comparator, len({_own}) > 0 and len(list_filter({_own}, lambda t: not list_contains({_tokens('h')}, t))) = 0 names_drug from hd join dg using (set_id) where h is not null"""
)
def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each column header of a label's tables names: a comparator, or the label's drug."""
    drugs = drugs_of_labels(spark, sf_dir).select("set_id", "rxcui", "drug_name")
    df = chunks(spark, sf_dir).select("chunk_id", "set_id", F.posexplode("column_headers").alias("column_no", "header")).filter("header is not null").join(drugs, "set_id")
    return df.select("chunk_id", "rxcui", "column_no", "header", F.expr(N.comparator_name("header")).alias("comparator"), F.expr(N.header_matches("header", "array(drug_name)")).alias("names_drug"))


_cell = f"case when {_m('cell', R.CELL_PERCENT)} or cell in ('-', '—', '–') then cell when {_m('h', R.HEADER_PERCENT)} and {_m('cell', R.CELL_NUMBER)} then concat(cell, '%') end"


@query(
    f"""with {LABEL}, dg as (select lower(selected_spl_set_id) set_id, rxcui, list_concat([requested_name], coalesce(generic_names, [])) ns from label where label_match_confidence <> 'low'),
tb as (select chunk_id, lower(set_id) set_id, unnest(column_headers) h, {_clean("coalesce(unnest(row_cells), '')")} cell, unnest(range(len(column_headers))) i from label_chunk where chunk_type = 'table_row' and len(column_headers) = len(row_cells) and len(column_headers) > 0),
tc as (select *, {_cell} f, {_kind} k from tb), ow as (select tc.*, rxcui from tc join dg using (set_id) where i > 0 and f is not null and len(list_filter(ns, lambda nm: len({_own}) > 0 and len(list_filter({_own}, lambda t: not list_contains({_tokens('h')}, t))) = 0)) > 0),
cp as (select ow.chunk_id, ow.rxcui, ow.i, arg_min(concat(o.k, ' ', o.f), o.i) filter (o.f is not null) any_c, min(o.i) first_i, min(o.i) filter (o.f is not null) first_f, arg_min({{'k': o.k, 'f': o.f}}, o.i) c from ow join tc o on o.chunk_id = ow.chunk_id and o.i <> ow.i and o.k is not null group by all)
select ow.chunk_id, ow.rxcui, ow.i::int column_no, ow.f frequency_text, try_cast(regexp_extract(ow.f, '([0-9]+([.][0-9]+)?)', 1) as double) as value, case when c.f is not null then concat(c.k, ' ', c.f) end comparator_text from ow left join cp on cp.chunk_id = ow.chunk_id and cp.rxcui = ow.rxcui and cp.i = ow.i"""
)
def table_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequency in each column of a table row that names the label's drug, with that of the comparator's column."""
    df = chunks(spark, sf_dir).filter("chunk_type = 'table_row'").join(drugs_of_labels(spark, sf_dir), "set_id")
    none = "cast(array() as array<string>)"
    df = df.withColumn("v", F.expr(N.table_variants(f"coalesce(column_headers, {none})", f"coalesce(row_cells, {none})", "drug_names")))
    # variants come in order of the drug's columns with a frequency
    own = F.expr(f"filter(transform(column_headers, (h, i) -> if(i > 0 and {N.header_matches('h', 'drug_names')} and {N.cell_frequency('h', 'get(row_cells, i)')} is not null, i, null)), i -> i is not null)")
    df = df.filter("size(v) > 0").withColumn("o", own).select("chunk_id", "rxcui", F.posexplode("v").alias("n", "x"), "o")
    return df.select("chunk_id", "rxcui", F.get("o", F.col("n")).alias("column_no"), "x.frequency_text", "x.value", "x.comparator_text")


_share = lambda i: f"regexp_extract_all(supporting_quote, {_sql('(?i)' + R.SHARE_OF_POPULATION)}, {i})"


@query(f"select item_id, array_to_string(list_transform(list_zip({_share(1)}, {_share(2)}), lambda z: concat({_clean('z[1]')}, ' of ', {_clean('z[2]')})), '|') variants from evidence_item where len({_share(0)}) > 0")
def population_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of named populations that a quote states, one variant each."""
    df = load(spark, sf_dir, "evidence_item").select("item_id", F.expr(N.text_variants("supporting_quote", "cast(null as string)")).alias("v")).filter("size(v) > 0")
    return df.select("item_id", F.array_join(F.transform("v", lambda v: F.concat(v["frequency_text"], F.lit(" of "), v["population"][0])), "|").alias("variants"))


# ---------------------------------------------------------------- whole analyses

EVENT = "low blood pressure"


def analysis_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drugs in use, their selected labels (those without parsed XML have no sections here) and the chunks."""
    usage = load(spark, sf_dir, "drug_usage")
    drugs = usage.groupBy("member.rxcui").agg(F.min("member.name").alias("drug_name"), F.array_distinct(F.flatten(F.collect_list("cms_generic_names"))).alias("cms_generic_names"), F.lit(0).alias("rank"))
    labels = selected_labels(spark, sf_dir).withColumns({"selected_label_product": F.lit(None).cast("map<string,string>"), "sections": F.create_map(F.lit("warnings"), F.lit(" "), F.lit("contraindications"), F.concat(F.lit("Do not give "), "requested_name", F.lit(" in known hypotension.")))})
    return drugs, labels, chunks(spark, sf_dir)


_alone = lambda x: f"(select case when count(distinct route) = 1 then any_value(route) end from (select unnest([{', '.join(f"case when regexp_matches({x}, {_sql('(?i)' + p)}) then '{r}' end" for _, r, p in R.ROUTE_CLUES)}]) route) where route is not null)"
ANALYSIS = f"""{SEARCHABLE}, {LABEL}, us as (select member.rxcui rxcui, min(member.name) drug_name, string_agg(array_to_string(cms_generic_names, ' '), ' ') cms from drug_usage group by 1),
dg as (select lower(selected_spl_set_id) set_id, us.rxcui, drug_name, concat_ws(' ', drug_name, requested_name, cms, array_to_string(generic_names, ' '), array_to_string(brand_names, ' '), array_to_string(substance_names, ' ')) product, extraction_source = 'dailymed_spl_xml' parsed, coalesce(lower(label_match_confidence) <> 'low', false) usable, requested_name from us join label on label.rxcui = us.rxcui),
lp as (select i.chunk_id, max(r.pos) place from ps i join ps r on r.set_id = i.set_id and r.retrieved_at = i.retrieved_at and r.pos < i.pos and not (r.chunk_type = 'list_item' and r.lst is not distinct from i.lst and r.section_code is not distinct from i.section_code and r.section_title is not distinct from i.section_title
  and r.subsection_title is not distinct from i.subsection_title) where i.chunk_type = 'list_item' group by all),
pp as (select i.*, p.text parent from ps i left join lp using (chunk_id) left join ps p on p.set_id = i.set_id and p.retrieved_at = i.retrieved_at and p.pos = lp.place and p.chunk_type = 'paragraph' and p.section_code is not distinct from i.section_code and p.section_title is not distinct from i.section_title and p.subsection_title is not distinct from i.subsection_title),
src as (select pp.chunk_id, pp.set_id, rxcui, section_code, section_title, subsection_title, text, chunk_type, parent from pp join dg on dg.set_id = pp.set_id where parsed and usable
  union all select -row_number() over (order by rxcui), null, rxcui, '34070-3', 'Contraindications', null, concat('Do not give ', requested_name, ' in known hypotension.'), 'section_text', null from dg where usable and not parsed),
{_clause_sql('src', ', rxcui, chunk_type, parent')}, {HITS},
md as (select mn.* exclude (set_id, rxcui), dg.*, {KEY.replace('section_code', 'mn.section_code')} = 'drug_interactions' isec, case when chunk_type = 'list_item' and length(trim(parent)) > 0 then concat({_clean('parent')}, ' ', s) else s end cx, {_centre} centre from mn join dg on dg.rxcui = mn.rxcui where normalized_event = 'hypotension'), {_VERDICT},
mc as (select * from vd), cl as ({" union all ".join(_clue(i, *clue).replace("select chunk_id, normalized_event", "select chunk_id, rxcui, normalized_event") for i, clue in enumerate(R.ROUTE_CLUES))}),
pc as (select *, list_sum(list_transform(pieces[1:k], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0)::bigint place from cl),
nr as (select chunk_id, rxcui, sentence_index, clause_index, arg_min(route, (abs(2 * place + length(m) - centre), place, place + length(m), clue, route)) r1 from pc group by all),
rt as (select vd.*, coalesce(r1, {_alone('subsection_title')}, {_alone('section_title')}) rown, {_alone('product')} rother, case when r1 is not null then c when {_alone('subsection_title')} is not null then subsection_title else section_title end place_text from vd left join nr using (chunk_id, rxcui, sentence_index, clause_index)),
fi as (select *, {_forms(_found('place_text'))} fo, {_forms(_found('product'))} fp from rt), fit as (select *, case when rown is null then 'unrestricted_route' when rother is null then 'ambiguous_route' when rown <> rother then 'route_mismatch'
  when len(list_filter(fo, lambda f: rown = case when f in ('gel', 'cream') then 'topical' else 'oral' end)) > 0 and len(list_filter(fp, lambda f: rother = case when f in ('gel', 'cream') then 'topical' else 'oral' end)) > 0
    and len(list_intersect(list_filter(fo, lambda f: rown = case when f in ('gel', 'cream') then 'topical' else 'oral' end), list_filter(fp, lambda f: rother = case when f in ('gel', 'cream') then 'topical' else 'oral' end))) = 0 then 'route_mismatch' else 'matching_route' end fits from fi),
fs as (select rxcui, case when fits = 'route_mismatch' then 'insufficient_label_data' when fits = 'ambiguous_route' and evidence_status in ('explicit_positive', 'negated') then 'related_but_not_explicit' else evidence_status end evidence_status from fit),
bs as (select rxcui, list_min(list(list_position([{', '.join(f"'{v}'" for v in R.STATUSES)}], evidence_status))) p from fs group by rxcui), sd as (select distinct rxcui from src),
an as (select us.rxcui, case when bs.p is not null then [{', '.join(f"'{v}'" for v in R.STATUSES)}][bs.p] when sd.rxcui is not null then 'not_found' else 'insufficient_label_data' end evidence_status from us left join bs using (rxcui) left join sd using (rxcui))"""


@query(f"with {ANALYSIS} select * from an")
def drug_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every drug in use for one event, from its label's chunks through clauses, rules and routes; labels without parsed chunks by their sections."""
    return analyze.analyze(*analysis_input(spark, sf_dir), EVENT).drugs.select("rxcui", "evidence_status")


@query(
    f"""with {ANALYSIS}, c as (select count(*) n, count(*) filter (evidence_status = 'explicit_positive') x, count(*) filter (evidence_status = 'insufficient_label_data') i from an)
select n drugs_analyzed, x n_explicit_positive, i n_insufficient_label_data, case when n = 0 or 2 * i > n then 'insufficient_class_evidence' when x >= 2 and 3 * x >= 2 * n then 'consistent_label_evidence' when x >= 1 then 'partial_or_mixed_label_evidence' else 'no_explicit_mentions_found' end class_assessment from c"""
)
def class_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class row of the same analysis."""
    return analyze.analyze(*analysis_input(spark, sf_dir), EVENT).summary.select("drugs_analyzed", "n_explicit_positive", "n_insufficient_label_data", "class_assessment")


_hash = r"sha256(concat_ws('|', set_id, code, path, trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}%]+', ' ', 'g'))))"


@query(
    f"""with {LABEL}, s as (select rxcui, coalesce(selected_spl_set_id, 'openfda-set-id-unavailable') set_id, spl_version as version, coalesce(spl_effective_time, effective_time) effective_time, '34070-3' code, 'Contraindications' section_title, '/openfda/sections/contraindications' path, 4 chunk_index, concat('Do not give ', requested_name, ' in known hypotension.') as text from label)
select rxcui, set_id, version, effective_time, code section_code, section_title, chunk_index, text, path source_path, {_hash} chunk_hash from s"""
)
def fallback_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of labels' plain sections in their fixed order, blank ones left out."""
    df = analyze.fallback_chunks(analysis_input(spark, sf_dir)[1])
    return df.select("rxcui", "set_id", "version", "effective_time", "section_code", "section_title", "chunk_index", "text", "source_path", "chunk_hash")


NOTES = {"rules": rollup.NOTE_RULES, "none": rollup.NOTE_NO_LABEL, "low": rollup.NOTE_LOW, "fallback": rollup.NOTE_FALLBACK, "positive": rollup.NOTE_POSITIVE, "related": rollup.NOTE_RELATED, "absence": rollup.ABSENCE}
_note = {k: _sql(v) for k, v in NOTES.items()}


@query(
    f"""with {EVIDENCE}, {LABEL}, us as (select member.rxcui rxcui, min(member.name) drug_name from drug_usage group by 1), it as (select * from evidence where normalized_event = 'hypotension'),
st as (select rxcui, arg_min(evidence_status, {PRIORITY.replace(STATUS, 'evidence_status')}) s, count(*) n from it group by rxcui), qs as (select *, {KEY} section_key from it where length(supporting_quote) > 0),
se as (select rxcui, string_agg(section_key, '|' order by o) matched_sections from (select rxcui, section_key, min(item_id) o from qs group by all) group by rxcui),
sn as (select rxcui, string_agg(supporting_quote, '|' order by item_id) snippets from (select *, row_number() over (partition by rxcui order by item_id) r from qs) where r <= 10 group by rxcui)
select us.rxcui, coalesce(s, 'not_found') evidence_status, coalesce(n, 0) n_items, coalesce(matched_sections, '') matched_sections, coalesce(snippets, '') snippets, concat_ws('|', {_note['rules']}, case when label_no is null then {_note['none']} when lower(label_match_confidence) = 'low' then {_note['low']} when extraction_source <> 'dailymed_spl_xml' then {_note['fallback']} end,
  case coalesce(s, 'not_found') when 'explicit_positive' then {_note['positive']} when 'related_but_not_explicit' then {_note['related']} end, case when coalesce(s, 'not_found') in ('negated', 'historical_or_preexisting', 'comparator_only', 'not_found', 'insufficient_label_data') then {_note['absence']} end) limitations
from us left join st using (rxcui) left join label using (rxcui) left join se using (rxcui) left join sn using (rxcui)"""
)
def drug_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every drug's status for one event with its sections, its first ten quotes and the notes on limits."""
    drugs, labels, _ = analysis_input(spark, sf_dir)
    items = evidence(spark, sf_dir).filter("normalized_event = 'hypotension'").drop("drug_name")
    df = rollup.drug_evidence(drugs, labels.withColumn("has_chunks", F.lit(True)), items, extract.event_plan(EVENT))
    quotes = F.coalesce(F.array_join(F.transform("evidence_snippets", lambda x: x["text"]), "|"), F.lit(""))
    return df.select("rxcui", "evidence_status", "n_items", joined("matched_sections"), quotes.alias("snippets"), joined("limitations"))


# ---------------------------------------------------------------- label XML

_escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def label_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery of a label as XML: one section a code, with its paragraphs, lists and tables in order."""
    df = chunks(spark, sf_dir).filter("text is not null")
    cells = lambda c: F.array_join(F.transform(c, lambda v: F.concat(F.lit("<td>"), _escape(F.coalesce(v, F.lit(""))), F.lit("</td>"))), "")
    head = F.when(F.size("column_headers") > 0, F.concat(F.lit("<thead><tr>"), cells("column_headers"), F.lit("</tr></thead>"))).otherwise("")
    table = F.concat(F.lit("<table>"), head, F.lit("<tbody><tr>"), cells("row_cells"), F.lit("</tr></tbody></table>"))
    body = (
        F.when((F.col("chunk_type") == "table_row") & (F.size("row_cells") > 0), table)
        .when(F.col("chunk_type") == "list_item", F.concat(F.lit("<list><item>"), _escape("text"), F.lit("</item></list>")))
        .otherwise(F.concat(F.lit("<paragraph>"), _escape("text"), F.lit("</paragraph>")))
    )
    keys = ["set_id", "retrieved_at"]
    parts = df.groupBy(*keys, "section_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", body.alias("b")))), lambda x: x["b"]), "").alias("body"))
    section = F.concat(F.lit('<component><section><code code="'), "section_code", F.lit('"/><title>Section</title><text>'), "body", F.lit("</text></section></component>"))
    docs = parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_code", section.alias("s")))), lambda x: x["s"]), "").alias("s"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><document xmlns="urn:hl7-org:v3"><setId root="'), "set_id", F.lit('"/><versionNumber value="1"/><effectiveTime value="'), F.date_format("retrieved_at", "yyyyMMddHHmmss"), F.lit('"/><component><structuredBody>'), "s", F.lit("</structuredBody></component></document>"))
    return docs.select("set_id", F.encode(xml, "utf-8").alias("xml"))


_codes = ", ".join(f"'{c}'" for c in R.SECTIONS)
_shown = f"array_to_string(list_transform(row_cells, lambda v, i: concat(coalesce(nullif({_clean('column_headers[i]')}, ''), concat('Column ', i)), ': ', coalesce(nullif({_clean("coalesce(v, '')")}, ''), 'Not reported'))), ' | ')"
XML = f"""dc as (select lower(set_id) set_id, retrieved_at, section_code, chunk_index, chunk_id, text, row_cells, coalesce(column_headers, []) column_headers, case when chunk_type = 'table_row' and len(row_cells) > 0 then 'table' when chunk_type = 'list_item' then 'list' else 'paragraph' end tag from label_chunk where text is not null and section_code in ({_codes})),
dn as (select *, dense_rank() over (partition by set_id, retrieved_at order by section_code) - 1 sec, row_number() over (partition by set_id, retrieved_at, section_code, tag order by chunk_index nulls first, chunk_id) - 1 i from dc),
dt as (select *, case tag when 'table' then case when len(list_filter(row_cells, lambda v: length({_clean("coalesce(v, '')")}) > 0)) > 0 then {_shown} else '' end else {_clean('text')} end shown,
  case tag when 'table' then concat('section[', sec, ']/table[', i, ']/row[', case when len(column_headers) > 0 then 1 else 0 end, ']') when 'list' then concat('section[', sec, ']/list[', i, ']/item[0]') else concat('section[', sec, ']/paragraph[', i, ']') end source_path from dn),
dk as (select *, (row_number() over (partition by set_id, retrieved_at order by section_code, chunk_index nulls first, chunk_id) - 1)::int new_index from dt where length(shown) > 0)"""


@query(f"with {XML} select set_id, strftime(retrieved_at, '%Y%m%d%H%M%S') effective_time, section_code, case tag when 'table' then 'table_row' when 'list' then 'list_item' else 'paragraph' end chunk_type, new_index chunk_index, shown as text, source_path from dk")
def label_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery written as label XML and parsed again."""
    df = spl.parse_labels(label_documents(spark, sf_dir), "xml", "set_id").filter("error is null")
    return df.select("set_id", "effective_time", "section_code", "chunk_type", "chunk_index", "text", "source_path")


@query(f"with {XML} select set_id, strftime(retrieved_at, '%Y%m%d%H%M%S') effective_time, count(*) n_chunks, count(distinct section_code) n_sections from dk group by all")
def label_xml_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and sections of every parsed document."""
    return spl.parse_summary(spl.parse_labels(label_documents(spark, sf_dir), "xml", "set_id")).select("set_id", "effective_time", "n_chunks", "n_sections")


def queries() -> dict:
    """Registered with those of ``labels``."""
    return {}


def oracle_sql() -> dict[str, str]:
    return {}



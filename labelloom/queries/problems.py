"""Queries of the general data problems (p1, p2, p3, p7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import nested, quantities
from labelloom.operators.history import FOREVER, change_events, history
from labelloom.operators.timestamps import normalize_timestamps
from labelloom.session import load

# Fixed value: the written forms of a version number.
VERSION = r"^\s*(?:v|ver|version)?\.?\s*0*([0-9]{1,18})(?:\.0+)?\s*$"


def version_states(chunks: DataFrame) -> DataFrame:
    """set_id in lower case, retrieved_at, version_no and effective moment of rows that tell both."""
    rows = chunks.select("set_id", "version", "effective_time", "source_zone", "feed", "retrieved_at")
    rows = normalize_timestamps(rows, "effective_time", "source_zone", "feed", out="effective_s")
    number = F.regexp_extract(F.lower("version"), VERSION, 1)
    rows = rows.select(F.lower("set_id").alias("set_id"), "retrieved_at", F.when(F.length(number) > 0, number.try_cast("bigint")).alias("version_no"), "effective_s")
    return rows.filter(F.col("version_no").isNotNull() & F.col("effective_s").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = history(version_states(load(spark, sf_dir, "label_chunk")), ["set_id"], "retrieved_at", ["version_no", "effective_s"])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return spans.select("set_id", "version_no", text("valid_from").alias("valid_from"), F.coalesce(text("valid_to"), F.lit(FOREVER)).alias("valid_to"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "label_chunk").select(F.lit("label_chunk").alias("source_table"), F.col("chunk_id").alias("record_id"), F.col("effective_time").alias("written"), "source_zone", "feed")
    gold = load(spark, sf_dir, "gold_case").select(F.lit("gold_case").alias("source_table"), F.col("case_no").alias("record_id"), F.col("fixed_spl_effective_time").alias("written"), "source_zone", "feed")
    rows = normalize_timestamps(chunks.unionByName(gold), "written", "source_zone", "feed")
    return rows.filter(F.col("epoch_s").isNotNull()).select("source_table", "record_id", "epoch_s")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "evidence_item").select("item_id", "frequency_text", "frequency_value", "frequency_unit")
    rows = quantities.normalize_quantities(items, "frequency_text", "frequency_value", "frequency_unit")
    return rows.filter(F.col("quantity").isNotNull()).select("item_id", "quantity", "value_e4")


#: Collections of the runs' results and the columns of their flat tables.
TABLES = {
    "class_members": {"rxcui": "string", "name": "string", "tty": "string"},
    "selected_drugs": {"member.rxcui": "string", "member.name": "string", "rank": "bigint", "total_claims": "bigint"},
    "labels": {"rxcui": "string", "selected_spl_set_id": "string"},
    "spl_chunks": {"chunk_index": "bigint", "chunk_type": "string", "source_path": "string", "text": "string", "subsection_title": "string"},
    "drug_event_evidence": {"drug_name": "string", "rxcui": "string", "evidence_status": "string", "event_query": "string"},
    "evidence_snippets": {"section": "string", "matched_term": "string", "text": "string"},
    "event_evidence_items": {"drug_name": "string", "evidence_status": "string", "frequency_text": "string"},
    "frequencies": {"text": "string", "ord": "bigint"},
    "source_details": {"source": "string", "record_count": "bigint"},
    "drivers": {"rxcui": "string", "weight": "bigint"},
}


def run_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.json_nodes(load(spark, sf_dir, "analysis_run"), "run_id", "results_json")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = nested.links(run_nodes(spark, sf_dir))
    chunks = nested.path_links(load(spark, sf_dir, "label_chunk"), "chunk_id", "source_path")
    named = lambda df, table: df.select(F.lit(table).alias("source_table"), "record_id", "parent_path", "child_path")
    return named(runs, "analysis_run").unionByName(named(chunks, "label_chunk"))


def p7_table(collection: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query of one collection's flat table, each row with its parent's path."""
    return lambda spark, sf_dir: nested.table(run_nodes(spark, sf_dir), collection, TABLES[collection])


def p7_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs whose results hold no JSON, and why."""
    runs = load(spark, sf_dir, "analysis_run")
    return nested.unread(run_nodes(spark, sf_dir), runs, "run_id", "results_json")


_KEYS = ", ".join(f"'{k}'" for k in nested.LIST_KEYS)
# The same walk as a recursive query.
P7_NODES = f"""nodes as (select run_id, '$' path, '$' parent, null::varchar collection, false element, results_json::json v from analysis_run where json_valid(results_json)
  union all select run_id, path, parent, collection, element, v from (
    select run_id, case when lone then concat(path, '.', k, '[0]') else concat(path, '.', k) end path, case when element then path else parent end parent, k collection, lone element, w v from (
      select *, k in ({_KEYS}) and json_type(w) = 'OBJECT' lone from (select *, case when k in ({_KEYS}) and json_type(c) = 'VARCHAR' and json_valid(c ->> '$') then (c ->> '$')::json else c end w from (
        select n.*, k, json_extract(v, concat('$."', k, '"')) c from nodes n, unnest(json_keys(v)) t(k) where json_type(v) = 'OBJECT')))
    union all select run_id, concat(path, '[', i, ']'), parent, collection, true, json_extract(v, concat('$[', i, ']')) from nodes, unnest(range(json_array_length(v)::bigint)) t(i) where json_type(v) = 'ARRAY')
  where json_type(v) in ('OBJECT', 'ARRAY'))"""
P7_ELEMENTS = "elements as (select *, case when element then path end own from nodes where element and json_type(v) = 'OBJECT')"
# the parent of a member is its own element, of an array's item that of the array
P7_SQL = f"""with recursive {P7_NODES}, {P7_ELEMENTS}, s as (select chunk_id, list_filter(string_split(regexp_replace(lower(source_path), '\\s+', '', 'g'), '/'), lambda x: length(x) > 0) s from label_chunk)
select 'analysis_run' source_table, run_id record_id, parent parent_path, path child_path from elements
union all select 'label_chunk', chunk_id, array_to_string(list_filter(s, lambda x: regexp_matches(x, '^(sub)?section(\\[|$)')), '/'), array_to_string(s, '/') from s where len(list_filter(s, lambda x: regexp_matches(x, '^subsection(\\[|$)'))) > 0"""
P7_UNREAD_SQL = "select run_id record_id, case when length(trim(regexp_replace(coalesce(results_json, ''), '\\s+', ' ', 'g'))) > 0 then 'not JSON' else 'blank' end error from analysis_run where not coalesce(json_valid(results_json), false)"


def p7_table_sql(collection: str) -> str:
    """A collection's flat table in DuckDB's SQL."""
    field = lambda c, t: f"try_cast(v ->> '$.{c}' as bigint) {c.replace('.', '_')}" if t == "bigint" else f"v ->> '$.{c}' {c.replace('.', '_')}"
    fields = ", ".join(field(c, t) for c, t in TABLES[collection].items())
    return f"with recursive {P7_NODES}, {P7_ELEMENTS} select run_id record_id, parent parent_path, path, regexp_extract(path, '\\[([0-9]+)\\]$', 1)::int ordinal, {fields} from elements where collection = '{collection}'"


def p7_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section tree of each label chunk's path with subsection titles."""
    return nested.subsections(load(spark, sf_dir, "label_chunk"), "chunk_id", "source_path", "subsection_title")


P7_SECTIONS_SQL = """
with s as (select chunk_id, list_filter(string_split(regexp_replace(lower(source_path), '\\s+', '', 'g'), '/'), lambda x: regexp_matches(x, '^(sub)?section(\\[|$)')) s,
  list_transform(regexp_split_to_array(subsection_title, '[>›]'), lambda x: trim(x)) t from label_chunk),
r as (select chunk_id, s, t, unnest(range(len(s)))::int i from s)
select chunk_id record_id, array_to_string(s[1:i], '/') parent_path, array_to_string(s[1:i+1], '/') path, i depth,
  case when starts_with(s[i+1], 'subsection') then nullif(t[len(list_filter(s[1:i+1], lambda z: starts_with(z, 'subsection')))], '') end title from r"""


# The same moments by DuckDB's own date formats and zone functions.
P2_FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d%H%M%S", "%Y%m%d%H%M", "%Y%m%d", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y", "%d-%m-%Y", "%d-%b-%Y", "%d %B %Y", "%B %d, %Y", "%b %d, %Y", "%b %d, %Y %I:%M:%S %p", "%a, %d %b %Y %H:%M:%S"]
P2_NUMERIC = ["{0} %I:%M:%S %p", "{0} %H:%M:%S", "{0}"]
P2_ABBREVIATIONS = {"UTC": 0, "GMT": 0, "BST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660}
_formats = lambda day: "[" + ", ".join(f"'{f}'" for f in [f.format(day) for f in P2_NUMERIC] + P2_FORMATS) + "]"
P2_MOMENTS = f"""r as (select 'label_chunk' source_table, chunk_id record_id, trim(effective_time) t, source_zone z, feed from label_chunk union all select 'gold_case', case_no, trim(fixed_spl_effective_time), source_zone, feed from gold_case),
a as (select *, case when regexp_matches(t, '[+-][0-9]{{2}}:?[0-9]{{2}}$') and regexp_matches(t, '(:[0-9]{{2}}([.][0-9]+)?|^[0-9]{{12,14}}) ?[+-][0-9:]+$') then regexp_extract(t, '([+-][0-9:]+)$', 1) end shift,
  nullif(regexp_extract(t, '([A-Za-z]+/[A-Za-z_/]+)$', 1), '') region, case when t like '%Z' then 'UTC' else nullif(regexp_extract(t, '[0-9] ([A-Z]{{3,4}})$', 1), '') end abbr from r),
b as (select *, trim(regexp_replace(regexp_replace(t, ' ?([+-][0-9]{{2}}:?[0-9]{{2}}|[A-Za-z]+/[A-Za-z_/]+)$', case when shift is null and region is null then '\\0' else '' end), '([0-9])(Z| [A-Z]{{3,4}})$', '\\1')) w from a),
c as (select *, case when feed = 'us_portal' then try_strptime(regexp_replace(w, '([.][0-9]+)$', case when w like '%:%' then '' else '\\0' end), {_formats("%m/%d/%Y")}) else try_strptime(regexp_replace(w, '([.][0-9]+)$', case when w like '%:%' then '' else '\\0' end), {_formats("%d/%m/%Y")}) end wall,
  coalesce(region, nullif(trim(z), ''), 'UTC') zone, coalesce(map {{{", ".join(f"'{k}': {v}" for k, v in P2_ABBREVIATIONS.items())}}}[abbr],
    case when shift is not null then (case when shift like '-%' then -1 else 1 end) * (60 * shift[2:3]::int + right(shift, 2)::int) end) off_min from b),
d as (select *, timezone(zone, wall) u from c),
m as (select source_table, record_id, case when regexp_matches(t, '^[0-9]{{10}}$') then t::bigint when regexp_matches(t, '^[0-9]{{13}}$') then t::bigint // 1000 when off_min is not null then epoch_ms(wall) // 1000 - 60 * off_min
  when timezone(zone, u - interval 1 hour) = wall then epoch_ms(u) // 1000 - 3600 when timezone(zone, u - interval 30 minute) = wall then epoch_ms(u) // 1000 - 1800 else epoch_ms(u) // 1000 end epoch_s from d)"""
P2_SQL = f"with {P2_MOMENTS} select * from m where epoch_s is not null"
P1_SQL = f"""with {P2_MOMENTS}, s as (select lower(set_id) set_id, retrieved_at, min((try_cast(regexp_replace(lower(trim(version)), '^(version|v) ?|[.]0+$', '', 'g') as bigint), epoch_s)) state from label_chunk join m on source_table = 'label_chunk' and record_id = chunk_id
  where epoch_s is not null and try_cast(regexp_replace(lower(trim(version)), '^(version|v) ?|[.]0+$', '', 'g') as bigint) is not null group by all),
l as (select *, lag(state) over (partition by set_id order by retrieved_at) before from s), k as (select * from l where before is distinct from state)
select set_id, state[1] version_no, strftime(retrieved_at, '%Y-%m-%d %H:%M:%S') valid_from, coalesce(strftime(lead(retrieved_at) over (partition by set_id order by retrieved_at), '%Y-%m-%d %H:%M:%S'), '{FOREVER}') valid_to from k"""


# Problem 1 with the labels of a month as one snapshot, so that a label not delivered in a month is gone then.
EVENTS_SQL = f"""with {P2_MOMENTS}, s as (select lower(set_id) set_id, date_trunc('month', retrieved_at) as at_month, min((try_cast(regexp_replace(lower(trim(version)), '^(version|v) ?|[.]0+$', '', 'g') as bigint), epoch_s)) state from label_chunk join m on source_table = 'label_chunk' and record_id = chunk_id
  where epoch_s is not null and try_cast(regexp_replace(lower(trim(version)), '^(version|v) ?|[.]0+$', '', 'g') as bigint) is not null group by all),
k as (select at_month, row_number() over (order by at_month) i from (select distinct at_month from s)), x as (select s.*, i from s join k using (at_month)),
e as (select a.set_id, a.i, case when b.set_id is null then 'inserted' when a.state is distinct from b.state then 'changed' end change, a.state from x a left join x b on a.set_id = b.set_id and b.i = a.i - 1
  union all select b.set_id, b.i + 1, 'deleted', null from x b left join x a on a.set_id = b.set_id and a.i = b.i + 1 where a.set_id is null and b.i < (select max(i) from k))
select set_id, strftime(at_month, '%Y-%m') as month, change, state[1] version_no from e join k using (i) where change is not null"""


def p1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was inserted, changed and deleted from one month's labels to the next."""
    states = version_states(load(spark, sf_dir, "label_chunk")).withColumn("at_month", F.date_trunc("month", "retrieved_at"))
    events = change_events(states, ["set_id"], "at_month", ["version_no", "effective_s"], scope="global", bucket="year")
    return events.select("set_id", F.date_format("at_month", "yyyy-MM").alias("month"), "change", "version_no")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = {"p1_found": p1_found, "p1_events": p1_events, "p2_found": p2_found, "p3_found": p3_found, "p7_found": p7_found, "p7_sections": p7_sections, "p7_unread": p7_unread}
    return plain | {f"p7_{c}": p7_table(c) for c in TABLES}


def oracle_sql() -> dict[str, str]:
    plain = {"p1_found": P1_SQL, "p1_events": EVENTS_SQL, "p2_found": P2_SQL, "p3_found": quantities.found_sql(), "p7_found": P7_SQL, "p7_sections": P7_SECTIONS_SQL, "p7_unread": P7_UNREAD_SQL}
    return plain | {f"p7_{c}": p7_table_sql(c) for c in TABLES}

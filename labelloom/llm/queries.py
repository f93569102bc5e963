"""Queries of the corpus problems (p4, p5, p6, p8, p9, p10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import duplicates, languages, leaks, lookalikes, survivors, tokens
from labelloom.llm.canonical import canonical_fields, canonical_fields_sql, canonical_sql, canonical_text, composed
from labelloom.session import load

COMPLETE = ["matched_term", "evidence_status", "section_title", "subsection_title", "frequency_text", "comparator_text", "population_context", "dose_context", "mentioned_in_sections", "source_paths"]


def chunk_key(strict: bool = False) -> Column:
    """set_id without case and canonical text; the fields of table rows in any order."""
    text = composed(F.col("text")) if strict else F.col("text")
    return duplicates.key_of(F.lower("set_id"), F.when(F.col("chunk_type") == "table_row", canonical_fields(text, strict)).otherwise(canonical_text(text, strict)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "label_chunk").select("chunk_id", "set_id", "chunk_type", "text")
    members = duplicates.collapse(chunks, "chunk_id", chunk_key()).members
    return members.filter("id <> first_id").select(F.col("first_id").alias("first_chunk_id"), F.col("id").alias("chunk_id"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct content: its smallest chunk_id and the number of copies; signs, numbers and accents that differ make another content."""
    chunks = load(spark, sf_dir, "label_chunk").select("chunk_id", "set_id", "chunk_type", "text")
    return duplicates.collapse(chunks, "chunk_id", chunk_key(strict=True)).representatives().select(F.col("id").alias("first_chunk_id"), "copies")


def _p4_keys(strict: bool) -> str:
    text = "nfc_normalize(text)" if strict else "text"
    return f"""with k as (select chunk_id, lower(set_id) s, case when chunk_type = 'table_row' then {canonical_fields_sql(text, strict)} else {canonical_sql(text, strict)} end t from label_chunk
  where set_id is not null and text is not null), g as (select s, t, min(chunk_id) first_chunk_id, count(*) copies from k group by s, t)"""


P4_SQL = _p4_keys(False) + " select first_chunk_id, chunk_id from k join g using (s, t) where chunk_id <> first_chunk_id"
P4_COPIES_SQL = _p4_keys(True) + " select first_chunk_id, copies from g"


def finding_key() -> Column:
    quote = F.when(F.col("chunk_type") == "table_row", canonical_fields(F.col("supporting_quote"))).otherwise(canonical_text(F.col("supporting_quote")))
    return duplicates.key_of(F.col("rxcui"), F.lower(F.trim("normalized_event")), quote)


def findings(spark: SparkSession, sf_dir: str, best: list[str], unite: list[str]) -> DataFrame:
    items = load(spark, sf_dir, "evidence_item")
    return survivors.merge(items, "item_id", finding_key(), COMPLETE, "extracted_at", "extraction_confidence", ("high", "medium", "low"), best, unite)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = findings(spark, sf_dir, ["evidence_status"], [])
    return merged.select(F.col("first_id").alias("first_item_id"), F.col("survivor_id").alias("survivor_item_id"), F.lower("evidence_status").alias("evidence_status"))


def p5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors with sections and source paths united and the best texts of each field."""
    merged = findings(spark, sf_dir, ["evidence_status", "frequency_text", "comparator_text"], ["mentioned_in_sections", "source_paths"])
    merged = merged.withColumnsRenamed({"first_id": "first_item_id", "survivor_id": "survivor_item_id"})
    return merged.withColumns({c: F.array_join(c, "|") for c in ("mentioned_in_sections", "source_paths")})


P5_FULL = " + ".join(f"(coalesce(length(trim({c})), 0) > 0)::int" for c in COMPLETE[:6]) + " + " + " + ".join(f"(coalesce(len({c}), 0) > 0)::int" for c in COMPLETE[6:])
P5_KEYS = f"""
with k as (select *, rxcui a, lower(trim(normalized_event)) b, case when chunk_type = 'table_row' then {canonical_fields_sql('supporting_quote')} else {canonical_sql('supporting_quote')} end c,
  {P5_FULL} full_n, case lower(trim(extraction_confidence)) when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end trust from evidence_item),
g as (select a, b, c, min(item_id) first_item_id from k where a is not null and b is not null and c is not null group by a, b, c having count(*) > 1),
s as (select a, b, c, item_id from k qualify row_number() over (partition by a, b, c order by full_n desc, extracted_at desc nulls last, item_id) = 1),
e as (select a, b, c, lower(trim(evidence_status)) evidence_status from k where length(trim(evidence_status)) > 0
  qualify row_number() over (partition by a, b, c order by trust desc, extracted_at desc nulls last, item_id) = 1)"""
P5_SQL = P5_KEYS + " select first_item_id, s.item_id survivor_item_id, evidence_status from g join s using (a, b, c) left join e using (a, b, c)"
_best = lambda c: f"arg_min(trim({c}), (-trust, extracted_at is null, -epoch_us(coalesce(extracted_at, timestamp '1970-01-01')), item_id)) filter (length(trim({c})) > 0) {c}"
_united = lambda c: f"(select a, b, c, string_agg(distinct v, '|' order by v) {c} from (select a, b, c, unnest({c}) v from k) where length(trim(v)) > 0 group by a, b, c)"
P5_MERGED_SQL = P5_KEYS + f""", f as (select a, b, c, count(*) copies, {_best('evidence_status')}, {_best('frequency_text')}, {_best('comparator_text')} from k group by a, b, c)
select first_item_id, s.item_id survivor_item_id, copies, f.evidence_status, frequency_text, comparator_text, mentioned_in_sections, source_paths from g join s using (a, b, c) join f using (a, b, c)
left join {_united('mentioned_in_sections')} using (a, b, c) left join {_united('source_paths')} using (a, b, c)"""


def _unified(spark: SparkSession, sf_dir: str, compare: bool) -> DataFrame:
    texts = {"label_chunk": load(spark, sf_dir, "label_chunk").select("chunk_id", "text"), "evidence_item": load(spark, sf_dir, "evidence_item").select("item_id", "supporting_quote")}
    counts = lookalikes.string_counts([df.select(df.columns[1]) for df in texts.values()], lookalikes.sequences(lookalikes.prototypes(spark)) if compare else ())
    parts = [lookalikes.unify(df, df.columns[0], df.columns[1], counts, compare).withColumnRenamed(df.columns[0], "record_id").withColumn("source_table", F.lit(name)) for name, df in texts.items()]
    return parts[0].unionByName(parts[1])


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and quote in one consistent form, whether it was changed, and the form to compare by."""
    return _unified(spark, sf_dir, True).select("source_table", "record_id", "unified", "changed", "comparable")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir, False).filter("changed").select("source_table", "record_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(load(spark, sf_dir, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts encoded and decoded again; null texts come back empty."""
    return tokens.decode_ids(p8_ids(spark, sf_dir), "doc_id", "ids")


P8_DECODED_SQL = "select doc_id, coalesce(text, '') as text from documents"


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.shared_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item"))


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three quarters of an item's different words close together."""
    return leaks.near_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item"))


P9_SQL = """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents), i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from eval_item),
a as (select doc_id, array_to_string(w[k:k+9], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 8)) k from d)),
b as (select item_id, array_to_string(w[k:k+9], ' ') g from (select item_id, w, unnest(range(1, len(w) - 8)) k from i))
select distinct doc_id, item_id from a join b using (g)"""


P9_NEAR_SQL = """
with d as (select doc_id, unnest(w) w, unnest(range(len(w))) p from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents)), i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from eval_item),
t as (select item_id, greatest(40, 5 * len(w) // 4) span, unnest(list_distinct(w)) w from i), k as (select * from t where w in (select w from d)), n as (select item_id, ceil(0.75 * count(*)) need from k group by item_id),
h as (select doc_id, item_id, p, w, span from d join k using (w)), c as (select doc_id, item_id from h join n using (item_id) group by doc_id, item_id, need having count(distinct w) >= need),
s as (select doc_id, item_id, count(distinct b.w) m from c join h a using (doc_id, item_id) join h b using (doc_id, item_id) where b.p between a.p and a.p + a.span - 1 group by doc_id, item_id, a.p)
select doc_id, item_id, max(m) n_terms from s join n using (item_id) group by doc_id, item_id, need having max(m) >= need"""


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    docs = load(spark, sf_dir, "documents")
    return languages.classify(docs, "doc_id", "text", "lang", languages.fit(docs, "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = languages.document_languages(docs, "doc_id", "text", "lang", languages.fit(docs, "text", "lang"))
    return languages.mislabelled(found, "doc_id").select("doc_id", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_copies": p4_copies, "p5_found": p5_found, "p5_merged": p5_merged, "p6_found": p6_found, "p6_texts": p6_texts, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found, "p10_segments": p10_segments}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p4_copies": P4_COPIES_SQL, "p5_found": P5_SQL, "p5_merged": P5_MERGED_SQL, "p8_decoded": P8_DECODED_SQL, "p9_found": P9_SQL, "p9_near": P9_NEAR_SQL}

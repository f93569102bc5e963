"""Snapshots of catalogues and services as tables, and sinks for results.

Services are read from landed JSON with a declared schema, so their scans are
pruned, pushed down and repeatable; the readers return DataFrames only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Payload schemas, relation options of class types, names of secret parameters.
CATALOG = "rxclassMinConceptList struct<rxclassMinConcept:array<struct<classId:string,className:string,classType:string>>>"
MEMBERS = "class_id string, option int, drugMemberGroup struct<drugMember:array<struct<minConcept:struct<tty:string,rxcui:string,name:string>>>>"
RELATIONS = "rxcui string, rxclassDrugInfoList struct<rxclassDrugInfo:array<struct<rxclassMinConceptItem:struct<classId:string,className:string,classType:string>,minConcept:struct<tty:string,rxcui:string,name:string>,relaSource:string,rela:string>>>"
CANDIDATES = "query string, approximateGroup struct<candidate:array<struct<rxcui:string,rank:string,score:string,source:string>>>"
USAGE = "Gnrc_Name string, Tot_Clms string, Tot_Benes string, Prscrbr_Geo_Lvl string"
OPTIONS = {
    "EPC": (("FDASPL", "has_EPC"), ("DAILYMED", "has_EPC"), ("MEDRT", "has_EPC")),
    "MOA": (("MEDRT", "has_MoA"), ("FDASPL", "has_MoA"), ("DAILYMED", "has_MoA")),
    "PE": (("MEDRT", "has_PE"), ("FDASPL", "has_PE"), ("DAILYMED", "has_PE")),
    "CHEM": (("MEDRT", "has_Chemical_Structure"), ("FDASPL", "has_chemical_structure")),
    "DISPOS": (("SNOMEDCT", "isa_disposition"),),
    "VA": (("VA", "has_VAClass"),),
}
FALLBACK_SOURCES = ("FDASPL", "DAILYMED", "MEDRT", "VA", "ATC", "ATCPROD", "SNOMEDCT")
MEMBER_TYPES = ("IN", "PIN", "MIN")
SECRETS = ("api_key", "apikey", "key", "token", "access_token", "password", "secret")


def read_json(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> DataFrame:
    """Landed JSON with a declared schema; a broken file gives null fields instead of an error."""
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "PERMISSIVE").json(path)


def relation_options(class_type: str) -> tuple[tuple[str, str | None], ...]:
    """(source, relation) options of a class type, in the order to try them."""
    kind = class_type.upper()
    return (("ATC", None),) if kind.startswith("ATC") else OPTIONS.get(kind, tuple((s, None) for s in FALLBACK_SOURCES))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def class_catalog(payload: DataFrame) -> DataFrame:
    """class_id, class_name, class_type, source and relation; blank ids and names left out, the first of equal (id, type) kept.

    A catalogue landed in several pages has their number in ``page``.
    """
    page = F.col("page") if "page" in payload.columns else F.lit(0).alias("page")
    rows = payload.select(page, F.posexplode("rxclassMinConceptList.rxclassMinConcept").alias("ord", "c"))
    rows = rows.select("page", "ord", F.trim("c.classId").alias("class_id"), F.trim("c.className").alias("class_name"), F.trim(F.coalesce("c.classType", F.lit(""))).alias("class_type"))
    rows = first_seen(rows.filter((F.length("class_id") > 0) & (F.length("class_name") > 0)), ["class_id", "class_type"], ["page", "ord"])
    kind = F.upper("class_type")
    source, relation = F.when(kind.startswith("ATC"), "ATC"), F.when(F.lit(False), "")
    for name, options in OPTIONS.items():
        source, relation = source.when(kind == name, options[0][0]), relation.when(kind == name, options[0][1])
    return rows.select("class_id", "class_name", "class_type", source.otherwise("Resolve on selection").alias("rela_source"), relation.alias("rela"))


def class_members(payload: DataFrame) -> DataFrame:
    """class_id, rxcui, name and tty of ingredients, from the first option of each class that has any; one row per (rxcui, name without case)."""
    rows = payload.select("class_id", "option", F.posexplode("drugMemberGroup.drugMember").alias("ord", "m")).select("class_id", "option", "ord", "m.minConcept.*")
    rows = rows.filter(F.upper("tty").isin(*MEMBER_TYPES) & (F.length(F.trim("rxcui")) > 0) & (F.length(F.trim("name")) > 0))
    first = rows.groupBy("class_id").agg(F.min("option").alias("__o"))
    rows = rows.join(first, "class_id").filter(F.col("option") == F.col("__o"))
    rows = rows.withColumn("__key", F.lower(F.trim("name")))
    return first_seen(rows, ["class_id", "rxcui", "__key"], ["ord"]).select("class_id", "rxcui", "name", "tty")


def class_relations(payload: DataFrame) -> DataFrame:
    """drug_rxcui, ord, class_id, class_name, class_type, rela_source, rela and the member's rxcui, name and tty: the classes through which each drug was found."""
    rows = payload.select(F.col("rxcui").alias("drug_rxcui"), F.posexplode("rxclassDrugInfoList.rxclassDrugInfo").alias("ord", "i"))
    item, member = "i.rxclassMinConceptItem", "i.minConcept"
    return rows.select("drug_rxcui", "ord", F.col(f"{item}.classId").alias("class_id"), F.col(f"{item}.className").alias("class_name"), F.col(f"{item}.classType").alias("class_type"), F.col("i.relaSource").alias("rela_source"), F.col("i.rela").alias("rela"), f"{member}.rxcui", f"{member}.name", f"{member}.tty")


def option_table(types: DataFrame, column: str) -> DataFrame:
    """``types`` with one row per relation option of its class type: option (from 1), rela_source and rela."""
    kind = F.upper(F.trim(F.coalesce(column, F.lit(""))))
    entry = lambda options: F.array(*[F.struct(F.lit(s).alias("rela_source"), F.lit(r).cast("string").alias("rela")) for s, r in options])
    listed = F.when(kind.startswith("ATC"), entry(relation_options("ATC")))
    for name, options in OPTIONS.items():
        listed = listed.when(kind == name, entry(options))
    listed = listed.otherwise(entry(relation_options("")))
    rows = types.select("*", F.posexplode(listed).alias("__at", "__o"))
    return rows.select(*types.columns, (F.col("__at") + 1).alias("option"), "__o.*")


# The reviewed cases as they are landed, in one array.
CASES = "case_id string, benchmark_group string, drug_name string, rxcui string, event_query string, normalized_event string, spl_set_id string, expected_status string, expected_context array<string>, score_frequency boolean, gold_review_complete boolean"


def reviewed_cases(payload: DataFrame) -> DataFrame:
    """One row per reviewed case of landed files (``cases``: array of ``CASES``), in their ``ord``."""
    return payload.select(F.posexplode("cases").alias("ord", "c")).select("ord", "c.*")


def best_candidates(payload: DataFrame, top: int = 15) -> DataFrame:
    """Per query the ``top`` candidates: of each rxcui the last row of the preferred source, else its first."""
    rows = payload.select("query", F.posexplode("approximateGroup.candidate").alias("ord", "c")).select("query", "ord", "c.*")
    preferred = F.upper("source") == "RXNORM"
    best = rows.groupBy("query", "rxcui").agg(F.max_by(F.struct("rank", "score", "source"), F.struct(preferred.alias("p"), F.when(preferred, F.col("ord")).otherwise(-F.col("ord")).alias("o"))).alias("c"))
    best = best.select("query", "rxcui", "c.*").withColumns({"rank": F.coalesce(F.col("rank").try_cast("int"), F.lit(999999)), "score": F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))})
    order = Window.partitionBy("query").orderBy("rank", F.desc("score"), "rxcui")
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def national_usage(payload: DataFrame) -> DataFrame:
    """generic_name, claims and beneficiaries of national rows; numbers rounded half to even, unreadable claims are 0, missing beneficiaries null."""
    number = lambda c: F.bround(F.col(c).try_cast("double")).cast("bigint")
    rows = payload.filter(F.col("Prscrbr_Geo_Lvl") == "National")
    return rows.select(F.trim("Gnrc_Name").alias("generic_name"), F.coalesce(number("Tot_Clms"), F.lit(0)).alias("claims"), F.when(F.length(F.trim("Tot_Benes")) > 0, F.coalesce(number("Tot_Benes"), F.lit(0))).alias("beneficiaries"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; of equal versions the new table's."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (*keys, "__new")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(version, "__new")).alias("r"))
    return best.select(*keys, "r.*")


def redact(query: Column) -> Column:
    """A query string with the values of secret parameters masked."""
    return F.regexp_replace(query, rf"(?i)((?:^|[?&;])(?:{'|'.join(SECRETS)})=)[^&;#\s]*", "$1***")


def provenance(df: DataFrame, source: str, query: Column, note: Column) -> DataFrame:
    """One row per request: source, redacted query, time, number of records and note."""
    return df.select(F.lit(source).alias("source"), redact(query).alias("query"), F.current_timestamp().alias("requested_at"), F.col("record_count"), note.alias("note"))


def scrub(text: Column, secrets: list[str]) -> Column:
    """A message without the given secrets."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("***")), [s for s in secrets if s], text)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """Results as JSON lines, nulls included."""
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path, compression=compression)


def append_run(df: DataFrame, path: str) -> None:
    """Runs appended with their nested columns as JSON texts."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("append").parquet(path)


def markdown(rows: list[tuple], names: list[str]) -> str:
    """A table for a report, from rows already gathered by the caller."""
    line = lambda cells: "| " + " | ".join("N/A" if c is None else f"{c:.3f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows)])

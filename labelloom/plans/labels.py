"""One label per drug, chosen from the records of a search in steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.plans.discover import SAFETY_FIELDS, SALTS, SEARCH_ORDER, cascade, label_confidence, label_score, name_key

# Fixed value: landed label records; fields that hold one value or a list are read as texts.
LABELS = (
    "query string, query_rxcui string, search_field string, position int, id string, effective_time string, spl_set_id string, set_id string,"
    " warnings string, warnings_and_cautions string, adverse_reactions string, contraindications string, drug_interactions string,"
    " openfda struct<spl_id:string,spl_set_id:string,set_id:string,rxcui:string,generic_name:string,brand_name:string,substance_name:string>"
)


def as_list(column: Column) -> Column:
    """A field that holds one value, a list or nothing, as an array without nulls."""
    text = F.trim(column)
    many = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    values = F.when(text.startswith("["), F.coalesce(many, F.array(column))).when(column.isNotNull(), F.array(column)).otherwise(F.array().cast("array<string>"))
    return F.filter(values, lambda v: v.isNotNull())


def filled(column: Column) -> Column:
    """The trimmed non-blank values of such a field."""
    return F.filter(F.transform(as_list(column), lambda v: F.trim(v)), lambda v: F.length(v) > 0)


def joined_section(column: Column) -> Column:
    """A section's texts with a blank line between them."""
    return F.array_join(filled(column), "\n\n")


SET_ID_PLACES = ("root.spl_set_id", "root.set_id", "openfda.spl_set_id", "openfda.set_id")


def set_id_and_place() -> tuple[Column, Column]:
    """The first filled set id of a record and where it stands."""
    first = [F.get(filled(F.col(p.removeprefix("root."))), F.lit(0)) for p in SET_ID_PLACES]
    place = F.coalesce(*[F.when(c.isNotNull(), p) for c, p in zip(first, SET_ID_PLACES, strict=True)])
    return F.coalesce(*first), place


def distinct_records(records: DataFrame) -> DataFrame:
    """The first of each record that a drug's searches returned; a record is told by its id, else by its label's, else by its place in the search."""
    own = F.coalesce(F.nullif("id", F.lit("")), F.get(filled(F.col("openfda.spl_id")), F.lit(0)), F.concat_ws(":", F.concat(F.lit("openfda."), "search_field"), F.col("position").cast("string"), F.coalesce("effective_time", F.lit(""))))
    order = Window.partitionBy("query_rxcui", "__key").orderBy("search_step", "position")
    return records.withColumn("__key", own).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__key", "__n")


def scored(records: DataFrame, usage: DataFrame) -> DataFrame:
    """``records`` of drugs in ``usage`` (rxcui, name, generic_names) with score, confidence, reasons and what they rest on."""
    df = records.join(usage.select(F.col("rxcui").alias("query_rxcui"), F.col("name").alias("__name"), F.col("generic_names").alias("__cms")), "query_rxcui")
    keys = lambda values: F.array_distinct(F.transform(values, name_key))
    generic, substance = as_list(F.col("openfda.generic_name")), as_list(F.col("openfda.substance_name"))
    set_id, place = set_id_and_place()
    df = df.withColumns({"__generic": generic, "__substance": substance, "spl_set_id_found": set_id, "spl_set_id_place": place, "safety_fields": F.filter(F.array(*[F.when(F.length(joined_section(F.col(f))) > 0, f) for f in SAFETY_FIELDS]), lambda f: f.isNotNull())})
    names = F.array_union(keys("__generic"), keys("__substance"))
    core = lambda c: F.array_join(F.filter(F.split(name_key(c), " "), lambda t: (F.length(t) > 0) & ~t.isin(*SALTS)), " ")
    df = df.withColumns(
        {
            "exact_rxcui": F.array_contains(as_list(F.col("openfda.rxcui")), F.col("query_rxcui")),
            "exact_generic": F.array_contains(keys("__generic"), name_key("__name")),
            "exact_substance": F.array_contains(keys("__substance"), name_key("__name")),
            "__matched": F.array_sort(F.array_intersect(keys("__cms"), names)),
            "core_match": (F.length(core(F.col("__name"))) > 0) & F.exists(F.concat("__generic", "__substance"), lambda v: core(v) == core(F.col("__name"))),
        }
    ).withColumn("product_match", F.size("__matched") > 0)
    flags = [F.col(c) for c in ("exact_rxcui", "exact_generic", "exact_substance", "product_match", "core_match")]
    n = F.size("safety_fields")
    when = lambda c, yes, no=None: F.when(c, yes).otherwise(no)
    listed = F.when(n > 0, F.concat(F.lit(" ("), F.array_join("safety_fields", ", "), F.lit(")."))).otherwise(".")
    reasons = [
        when(flags[0], "Exact RxClass RXCUI match in openFDA.", "No exact base-ingredient RXCUI was present in this product label."),
        when(flags[1], "Exact openFDA generic-name match to the RxClass base ingredient."),
        when(flags[2], "Exact openFDA substance-name match to the RxClass base ingredient."),
        F.when(flags[3], F.concat(F.lit("FDA label product matches a CMS product/salt: "), F.array_join("__matched", ", "), F.lit(".")))
        .when(flags[4], "Active-ingredient core matches, but CMS salt/product identity is not exact.")
        .otherwise("Product/salt compatibility with the CMS matches is uncertain."),
        F.concat(F.lit("Safety coverage: "), n.cast("string"), F.lit(f"/{len(SAFETY_FIELDS)} requested sections present"), listed),
        F.coalesce(F.concat(F.lit("SPL set identifier found at "), "spl_set_id_place", F.lit(".")), F.lit("SPL set identifier was unavailable in the inspected record fields.")),
    ]
    return df.withColumns(
        {
            "label_match_score": label_score(*flags, n, F.col("spl_set_id_found").isNotNull()),
            "label_match_confidence": label_confidence(*flags, n),
            "label_match_reasons": F.filter(F.array(*reasons), lambda r: r.isNotNull()),
        }
    ).drop("__name", "__cms", "__generic", "__substance", "__matched")


def select_labels(records: DataFrame, usage: DataFrame) -> DataFrame:
    """One record per drug: steps of the search up to the one that settles it, distinct records, the best by eight parts.

    ``records`` has the columns of ``LABELS``: the hits of each drug's
    searches by search_field, in their ``position``. An rxcui or brand search
    settles it by any hit, a name search by a record of exactly that name. Of
    equally good records the one retrieved first wins.
    """
    target = name_key("query")
    named = lambda field: F.exists(as_list(F.col(f"openfda.{field}")), lambda v: name_key(v) == target)
    step = F.array_position(F.array(*[F.lit(f) for f in SEARCH_ORDER]), F.col("search_field"))
    field = F.col("search_field")
    stops = field.isin("rxcui", "brand_name") | ((field == "generic_name") & named("generic_name")) | ((field == "substance_name") & named("substance_name"))
    hits = cascade(records.withColumn("search_step", step), "query_rxcui", "search_step", stops)
    df = scored(distinct_records(hits), usage)
    key = ["exact_rxcui", "exact_generic", "exact_substance", "product_match", "core_match"]
    best = Window.partitionBy("query_rxcui").orderBy(*[F.desc(c) for c in key], F.size("safety_fields").desc(), F.col("spl_set_id_found").isNotNull().desc(), F.coalesce("effective_time", F.lit("")).desc(), "search_step", "position")
    return df.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")

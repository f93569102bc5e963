"""Quantities written in different units and scales, brought to common units.

Plain SQL: numbers and the unit's wording are extracted by regular expression,
the wording is brought to a form without numbers, the form is looked up in an
alias table by join, and factor and offset of the alias are applied. The same
patterns run in Spark and in RE2 engines.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Number words and patterns of the written forms.
WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?: [0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?"
#: (pattern, replacement), applied in order to the lower-case text.
STEPS = (
    (r"[\x{A0}\x{2007}\x{2009}\x{202F}\s]+", " "),
    (r"^ | $", ""),
    (r"^\((.*)\)$", "$1"),
    (r"^(approximately|approx\.?|about|around|roughly|circa|ca\.|~|≈) ?", ""),
    *((rf"\b{w}\b", str(i + 1)) for i, w in enumerate(WORDS)),
)
FORM_STEPS = (
    (NUMBER, "#"),
    (r"\b(patient|person|subject|participant)s?[- ]?(years?|yrs?)\b|\bpys?\b", "PY"),
    (r"\b(patient|person|subject|participant)s?[- ]?(months?|mos?)\b|\bpms?\b", "PM"),
    (r"(PY|PM) (of|at) (exposure|follow-up|observation|treatment|risk)", "$1"),
    (r"\b(patients?|persons?|people|subjects?|participants?|cases?|events?|individuals?)\b", "P"),
    (r"\b(of|in) (the )?(treated |exposed )?P$", "ofP"),
    (r"\b(treated|exposed) P\b|\bP (treated|exposed)\b|\b(treated|exposed)$", "P"),
    (r"[\s.]+", ""),
    (r"(percent|percentage|pct|%)(ofP)?", "%"),
    (r"(‰|permille|permil|promille)(ofP)?", "‰"),
)


def aliases() -> list[tuple[str, str, int]]:
    """(form, quantity, factor): value_e4 = first number x factor / (second number or 1)."""
    share = [("#%", 10**4), ("#‰", 10**3), ("#ppm", 1), ("#partspermillion", 1)]
    share += [(f"{w}{o}{c}#", 10**6) for w, o, c in product(("proportion", "fraction"), ("", "of"), ("", ":", "="))]
    share += [(f"#{a}{w}{o}{b}", 10**6) for w, o, (a, b) in product(("proportion", "fraction"), ("", "ofP"), (("", ""), ("(", ")")))]
    of = ("of", "outof", "/", ":", "in", "inevery", "per", "among", "amongst", "outofevery")
    share += [(f"{a}{o}{b}", 10**6) for a, o, b in product(("#", "#P", "#(P)"), of, ("#", "#P"))] + [("n=#(n=#)", 10**6), ("n=#/n=#", 10**6), ("n=#,n=#", 10**6)]
    rate = [(f"{a}{o}{b}{t}", f) for a, o, b, (t, f) in product(("#", "#P", "#(P)"), ("per", "/", "in"), ("#", ""), (("PY", 10**7), ("PM", 12 * 10**7)))]
    return [*((f, "proportion", k) for f, k in share), *((f, "rate", k) for f, k in rate)]


def alias_table(spark: SparkSession) -> DataFrame:
    """The alias table; its size is that of ``aliases()``, whatever the data."""
    return spark.createDataFrame([(f, q, k, 0) for f, q, k in aliases()], "q_form string, q_quantity string, q_factor bigint, q_offset bigint")


def _sql(text: str, steps: tuple[tuple[str, str], ...], duck: bool) -> str:
    for pattern, by in steps:
        if duck:
            pattern = pattern.replace("\\\\", "\\")
            text = f"regexp_replace({text}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
        else:
            text = f"regexp_replace({text}, '{pattern.replace(chr(92), chr(92) * 2)}', '{by}')"
    return text


def written_text(text: str, value: str, unit: str, duck: bool = False) -> str:
    """SQL of the text that decides: the text if it isn't blank, else value and unit."""
    number = f"cast(try_cast({value} as decimal(24, 6)) as {'varchar' if duck else 'string'})"
    return f"case when length(trim({text})) > 0 then {text} when {value} >= 0 then {number} || ' ' || {unit} end"


def clean_sql(text: str, duck: bool = False) -> str:
    return _sql(f"lower({text})", STEPS, duck)


def form_sql(clean: str, duck: bool = False) -> str:
    return _sql(clean, FORM_STEPS, duck)


def scaled_sql(number: str, duck: bool = False) -> str:
    """SQL of a written number x 1,000,000 as a whole decimal, or null."""
    grouped = f"(regexp_matches({number}, '^[0-9]{{1,3}}([ ,][0-9]{{3}})+([.][0-9]+)?$') and not starts_with({number}, '0'))" if duck else f"({number} rlike '^[0-9]{{1,3}}([ ,][0-9]{{3}})+([.][0-9]+)?$' and not startswith({number}, '0'))"
    plain = f"case when {grouped} then replace(replace({number}, ' ', ''), ',', '') else replace({number}, ',', '.') end"
    return f"cast(try_cast({plain} as decimal(24, 6)) * 1000000 as decimal(36, 0))"


def normalize_quantities(df: DataFrame, text: str, value: str, unit: str, default_unit: str | None = None) -> DataFrame:
    """``df`` with ``quantity`` and ``value_e4`` (the value in common units x 10,000, rounded half up).

    A non-blank ``text`` decides; else ``value`` and ``unit`` together (a null
    or blank unit counts as ``default_unit``). Shares of people come in
    percent (``proportion``), events over person-time in events per 1,000
    patient-years (``rate``). Texts that state no single such number (ranges,
    bounds, bare counts, words, doses), shares above 100 %, a zero
    denominator and null texts give nulls, and so do numbers that a column
    can't hold: more than 18 digits before the point, or a ``value_e4`` beyond
    a bigint. Texts may be of any length. Rows are neither dropped nor added;
    extra columns pass through, working columns start with ``__q_``.
    """
    unit_sql = f"coalesce(nullif(trim({unit}), ''), {'null' if default_unit is None else repr(default_unit)})"
    df = df.withColumn("__q_text", F.expr(written_text(text, value, unit_sql)))
    df = df.withColumn("__q_text", F.expr(clean_sql("__q_text")))
    df = df.withColumns({"__q_form": F.expr(form_sql("__q_text")), "__q_n": F.expr(f"regexp_extract_all(__q_text, '{NUMBER.replace(chr(92), chr(92) * 2)}', 0)")})
    df = df.join(F.broadcast(alias_table(df.sparkSession)), F.col("__q_form") == F.col("q_form"), "left")
    df = df.withColumns({"__q_a": F.expr(scaled_sql("get(__q_n, 0)")), "__q_b": F.expr(f"case when size(__q_n) > 1 then {scaled_sql('get(__q_n, 1)')} else cast(1000000 as decimal(36, 0)) end")})
    e4 = F.expr("case when __q_b > 0 then try_cast(try_divide(2 * try_multiply(__q_a, q_factor) + __q_b - try_mod(2 * try_multiply(__q_a, q_factor) + __q_b, 2 * __q_b), 2 * __q_b) as bigint) + q_offset end")
    df = df.withColumn("value_e4", F.when(F.col("q_quantity").isNotNull(), e4))
    df = df.withColumn("value_e4", F.expr("case when q_quantity = 'rate' or value_e4 <= 1000000 then value_e4 end"))
    df = df.withColumn("quantity", F.expr("case when value_e4 is not null then q_quantity end"))
    return df.drop("q_form", "q_quantity", "q_factor", "q_offset", *[c for c in df.columns if c.startswith("__q_")])


def found_sql() -> str:
    """The same in DuckDB's SQL over evidence_item: item_id, quantity, value_e4."""
    rows = ", ".join(f"('{f}', '{q}', {k})" for f, q, k in aliases())
    return f"""
    with a(form, quantity, factor) as (values {rows}),
    t as (select item_id, {written_text('frequency_text', 'frequency_value', "nullif(trim(frequency_unit), '')", True)} x from evidence_item),
    c as (select item_id, {clean_sql('x', True)} x from t),
    f as (select item_id, {form_sql('x', True)} form, regexp_extract_all(x, '{NUMBER}') n from c),
    v as (select item_id, quantity, factor, {scaled_sql('n[1]', True)} x, case when len(n) > 1 then {scaled_sql('n[2]', True)} else 1000000 end y from f join a using (form)),
    w as (select item_id, quantity, try_cast((2 * (x::hugeint * factor) + y::hugeint) // (2 * y::hugeint) as bigint) value_e4 from v where y > 0)
    select item_id, quantity, value_e4 from w where value_e4 <= case quantity when 'rate' then 9223372036854775807 else 1000000 end"""

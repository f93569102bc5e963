"""Nested JSON and path-shaped columns as flat tables with parent-child links.

One higher-order projection per record: nested transforms walk the parsed
value level by level and attach ancestor path, key and index to every child;
flatten joins the children of a level; the walk ends when a level is empty.
One inline per target table then emits its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import lit

# Keys under which a lone object is an array of one and a text holding JSON is that JSON.
LIST_KEYS = (
    "class_members",
    "selected_drugs",
    "labels",
    "spl_chunks",
    "drug_event_evidence",
    "evidence_snippets",
    "event_evidence_items",
    "frequencies",
    "source_details",
    "drivers",
)

NODE = "struct<path:string,parent:string,collection:string,element:boolean,v:variant>"


#: Levels the parser reads; the walk has no limit of its own.
DEEPEST = 1000
#: Stands behind a text, so that the parser has to read it to its end.
END = "\u2402end of text\u2402"


def _parsed_sql(text: str) -> str:
    """SQL of a text that is one JSON value and nothing else as variant, else null."""
    whole = f"try_variant_get(w, '$[1]', 'string') = '{END}' and try_variant_get(w, '$[2]', 'variant') is null"
    wrapped = f"""transform(array(try_parse_json(concat('[', {text}, ',"{END}"]'))), w -> case when {whole} then try_variant_get(w, '$[0]', 'variant') end)[0]"""
    # a text of as many levels as the parser reads can't be wrapped: its brackets have to close once, at its end
    strings = lit(r'"(?:[^"\\]|\\.)*+"|[^\[\]{}]')
    closed = f"""aggregate(split(regexp_replace({text}, {strings}, ''), ''), named_struct('d', 0, 'n', 0), (a, c) -> named_struct('d', a.d + case when c in ('[', '{{') then 1 when c = '' then 0 else -1 end, 'n', a.n + int(a.d = 1 and c in (']', '}}'))), a -> a.d = 0 and a.n = 1)"""
    deep = f"length(regexp_replace({text}, {lit(r'[^\[{]')}, '')) >= {DEEPEST} and {text} rlike {lit(r'[\]}]\s*$')} and {closed}"
    return f"coalesce({wrapped}, case when {deep} then try_parse_json({text}) end)"


def _nodes_sql(text: str, list_keys: tuple[str, ...]) -> str:
    """SQL of all object elements in a JSON text: array of NODE, null if the text doesn't parse."""
    keys = ", ".join(f"'{k}'" for k in list_keys) or "''"
    is_object = "schema_of_variant({}) like 'OBJECT%'".format
    is_array = "schema_of_variant({}) like 'ARRAY%'".format
    is_text = "schema_of_variant({}) = 'STRING'".format
    # a member's value with texts read as JSON under the list keys
    parsed = f"if(e.key in ({keys}) and {is_text('e.value')}, coalesce({_parsed_sql('cast(e.value as string)')}, e.value), e.value)"
    lone = f"e.key in ({keys}) and {is_object('w')}"
    inner = "if(n.element, n.path, n.parent)"  # children of an element object have it as parent
    member = f"""transform(array({parsed}), w -> named_struct(
        'path', concat(n.path, '.', e.key, if({lone}, '[0]', '')), 'parent', {inner},
        'collection', e.key, 'element', coalesce({lone}, false), 'v', w))[0]"""
    item = "named_struct('path', concat(n.path, '[', i, ']'), 'parent', n.parent, 'collection', n.collection, 'element', true, 'v', x)"
    children = f"""flatten(transform(acc.f, n -> case
        when {is_object('n.v')} then transform(filter(map_entries(try_variant_get(n.v, '$', 'map<string,variant>')), e -> e.value is not null), e -> {member})
        when {is_array('n.v')} then transform(try_variant_get(n.v, '$', 'array<variant>'), (x, i) -> {item})
        else cast(array() as array<{NODE}>) end))"""
    children = f"filter({children}, n -> {is_object('n.v')} or {is_array('n.v')})"
    here = f"filter(acc.f, n -> n.element and {is_object('n.v')})"
    root = f"array(named_struct('path', '$', 'parent', '$', 'collection', cast(null as string), 'element', false, 'v', __v))"
    depth = f"sequence(0, length(regexp_replace({text}, '[^\\\\[{{]', '')) + 1)"
    start = f"named_struct('f', cast({root} as array<{NODE}>), 'o', cast(array() as array<{NODE}>))"
    step = f"if(size(acc.f) = 0, acc, named_struct('f', cast({children} as array<{NODE}>), 'o', concat(acc.o, {here})))"
    walk = f"aggregate({depth}, {start}, (acc, d) -> {step}, acc -> acc.o)"
    return f"transform(array({_parsed_sql(text)}), __v -> case when __v is not null then {walk} end)[0]"


def json_nodes(df: DataFrame, id_column: str, text: str, list_keys: tuple[str, ...] = LIST_KEYS) -> DataFrame:
    """``record_id`` and ``nodes``, the object elements of arrays at any depth.

    A node has ``path`` (``$.a[0].b.c[2]``, null elements counted), ``parent``
    (path of the nearest enclosing element object, else ``$``), ``collection``
    (the key its array stands under) and ``v`` (the object). Under
    ``list_keys`` a lone object is an array of one and a text holding JSON is
    that JSON. Null, blank and unparseable texts have no nodes, nor have texts
    with anything behind the JSON. Of a repeated key the last value counts; the
    session is set to allow them. The walk is as deep as the text, which the
    parser reads up to DEEPEST levels; a deeper text has no nodes. Keys stand
    in paths as they are, so a key with a point or bracket can make two paths
    alike; ``unread`` tells which texts had no nodes.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = df.select(F.col(id_column).alias("record_id"), F.col(text).alias("__text"))
    nodes = rows.select("record_id", F.expr(_nodes_sql("__text", list_keys)).alias("nodes"))
    return nodes


def unread(nodes: DataFrame, df: DataFrame, id_column: str, text: str) -> DataFrame:
    """record_id and error of the texts without nodes: ``blank`` (null, empty or white space) or ``not JSON`` (also cut off, with something behind it, or too deep)."""
    rows = df.select(F.col(id_column).alias("record_id"), F.when(F.length(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))) > 0, "not JSON").otherwise("blank").alias("error"))
    return rows.join(nodes.filter("nodes is null").select("record_id").distinct(), "record_id", "left_semi")


def links(nodes: DataFrame) -> DataFrame:
    """One row per node: record_id, parent_path, child_path."""
    pairs = F.expr("transform(nodes, n -> named_struct('parent_path', n.parent, 'child_path', n.path))")
    return nodes.select("record_id", F.inline(pairs))


def table(nodes: DataFrame, collection: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one collection: record_id, parent_path, path, ordinal and ``columns``.

    ``columns`` maps a column's name to its type; a field that is missing, null
    or of another type is null. A name with points is that of a field within
    an object; its column has underscores instead.
    """
    fields = ", ".join(f"'{c.replace('.', '_')}', try_variant_get(n.v, '$.{c}', '{t}')" for c, t in columns.items())
    ordinal = "int(regexp_extract(n.path, '\\\\[([0-9]+)\\\\]$', 1))"
    rows = F.expr(f"transform(filter(nodes, n -> n.collection = '{collection}'), n -> named_struct('parent_path', n.parent, 'path', n.path, 'ordinal', {ordinal}, {fields}))")
    return nodes.select("record_id", F.inline(rows))


def path_steps(path: Column) -> Column:
    """Steps of a slash path in lower case, without empty steps and white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(path), r"\s+", ""), "/"), lambda s: F.length(s) > 0)


def path_links(df: DataFrame, id_column: str, path: str) -> DataFrame:
    """record_id, parent_path (section and subsection steps) and child_path of rows whose path has a subsection step.

    Null, blank and subsection-less paths give no row.
    """
    rows = df.select(F.col(id_column).alias("record_id"), path_steps(F.col(path)).alias("__steps"))
    rows = rows.filter(F.exists("__steps", lambda s: s.rlike(r"^subsection(\[|$)")))
    return rows.select("record_id", F.array_join(F.filter("__steps", lambda s: s.rlike(r"^(sub)?section(\[|$)")), "/").alias("parent_path"), F.array_join("__steps", "/").alias("child_path"))


def subsections(df: DataFrame, id_column: str, path: str, title: str) -> DataFrame:
    """The section tree of each row's path with the titles of its subsections.

    One row per section or subsection step: record_id, parent_path, path, depth
    and title; titles are split at ``>`` or ``›`` and belong to the subsection
    steps in order (null where there are fewer titles).
    """
    steps = F.filter(path_steps(F.col(path)), lambda s: s.rlike(r"^(sub)?section(\[|$)"))
    titles = F.transform(F.split(F.col(title), "[>›]"), lambda t: F.trim(t))
    rows = df.select(F.col(id_column).alias("record_id"), steps.alias("__s"), titles.alias("__t"))
    nodes = F.expr(
        "transform(__s, (s, i) -> named_struct('parent_path', array_join(slice(__s, 1, i), '/'), 'path', array_join(slice(__s, 1, i + 1), '/'),"
        " 'depth', i, 'title', nullif(get(__t, size(filter(slice(__s, 1, i + 1), z -> startswith(z, 'subsection'))) - 1), '')))"
    )
    return rows.select("record_id", F.inline(nodes)).withColumn("title", F.when(F.element_at(F.split("path", "/"), -1).startswith("subsection"), F.col("title")))

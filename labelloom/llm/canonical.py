"""Text in a form without letter case, white space, punctuation and field order.

There are two forms. The plain one ignores every character that isn't a
letter, digit or %. The strict one ignores punctuation only: it keeps what
changes the meaning, that is symbols (``<`` ``>`` ``±`` ``+`` ``=`` ``°``), the
point or comma inside a number, the minus before one, and accents, composed
or not.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = r"[^\p{L}\p{N}%]+"
STRICT = r"(?:(?!(?<=\p{N})[.,](?=\p{N})|(?<![\p{L}\p{N}])-(?=\p{N}))[^\p{L}\p{N}\p{M}\p{S}%])+"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """Accents joined with their letters; only texts with loose accents go to Python."""
    return F.coalesce(_composed(F.when(text.rlike(r"\p{M}"), text)), text)


def canonical_text(text: Column, strict: bool = False) -> Column:
    """Lower case; every run of ignored characters is one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), STRICT if strict else PLAIN, " "))


def canonical_fields(text: Column, strict: bool = False) -> Column:
    """As ``canonical_text`` with the fields between ``|`` in sorted order; empty fields vanish."""
    fields = F.transform(F.split(text, r"\|"), lambda t: canonical_text(t, strict))
    return F.array_join(F.array_sort(F.filter(fields, lambda f: F.length(f) > 0)), " ")


def canonical_sql(text: str, strict: bool = False) -> str:
    """``canonical_text`` in DuckDB's SQL."""
    if not strict:
        return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}%]+', ' ', 'g'))"
    # what is kept inside and before numbers is marked first; twice, for numbers that share a digit
    out = f"lower({text})"
    for _ in range(2):
        out = f"regexp_replace({out}, '(\\p{{N}})[.](\\p{{N}})', '\\1\ue000\\2', 'g')"
        out = f"regexp_replace({out}, '(\\p{{N}}),(\\p{{N}})', '\\1\ue001\\2', 'g')"
    out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}])-(\\p{{N}})', '\\1\ue002\\2', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{S}}%\ue000\ue001\ue002]+', ' ', 'g')"
    return f"trim(translate({out}, '\ue000\ue001\ue002', '.,-'))"


def canonical_fields_sql(text: str, strict: bool = False) -> str:
    """``canonical_fields`` in DuckDB's SQL."""
    return f"array_to_string(list_sort(list_filter(list_transform(string_split({text}, '|'), lambda x: {canonical_sql('x', strict)}), lambda x: length(x) > 0)), ' ')"

"""Text functions of the label rules as SQL expressions over SQL expressions.

Every function takes and returns SQL text, so rules compose inside
higher-order functions and stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

STOP = ""  # stands for a full stop that ends no sentence


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(template: str, **columns: str) -> str:
    """SQL of a pattern without case; ``{name}`` is replaced by the column's SQL."""
    parts = re.split(r"\{([a-z])\}", template)
    pieces = [lit(p) if i % 2 == 0 else columns[p] for i, p in enumerate(parts)]
    pieces = [p for p in pieces if p != "''"]
    return lit("(?iU)" + template) if len(parts) == 1 else f"concat({lit('(?iU)')}, {', '.join(pieces)})"


def has(text: str, template: str, **columns: str) -> str:
    """Whether a pattern occurs."""
    return f"{text} rlike {pattern(template, **columns)}"


def has_any(text: str, templates: tuple[str, ...], **columns: str) -> str:
    """Whether any of the patterns occurs, tried in one pass."""
    return has(text, "|".join(f"(?:{t})" for t in templates), **columns)


def collapse(text: str) -> str:
    """White space collapsed; single plain spaces are no matches, so they cost nothing."""
    return f"trim(regexp_replace({text}, {lit('(?U)[\\s\\x1c-\\x1f]{2,}|[\\s\\x1c-\\x1f&&[^ ]]')}, ' '))"


def quoted(term: str) -> str:
    """SQL of a pattern for a literal term, its spaces any white space."""
    return f"concat({lit('\\Q')}, replace({term}, ' ', {lit('\\E\\s+\\Q')}), {lit('\\E')})"


def term_pattern(term: str) -> str:
    """SQL of a whole-word pattern for a term's SQL."""
    return f"concat({lit('(?iU)(?<!\\w)')}, {quoted(term)}, {lit('(?!\\w)')})"


def names_term(text: str, term: str) -> str:
    """SQL: whether a text names a literal term; the pattern runs only where the term's first word may be (long s and Kelvin sign fold to s and k)."""
    word = lit(term.lower().split(" ")[0])
    return f"((contains(lower({text}), {word}) or contains({text}, 'ſ') or contains({text}, 'K')) and {text} rlike {term_pattern(lit(term))})"


def sentences(text: str) -> str:
    """Sentences of a text; common abbreviations don't end one."""
    out = collapse(text)
    for short in ("e.g.", "i.e.", "U.S.", "Dr."):
        out = f"replace({out}, {lit(short)}, {lit(short.replace('.', STOP))})"
    out = f"regexp_replace({out}, {lit('(?U)\\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St)\\.(?=\\s+[A-Z])')}, {lit('$1' + STOP)})"
    out = f"split({out}, {lit('(?<=[.!?])\\s+(?=[A-Z0-9])')})"
    return f"filter(transform({out}, s -> trim(replace(s, {lit(STOP)}, '.'))), s -> length(s) > 0)"


def clauses(sentence: str) -> str:
    """Clauses of a sentence: parts between semicolons without a leading conjunction."""
    return f"filter(transform(split({sentence}, {lit('\\s*;\\s*')}), c -> regexp_replace(trim(c), {lit('(?i)^(?:and|but|while|whereas)\\s+')}, '')), c -> length(c) > 0)"


def extract_all(text: str, patterns: tuple[str, ...]) -> str:
    """Distinct matches in order of patterns, then of places."""
    arrays = ", ".join(f"transform(regexp_extract_all({text}, {pattern(p)}, 0), m -> trim(m))" for p in patterns)
    # most texts hold none, which one pass tells
    return f"if({has_any(text, patterns)}, array_distinct(filter(flatten(array({arrays})), m -> length(m) > 0)), if({text} is null, null, cast(array() as array<string>)))"


def tokens(text: str) -> str:
    """Words of letters a-z and digits in lower case."""
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+', 0)"


def fold_characters(value: str) -> str:
    """Compatibility form in caseless comparison form; letters, digits and % only, single spaces."""
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join("".join(c if c.isalnum() or c == "%" else " " for c in folded).split())


#: ASCII characters but NUL that are neither letters nor digits nor %.
SIGNS = "".join(c for c in map(chr, range(1, 128)) if not c.isalnum() and c != "%")


def fold(text: str) -> str:
    """``fold_characters`` for plain ASCII without NUL and without leaving the JVM.

    Signs become spaces one by one, which is far cheaper than a replacement by
    pattern at every space; only runs are left to the pattern.
    """
    return f"trim(regexp_replace(translate(lower({text}), {lit(SIGNS)}, {lit(' ' * len(SIGNS))}), ' {{2,}}', ' '))"


def strip_headings(folded: str, headings: str) -> str:
    """A folded text without leading headings, taken off again and again, longest first.

    ``headings`` is the SQL of an array of folded headings. Each round takes
    one off; there can be no more rounds than the text has words.
    """
    ordered = f"array_sort(array_distinct(filter({headings}, h -> length(h) > 0)), (a, b) -> length(b) - length(a))"
    hit = "get(filter(acc.hs, h -> startswith(concat(acc.t, ' '), concat(h, ' '))), 0)"
    step = f"transform(array({hit}), f -> if(f is null, acc.t, trim(substr(acc.t, length(f) + 1))))[0]"
    rounds = f"sequence(0, size(split({folded}, ' ')))"
    zero = f"named_struct('t', {folded}, 'hs', {ordered})"
    begins = f"exists({headings}, h -> length(h) > 0 and startswith(concat({folded}, ' '), concat(h, ' ')))"
    return f"if(not {begins}, {folded}, aggregate({rounds}, {zero}, (acc, i) -> named_struct('t', {step}, 'hs', acc.hs), acc -> acc.t))"

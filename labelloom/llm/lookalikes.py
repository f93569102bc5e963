"""Visually identical text with different characters, brought to one form.

Look-alike classes are the transitive closure, by union-find over strings and
code points, of Unicode's own decompositions and of its full table of
confusable characters and sequences (as the ICU library in Spark's JVM holds
it). Of each class the member that is most frequent in the corpus stands for
the others: within a script for letters, over all for punctuation. Texts are
rewritten greedily, longest match first, by multi-pattern automata. Letters
are rewritten only where they stand in for look-alikes; the context can veto
it, for words of another language and for letters used as symbols.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pairs that the table of confusable characters keeps apart in small letters only.
PAIRS = (("k", "κ"), ("x", "χ"))
# Fixed value: letters of another script that stand for themselves at the edge of a Latin word (TNFα, γGT).
SYMBOLS = frozenset("αβγδεθλμπσφψωΓΔΘΛΠΣΦΨΩ")
#: Kinds of compatibility forms that are letters and digits in another shape; superscripts, fractions and signs aren't.
KINDS = ("<wide>", "<narrow>", "<font>", "<circle>", "<compat>")
PLAIN_SPACES = " \t\n\r"
#: Scripts that words can be brought to; letters of any other script can only stand in for theirs.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
#: Names of Latin letters of phonetic writing that look like plain ones; plain letters come before PHONETIC.
PHONETIC_NAMES = re.compile(r"LATIN (?:LETTER SMALL CAPITAL [A-Z]|SMALL LETTER SCRIPT G|SMALL LETTER ALPHA)$")
PHONETIC = 0x250
#: Picture signs that are joined; neither the signs of Latin-1 and of letters (™ ℃ №) nor framed letters.
PICTURE = "[\u2194\u2195\u2600-\u2767\u2794-\u27bf\u2b00-\u2bff\U0001f000-\U0001f0ff\U0001f300-\U0001faff]"
#: Invisible characters that are part of a picture: a joiner between two signs, and the closed tags of a flag.
PICTURE_PARTS = re.compile(rf"(?:(?<={PICTURE})|(?<={PICTURE}[\ufe00-\ufe0f]))\u200d(?={PICTURE})|(?<={PICTURE})[\U000e0020-\U000e007e]+\U000e007f")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def unite(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def all(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values()]


@lru_cache(maxsize=1)
def unicode_pairs() -> tuple[tuple[str, str], ...]:
    """Pairs by rule from the Unicode data: shaped letters and digits, spaces, decomposed accents."""
    pairs = []
    for code in range(0x80, 0x110000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Zs":
            pairs.append((" ", c))
            continue
        tag, _, rest = unicodedata.decomposition(c).rpartition(">")
        if not rest:
            continue
        if not tag:
            apart = unicodedata.normalize("NFD", c)
            if len(apart) > 1 and unicodedata.normalize("NFC", apart) == c and unicodedata.combining(apart[1]):
                pairs.append((c, apart))
        elif tag + ">" in KINDS and (kind[0] in "LNP" or tag == "<circle"):
            plain = unicodedata.normalize("NFKC", c)
            wide = tag in ("<wide", "<narrow")
            if plain != c and (plain.isalnum() and "GREEK" not in unicodedata.name(plain[0], "") or wide and plain.isprintable() and plain.isascii()):
                pairs.append((plain, c))
    return tuple(pairs)


@lru_cache(maxsize=1)
def invisible() -> frozenset[str]:
    """Format characters that show nothing, and fillers."""
    return frozenset(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)) | {"ᅟ", "ᅠ", "ㅤ", "͏"}


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    """LATIN, CYRILLIC, GREEK, ARMENIAN, OTHER, or nothing for what isn't a letter."""
    if c.isascii():
        return "LATIN" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "OTHER")


@lru_cache(maxsize=1)
def _candidates() -> tuple[str, ...]:
    """Assigned characters but ideographs, syllables and separators, which look like nothing else."""
    left_out = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x17000, 0x18D00), (0x20000, 0x3FFFF))
    return tuple(chr(c) for c in range(0x21, 0x110000) if unicodedata.category(chr(c))[0] in "LNPSM" and not any(a <= c <= b for a, b in left_out))


_PROTOTYPES: dict[str, str] = {}


def prototypes(spark: SparkSession) -> dict[str, str]:
    """Characters and the string that each looks like, from Unicode's table of confusables; its size is fixed by Unicode."""
    if not _PROTOTYPES:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        found = checker.getSkeleton("\n".join(_candidates())).split("\n")
        _PROTOTYPES.update((c, p) for c, p in zip(_candidates(), found, strict=True) if c != p and unicodedata.normalize("NFD", c) != p)
    return _PROTOTYPES


def is_mark(member: str) -> bool:
    """Whether a string is of punctuation and signs only (the modifier apostrophe counts as one)."""
    return all(unicodedata.category(c)[0] in "PS" or c == "ʼ" for c in member)


def sequences(prototypes: dict[str, str]) -> list[str]:
    """The sequences of signs that look like one sign."""
    return sorted({p for p in prototypes.values() if len(p) > 1 and is_mark(p)})


def _automaton(table: dict[str, str | None]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for pattern, by in table.items():
        out.add_word(pattern, (pattern, by))
    out.make_automaton()
    return out


class Rewriter:
    """Classes, representatives and the automata for a corpus with the given character counts."""

    SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
    WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")

    def __init__(self, counts: dict[str, int], prototypes: dict[str, str]):
        self.counts = counts
        shaped, alike = Classes(), Classes()
        for a, b in unicode_pairs():
            shaped.unite(a, b)
        for a, b in (*prototypes.items(), *PAIRS):
            alike.unite(a, b)
        shapes = {b for _, b in unicode_pairs()}
        # shapes: the most frequent member that isn't a shape of another one
        table: dict[str, str | None] = dict.fromkeys(invisible(), "")
        for group in shaped.all():
            plain = [m for m in group if m not in shapes] or group
            best = max(plain, key=self._frequency)
            table |= {m: best for m in group if m != best}
        self.shaped = _automaton(table)
        # letters: for each script the most frequent member of the same kind (capital, small, ...)
        self.by_script: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
        variants: dict[str, str | None] = {}
        for group in alike.all():
            letters = [m for m in group if len(m) == 1 and m not in shapes and script(m)]
            for s in SCRIPTS:
                for kind in {unicodedata.category(m) for m in letters}:
                    own = [m for m in letters if script(m) == s and unicodedata.category(m) == kind and (s != "LATIN" or ord(m) < PHONETIC)]
                    if own:
                        best = max(own, key=self._frequency)
                        self.by_script[s] |= {m: best for m in letters if script(m) != s and unicodedata.category(m) == kind}
            # punctuation: the most frequent member, sequences included
            marks = [m for m in group if is_mark(m)]
            if len(marks) > 1 and not any(m.isascii() and m.isalnum() for m in group):
                best = max(marks, key=self._frequency)
                variants |= {m: best for m in marks if m != best}
        self.phonetic = {c: p for c in map(chr, range(PHONETIC, 0x2000)) if (p := self._plain_letter(c, alike))}
        self.letters = _automaton({c: None for t in self.by_script.values() for c in t if not c.isascii()} | dict.fromkeys(self.phonetic))
        self.variants = _automaton(variants)

    def _frequency(self, member: str) -> tuple:
        """Order of a class's members: how often it occurs, then shorter and smaller ones."""
        return self.counts.get(member, 0), -len(member), [-ord(c) for c in member]

    @staticmethod
    def _plain_letter(c: str, alike: Classes) -> str | None:
        """The plain small letter that a letter of phonetic writing looks like."""
        name = unicodedata.name(c, "")
        if not PHONETIC_NAMES.match(name):
            return None
        return name[-1].lower() if "CAPITAL" in name else next((m for m in "abcdefghijklmnopqrstuvwxyz" if alike.find(m) == alike.find(c)), None)

    def shapes(self, text: str) -> str:
        """Shaped, joined, spaced, decomposed and hidden characters rewritten, longest match first from the left."""
        out, at, kept = [], 0, None
        for end, (pattern, by) in self.shaped.iter_long(text):
            begin = end + 1 - len(pattern)
            if by == "":
                if kept is None:
                    kept = {i for m in PICTURE_PARTS.finditer(text) for i in range(*m.span())}
                if begin in kept:
                    continue
            out.append(text[at:begin])
            out.append(by)
            at = end + 1
        return "".join([*out, text[at:]]) if out else text

    def _target(self, word: str, sentence: Counter) -> str | None:
        """The script that a word's letters stand in for, or None: the context's veto."""
        scripts = Counter(s for c in word if (s := script(c)))
        names = [s for s in scripts if s != "LATIN"]
        if not names:
            # phonetic letters among plain ones, but no transcription
            odd = [c for c in word if ord(c) >= PHONETIC and c not in self.phonetic and script(c)]
            return "LATIN" if not odd and any(c.isascii() for c in word) else None
        if len(scripts) == 1:
            # a whole word: only in a sentence of another script without a word of this one
            s = names[0]
            if len(word) < (2 if s == "CYRILLIC" else 3) or sentence[s] or not sentence["LATIN"]:
                return None
            return "LATIN" if all(c in self.by_script["LATIN"] for c in word) else None
        letters, most = scripts.total(), max(SCRIPTS, key=lambda s: (sentence[s], s == "LATIN"))
        for s in sorted(set(scripts) & set(SCRIPTS), key=lambda s: (-sentence[s], -scripts[s], s)):
            # a few letters of a script don't claim a word, unless all around it is Latin
            if 2 * scripts[s] < letters and not s == most == "LATIN":
                continue
            if all(script(c) == s or c in self.by_script[s] for c in word if script(c)):
                return s
        whole = most == "LATIN" and "LATIN" not in scripts and all(c in self.by_script["LATIN"] for c in word if script(c))
        return "LATIN" if whole else None

    def scripts(self, text: str) -> str:
        """Letters in place of look-alikes rewritten, where the automaton finds one and the context agrees."""
        places = {end for end, _ in self.letters.iter(text)}
        if not places:
            return text
        out, at = list(text), 0
        for sentence in [*self.SENTENCE.finditer(text), None]:
            stop = sentence.start() if sentence else len(text)
            if any(at <= p < stop for p in places):
                found = list(self.WORD.finditer(text, at, stop))
                sure = self._sure(m[0] for m in found)
                for m in found:
                    if not m[0].isascii() and (to := self._target(m[0], sure)):
                        table = self.phonetic | self.by_script[to] if to == "LATIN" else self.by_script[to]
                        for i in range(*m.span()):
                            if (c := text[i]) in table and not (c in SYMBOLS and i in (m.start(), m.end() - 1)):
                                out[i] = table[c]
            if sentence:
                at = sentence.end()
        return "".join(out)

    def _sure(self, words: Iterable[str]) -> Counter:
        """Words that are surely of a script: they hold a letter without a look-alike in Latin."""
        sure: Counter = Counter()
        for w in words:
            kinds = {s for c in w if (s := script(c))}
            if kinds == {"LATIN"}:
                sure["LATIN"] += 1
            elif len(kinds) == 1 and any(c not in self.by_script["LATIN"] for c in w if script(c)):
                sure[kinds.pop()] += 1
        return sure

    def rewrite(self, text: str | None) -> str | None:
        """One consistent form of a text; null stays null, plain ASCII stands for itself."""
        if text is None or text.isascii():
            return text
        return self.scripts(self.shapes(text))

    def compare(self, text: str | None) -> str | None:
        """A rewritten text with typographic variants of one sign (quotes, dashes, bullets) as their most frequent one."""
        if text is None:
            return None
        out, at = [], 0
        for end, (pattern, by) in self.variants.iter_long(text):
            out += (text[at : end + 1 - len(pattern)], by)
            at = end + 1
        return "".join([*out, text[at:]]) if out else text


def string_counts(texts: Iterable[DataFrame], strings: Iterable[str] = ()) -> dict[str, int]:
    """How often each character and each of the ``strings`` occurs in all rows of the one-column frames; as many entries as characters in use and strings."""
    strings = list(strings)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        points = np.zeros(0x110000, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = [t for t in batch.slice(at, 1000).column(0).to_pylist() if t]
                codes, n = np.unique(np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32), return_counts=True)
                points[codes] += n
                if strings:
                    joined = "\n".join(part)
                    total.update({s: k for s in strings if (k := joined.count(s))})
        total.update({chr(c): int(points[c]) for c in np.flatnonzero(points)})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["s", "n"])

    out: Counter = Counter()
    for df in texts:
        for r in df.mapInArrow(count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r.s] += r.n
    return dict(out)


_KEPT: dict[int, Rewriter] = {}


def unify(df: DataFrame, id_column: str, text: str, counts: dict[str, int], compare: bool = False) -> DataFrame:
    """``id_column``, ``unified`` and ``changed`` of every row; with ``compare`` also ``comparable``.

    ``unified`` is the text without disguises, ``changed`` tells whether it had
    any. ``comparable`` has typographic variants of one sign alike, too. Rows
    whose text is null or plain ASCII pass without leaving the JVM unless
    ``compare`` is set. Empty texts stay empty, repeated rows stay repeated,
    extra columns are not read.
    """
    rows = df.select(F.col(id_column), F.col(text).alias("unified"))
    odd = F.col("unified").rlike(r"[^\x00-\x7F]")
    shared = df.sparkSession.sparkContext.broadcast((counts, dict(prototypes(df.sparkSession))))
    key = hash(tuple(sorted(counts.items())))
    names = [id_column, "unified", "changed", *(["comparable"] if compare else [])]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Rewriter(*shared.value)
        to = _KEPT[key]
        for batch in batches:
            old = batch.column(1).to_pylist()
            new = [to.rewrite(t) for t in old]
            columns = [batch.column(0), pa.array(new, pa.string()), pa.array([a != b for a, b in zip(old, new, strict=True)], pa.bool_())]
            if compare:
                columns.append(pa.array([to.compare(t) for t in new], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = [T.StringType(), T.BooleanType(), T.StringType()]
    schema = T.StructType([rows.schema[0], *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=False))])
    if compare:
        return rows.mapInArrow(rewrite, schema)
    plain = rows.filter(F.coalesce(~odd, F.lit(True))).withColumn("changed", F.lit(False))
    return plain.unionByName(rows.filter(odd).mapInArrow(rewrite, schema))

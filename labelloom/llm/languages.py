"""Languages of documents and of the segments of mixed ones, with a confidence.

Nearest-centroid classification: a word is a vector of hashed character
n-grams, weighted by term frequency and by the inverse document frequency over
the whole corpus; a segment is the sum of its words' vectors over the sum of
their lengths. Its products with several clustered unit centroids per language
are the mean cosines of its words, weighted by their lengths; the largest one
names the language. A segment too far from all centroids, or without words,
has no language. Since all of this is a sum over words, each distinct word is
hashed and compared once, however often it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("en", "es", "de", "fr", "pt", "it", "nl", "ru")
# Codes and names of the languages in the ways they are written.
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "ingles"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "castilian"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "ru": ("ru", "rus", "russian", "русский"),
}
#: Buckets of hashed n-grams; labelled rows of a language to learn from; centroids of a language.
BUCKETS, SAMPLE_ROWS, CENTROIDS = 1 << 15, 120, 4
#: Cosine below which a segment has no language. What a segment needs to differ from the document's main language: cosine, lead, letters and different words.
REJECT, NEAR, LEAD, LEAST_LETTERS, LEAST_WORDS = 0.01, 0.045, 0.03, 12, 5
GRAMS = (1, 2, 3, 4)
#: Distinct words a task remembers before it starts again; results don't depend on it.
REMEMBERED = 200_000

CODE = re.compile(r"\b(?=\w*\d)[\w-]+|\b[A-ZА-Я]{2,}-\d+\b")
BREAK = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n\s*\n|\n(?=\s*[-•*–]\s)|(?<=[:;])\s*\n")
LETTER = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"[\w-]+")
#: Runs of word characters, and what ends a segment as in BREAK (it ends in white space).
RUN_OR_END = re.compile(r"[\w-]+|[.!?…][\"'”»)\]]*\s+|\n\s*\n|\n(?=\s*[-•*–]\s)|[:;]\s*\n")
END = -1


def label(lang: Column) -> Column:
    """The language a label names (a code or name in any case, with or without a country), ``other``, or null."""
    word = F.regexp_extract(F.lower(F.trim(lang)), r"^([\p{L}\p{M}]+)", 1)
    out = F.when(F.length(word) > 0, F.when(word.isin("und", "unknown", "undetermined", "none", "null", "unk"), None).otherwise("other"))
    for code, names in NAMES.items():
        out = F.when(word.isin(*names), code).otherwise(out)
    return out


def segments(text: str | None) -> list[str]:
    """Sentences and list entries of a text; a line break inside a sentence doesn't end it."""
    return [s for s in BREAK.split(text) if s and s.strip()] if text else []


def words_of(run: str) -> list[str]:
    """The lower-case words of an unbroken run of letters, digits, underscores and hyphens; codes and numbers aren't words."""
    return [run.lower()] if run.isalpha() else LETTER.findall(CODE.sub(" ", run).lower())


def plain(text: str) -> list[str]:
    """Lower-case words of a text, without codes and numbers."""
    return [w for run in RUN.findall(text) for w in words_of(run)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, count) of the hashed n-grams of words between two spaces, by word and bucket."""
    joined = "".join(f" {w} " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words]) if words else np.zeros(0, np.int64)
    keys = []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        own = owner[: len(h)]
        inside = (own == owner[n - 1 :]) & ((n > 1) | (codes[: len(h)] != 32))
        keys.append(own[inside] * BUCKETS + (h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


@dataclass
class Model:
    """Inverse document frequencies and unit centroids with their languages; remembers the words it has seen."""

    idf: np.ndarray
    centroids: np.ndarray  # buckets x centroids
    languages: list[str]
    runs: dict[str, tuple[int, ...]] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)
    new: list[str] = field(default_factory=list)
    products: np.ndarray | None = None  # words x centroids
    sizes: np.ndarray | None = None  # words x (length of the vector, letters)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, bucket, weight) of words."""
        word, bucket, count = features(words)
        return word, bucket, (1 + np.log(np.maximum(count, 1))) * self.idf[bucket]

    def numbers(self, text: str, pattern: re.Pattern = RUN) -> list[int]:
        """The text's words as numbers, with END where ``pattern`` finds the end of a segment; new words wait for ``learn``."""
        found = pattern.findall(text)
        held = list(map(self.runs.get, found))
        if None in held:
            for run in found:
                if run not in self.runs:
                    own = [] if run[-1].isspace() else words_of(run)
                    for w in own:
                        if w not in self.known:
                            self.known[w] = len(self.known)
                            self.new.append(w)
                    self.runs[run] = (END,) if run[-1].isspace() else tuple(self.known[w] for w in own)
            held = map(self.runs.__getitem__, found)
        return list(chain.from_iterable(held))

    def learn(self) -> None:
        """Compares the waiting words with all centroids."""
        if self.products is None:
            self.products, self.sizes = np.zeros((0, self.centroids.shape[1]), np.float32), np.zeros((0, 2), np.float32)
        for at in range(0, len(self.new), 2000):
            part = self.new[at : at + 2000]
            word, bucket, weight = self.vectors(part)
            first = np.searchsorted(word, np.arange(len(part)))
            product = np.add.reduceat(self.centroids[bucket] * weight[:, None].astype(np.float32), first, axis=0)
            size = np.stack([np.sqrt(np.add.reduceat(weight * weight, first)), [len(w) for w in part]], axis=1)
            self.products, self.sizes = np.concatenate([self.products, product]), np.concatenate([self.sizes, size.astype(np.float32)])
        self.new.clear()

    def forget(self) -> None:
        """Starts again when too many words are remembered."""
        if len(self.known) + len(self.runs) > 2 * REMEMBERED:
            self.runs.clear(), self.known.clear()
            self.products = self.sizes = None

    def cosines(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """segments x languages: mean cosine of the words with the nearest centroid of each language; and the segments' letters.

        ``numbers`` are the words of all segments, ``first`` the place of each segment's first word; no segment is empty.
        """
        self.learn()
        out = np.zeros((len(first), len(LANGUAGES)), np.float32)
        if not len(first):
            return out, np.zeros(0)
        size = np.add.reduceat(self.sizes[numbers], first, axis=0)
        if self.languages:
            product = np.add.reduceat(self.products[numbers], first, axis=0) / np.maximum(size[:, :1], 1e-12)
            names = np.array(self.languages)
            for k, l in enumerate(LANGUAGES):
                if (names == l).any():
                    out[:, k] = product[:, names == l].max(axis=1)
        return out, size[:, 1]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=0, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Number of documents of the whole corpus with each bucket, and of all documents with words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        # documents are marked one by one and added in bytes, which are emptied before they overflow
        mark, some, n = np.zeros(BUCKETS, np.uint8), np.zeros(BUCKETS, np.uint8), 0
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [set(RUN.findall(t)) if t else set() for t in batch.slice(at, 64).column(0).to_pylist()]
                if len(held) > REMEMBERED:
                    held.clear()
                if new := [r for r in set().union(*found) if r not in held]:
                    words = [(i, w) for i, r in enumerate(new) for w in words_of(r)]
                    word, bucket, _ = features([w for _, w in words])
                    owner = np.array([i for i, _ in words], np.int64)[word] if words else np.zeros(0, np.int64)
                    edges = np.searchsorted(owner, np.arange(len(new) + 1))
                    bucket = bucket.astype(np.int32)
                    held |= {r: bucket[edges[i] : edges[i + 1]] for i, r in enumerate(new)}
                for runs in found:
                    if runs and len(seen := np.concatenate([held[r] for r in runs])):
                        mark[seen] = 1
                        some += mark
                        mark[seen] = 0
                        n += 1
                        if n % 255 == 0:
                            total[:BUCKETS] += some
                            some[:] = 0
        total[:BUCKETS] += some
        total[BUCKETS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = np.zeros(BUCKETS + 1, np.int64)
    for r in docs.select(F.col(text)).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        found[r.bucket] = r.n
    return found[:BUCKETS], int(found[BUCKETS])


def fit(docs: DataFrame, text: str, lang: str, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learns from at most ``sample_rows`` labelled rows of each language; document frequencies cover all rows.

    Labels may be wrong: one centroid per label is made first, segments that
    lie nearer to another language's are dropped, and the rest is clustered.
    """
    frequencies, n = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + frequencies)) + 0.1
    pool = docs.select(label(F.col(lang)).alias("l"), F.col(text).alias("t")).filter(F.col("l").isin(*LANGUAGES) & (F.length("t") > 0))
    order = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    sample = [(r.l, r.t) for r in pool.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample_rows).toLocalIterator()]
    model = Model(idf, np.zeros((BUCKETS, 0), np.float32), [])
    texts, names = [], []
    for l, t in sorted(sample):
        for s in segments(t):
            numbers = model.numbers(s)
            if sum(map(len, plain(s))) >= 2 * LEAST_LETTERS:
                texts.append(numbers)
                names.append(l)
    names = np.array(names, dtype=object)
    known = [l for l in LANGUAGES if (names == l).any()]
    if not known:
        return model
    # the segments' vectors: sums of their words' vectors over the sum of the lengths
    word, bucket, weight = model.vectors(list(model.known))
    edges = np.searchsorted(word, np.arange(len(model.known) + 1))
    length = np.sqrt(np.add.reduceat(weight * weight, edges[:-1]))
    flat = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    spans = edges[flat + 1] - edges[flat]
    at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(edges[flat], spans)
    key, place = np.unique(np.repeat(owner, spans) * BUCKETS + bucket[at], return_inverse=True)
    segment, bucket = key // BUCKETS, key % BUCKETS
    weight = np.bincount(place, weight[at], len(key)) / np.bincount(owner, length[flat], len(texts))[segment]
    first = np.searchsorted(segment, np.arange(len(texts)))

    def mean(group: np.ndarray, n: int) -> np.ndarray:
        """Unit means of the segments in each of n groups; -1 is no group."""
        own = group[segment]
        keep = own >= 0
        return _unit(np.bincount(bucket[keep] * n + own[keep], weight[keep], BUCKETS * n).reshape(BUCKETS, n)).astype(np.float32)

    def products(centroids: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(centroids[bucket, c] * weight, first) for c in range(centroids.shape[1])], axis=1)

    start = np.array([known.index(x) for x in names])
    group = start
    for _ in range(4):
        nearest = products(mean(group, len(known))).argmax(axis=1)
        group = np.where(nearest == start, start, -1)
    columns, languages = [], []
    for i, l in enumerate(known):
        members = np.flatnonzero(group == i)
        if not len(members):
            members = np.flatnonzero(start == i)
        k = min(centroids, len(members))
        part = np.full(len(texts), -1)
        part[members] = np.arange(len(members)) % k
        for _ in range(6):
            part[members] = products(mean(part, k))[members].argmax(axis=1)
        used = [c for c in range(k) if (part == c).any()]
        columns.append(mean(part, k)[:, used])
        languages += [l] * len(used)
    return Model(idf, np.concatenate(columns, axis=1), languages)


def decide(model: Model, segments: list[list[int]], owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language (-1 for none) and confidence of non-empty segments; ``owner`` is the text of each, of ``n`` texts.

    A segment gets the nearest language. It gets the document's main language
    instead if that is nearly as near, if the segment is short or repeats few
    words, or if one half of its words lies nearer to it: loose foreign words
    and short pieces don't make a mixed document.
    """
    starts = lambda parts: np.cumsum([0, *map(len, parts)])[:-1]
    joined = lambda parts: np.fromiter(chain.from_iterable(parts), np.int64)
    cosines, letters = model.cosines(joined(segments), starts(segments))
    if not len(segments):
        return np.zeros(0, np.int64), np.zeros(0)
    best = cosines.argmax(axis=1)
    votes = np.zeros((n, len(LANGUAGES)))
    np.add.at(votes, owner, cosines * letters[:, None])
    main = votes.argmax(axis=1)[owner]
    every = np.arange(len(segments))
    top, lead = cosines[every, best], cosines[every, best] - cosines[every, main]
    other = (best != main) & (top >= NEAR) & (letters >= LEAST_LETTERS) & (lead >= LEAD)
    other[[i for i in np.flatnonzero(other) if len(set(segments[i])) < LEAST_WORDS]] = False
    doubtful = np.flatnonzero(other)
    if len(doubtful):
        halves = [h for i in doubtful for w in (segments[i],) for h in (w[: (len(w) + 1) // 2], w[len(w) // 2 :])]
        near = model.cosines(joined(halves), starts(halves))[0].reshape(len(doubtful), 2, len(LANGUAGES))
        each = np.arange(len(doubtful))
        other[doubtful] = (near[each, :, best[doubtful]] > near[each, :, main[doubtful]]).all(axis=1)
    chosen = np.where(other, best, main)
    value = cosines[every, chosen]
    cosines[every, chosen] = -1
    known = (top >= REJECT) & (letters >= 3)
    sure = np.where(known, np.clip(0.5 + (value - cosines.max(axis=1)) / (2 * np.maximum(value, 1e-9)), 0, 1), 0)
    return np.where(known, chosen, -1), np.round(sure.astype(float), 4)


def decide_segments(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]]]:
    """Language ('' for none) and confidence of all segments of many texts, and the texts' segments."""
    model.forget()
    parts = [segments(t) for t in texts]
    flat = [model.numbers(s) for p in parts for s in p]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    filled = np.array([bool(f) for f in flat], bool)
    names, sure = np.full(len(flat), -1), np.zeros(len(flat))
    names[filled], sure[filled] = decide(model, [f for f in flat if f], owner[filled], len(parts))
    return [LANGUAGES[i] if i >= 0 else "" for i in names], sure.tolist(), parts


def decide_documents(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, number of segments, summed confidence) of the languages of many texts."""
    model.forget()
    flat: list[list[int]] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        numbers = model.numbers(t, RUN_OR_END) if t else []
        numbers.append(END)
        at = 0
        while at < len(numbers):
            end = numbers.index(END, at)
            if end > at:
                flat.append(numbers[at:end])
                owner.append(i)
            at = end + 1
    owner = np.array(owner, np.int64)
    names, sure = decide(model, flat, owner, len(texts))
    key = owner[names >= 0] * len(LANGUAGES) + names[names >= 0]
    count = np.bincount(key, minlength=1)
    found = np.flatnonzero(count)
    return found // len(LANGUAGES), found % len(LANGUAGES), count[found], np.bincount(key, sure[names >= 0], minlength=1)[found]


def _decided(docs: DataFrame, id_column: str, text: str, lang: str, model: Model, schema: list[T.StructField], rows) -> DataFrame:
    """What ``rows(model, texts)`` tells of the texts: numbers of texts and columns, in Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf.astype(np.float32), model.centroids, model.languages))
    taken = docs.select(F.col(id_column), label(F.col(lang)).alias("label"), F.col(text).alias("__text")).filter(F.length("__text") > 0)
    fields = [taken.schema[0], T.StructField("label", T.StringType()), *schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                index, columns = rows(own, part.column(2).to_pylist())
                index = pa.array(index, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), *columns], names=[f.name for f in fields])

    return taken.mapInArrow(run, T.StructType(fields))


def classify(docs: DataFrame, id_column: str, text: str, lang: str, model: Model) -> DataFrame:
    """One row per segment: ``id_column``, ``label`` (what ``lang`` names), segment, segment_text, lang (null: none) and confidence.

    Null, empty and blank texts give no row; repeated rows and null ids stay
    as they are.
    """

    def rows(model: Model, texts: list[str]) -> tuple[list[int], list[pa.Array]]:
        names, sure, parts = decide_segments(model, texts)
        numbers, texts = [i for p in parts for i in range(len(p))], [s for p in parts for s in p]
        return [d for d, p in enumerate(parts) for _ in p], [pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array([n or None for n in names], pa.string()), pa.array(sure, pa.float64())]

    schema = [T.StructField("segment", T.IntegerType()), T.StructField("segment_text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]
    return _decided(docs, id_column, text, lang, model, schema, rows)


def document_languages(docs: DataFrame, id_column: str, text: str, lang: str, model: Model) -> DataFrame:
    """``classify`` summed up in the same pass: ``id_column``, ``label``, lang, and number of segments and summed confidence of each row's languages."""

    def rows(model: Model, texts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        index, names, counts, sums = decide_documents(model, texts)
        return index, [pa.array([LANGUAGES[i] for i in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())]

    schema = [T.StructField("lang", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sure", T.DoubleType())]
    return _decided(docs, id_column, text, lang, model, schema, rows)


def mislabelled(languages: DataFrame, id_column: str) -> DataFrame:
    """``id_column``, lang and confidence of documents whose label is missing or wrong, and of all languages of mixed ones.

    ``languages`` is the result of ``document_languages``; rows with the same
    id and label are one document. The confidence is the mean over the
    language's segments. Documents without a language give no row.
    """
    by = languages.groupBy(id_column, "label", "lang").agg((F.sum("sure") / F.sum("n")).alias("confidence"))
    docs = by.groupBy(id_column, "label").agg(F.collect_list(F.struct("lang", "confidence")).alias("__l"))
    wrong = (F.size("__l") > 1) | F.col("label").isNull() | (F.col("label") != F.col("__l")[0]["lang"])
    return docs.filter(wrong).select(id_column, F.inline("__l"))

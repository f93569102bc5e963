"""Test passages inside a training corpus, by a distributed positional inverted index.

Index: the corpus is cut into shards of bounded size; a shard stores, for each
term that any test item holds, the rows and positions at which it occurs. It is
built once, whatever the number of items, and a shard is one row, so it is
queried where it lies, without a shuffle.
Query: a shard is asked only for the items whose rarest terms (by their counts
in the whole corpus) it holds. From there on the lists of the other terms are
intersected after subtracting each term's offset, and only what survives is
carried on. Items are taken in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import written

#: Words a shard holds at least before the next begins, and items of a block.
SHARD_WORDS, BLOCK_ITEMS = 200_000, 20_000
#: Distinct terms of all items up to which only these are stored; beyond, every term of the corpus is.
VOCABULARY = 2_000_000
WORD = re.compile(r"[^\W_]+")
SPARK_INDEX = "docs array<bigint>, terms array<string>, ends array<int>, rows array<int>, positions array<int>"


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits in lower case."""
    return WORD.findall(text.lower()) if text else []


def vocabulary_of(items: DataFrame, text: str) -> set[str] | None:
    """The distinct terms of all items, or None if they are more than VOCABULARY."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0).to_pylist() for w in words(t)}), pa.string())], names=["term"])

    found = items.select(F.col(text)).mapInArrow(terms, "term string").distinct().limit(VOCABULARY + 1)
    known = {r.term for r in found.toLocalIterator()}
    return known if len(known) <= VOCABULARY else None


def build_index(docs: DataFrame, id_column: str, text: str, vocabulary: set[str] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Positional postings of the whole texts, written to the shared folder.

    One row per shard: ``docs`` (the id of each row of the shard), ``terms`` in
    order, and their postings (``rows`` and ``positions``, those of a term end
    at its ``ends``). ``vocabulary`` limits the stored terms to those that a
    query can ask for; positions count all words. Null and empty texts have no
    postings. Rows with the same id are separate texts.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    shared = docs.sparkSession.sparkContext.broadcast(None if vocabulary is None else sorted(vocabulary))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = shared.value
        names = list(fixed or ())
        number = {w: i for i, w in enumerate(names)}
        ids: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            term = np.concatenate(held)
            row = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])
            position = np.concatenate([np.arange(len(h), dtype=np.int32) for h in held])
            keep = term >= 0
            term, row, position = term[keep], row[keep], position[keep]
            order = np.argsort(term, kind="stable")
            used, count = np.unique(term, return_counts=True)
            columns = [ids, [names[t] for t in used], np.cumsum(count), row[order], position[order]]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(lists, names=["docs", "terms", "ends", "rows", "positions"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = words(body)
                    if fixed is None:
                        for w in found:
                            if w not in number:
                                number[w] = len(names)
                                names.append(w)
                    ids.append(doc)
                    held.append(np.fromiter(map(number.get, found, repeat(-1)), np.int32, len(found)))
                    size += len(found)
                    if size >= shard_words:
                        yield flush()
                        ids, held, size = [], [], 0
                        if fixed is None:
                            names, number = [], {}
        if held:
            yield flush()

    return written(rows.mapInArrow(index, SPARK_INDEX), "postings")


def term_counts(index: DataFrame) -> dict[str, int]:
    """Occurrences of each stored term in the whole corpus; as large as the vocabulary."""
    sizes = F.expr("transform(terms, (t, i) -> struct(t as term, ends[i] - if(i = 0, 0, ends[i - 1]) as n))")
    counts = index.select(F.inline(sizes)).groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counts.toLocalIterator()}


def covering_anchors(item: list[str], length: int, counts: dict[str, int]) -> Iterator[tuple[int, int, int]]:
    """(place, first window, last window) of the words that are the rarest of some windows of ``length`` words; windows with a word that the corpus lacks are left out."""
    rarity = [(counts.get(w, 0), i) for i, w in enumerate(item)]
    place = start = last = -1
    for k in range(len(item) - length + 1):
        window = rarity[k : k + length]
        best = min(window)[1] if all(n for n, _ in window) else -1
        if best != place:
            if place >= 0:
                yield place, start, last
            place, start = best, k
        last = k
    if place >= 0:
        yield place, start, last


class Shard:
    """The postings of one shard."""

    def __init__(self, docs: list[int | None], terms: list[str], ends: np.ndarray, rows: np.ndarray, positions: np.ndarray):
        self.docs = docs
        # row and position in one sorted number; 2^20 below zero stay free for offsets
        self.all = (rows.astype(np.int64) << 32) + positions + (1 << 20)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.spans = {t: (int(a), int(b)) for t, a, b in zip(terms, starts, ends, strict=True)}

    def keys(self, term: str) -> np.ndarray:
        a, b = self.spans[term]
        return self.all[a:b]

    def holds(self, term: str, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are postings of the term."""
        if term not in self.spans:
            return np.zeros(len(keys), bool)
        own = self.keys(term)
        at = np.searchsorted(own, keys)
        at[at == len(own)] = 0
        return own[at] == keys

    def phrase(self, item: list[str], length: int, anchor: tuple[int, int, int], counts: dict[str, int]) -> np.ndarray:
        """Rows that hold ``length`` successive words of the item in one of the anchor's windows."""
        place, first, last = anchor
        found = self.keys(item[place])
        # all of the anchor's windows share these words; from the rarest on
        for i in sorted(range(last, first + length), key=lambda i: (counts[item[i]], i)):
            if i != place:
                found = found[self.holds(item[i], found + (i - place))]
                if not len(found):
                    return found
        left, right = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        for side, steps in ((left, range(last - 1, first - 1, -1)), (right, range(first + length, last + length))):
            alive = np.arange(len(found))
            for i in steps:
                alive = alive[self.holds(item[i], found[alive] + (i - place))]
                side[alive] += 1
                if not len(alive):
                    break
        return np.unique(found[left + right + (first + length - last) >= length] >> 32)

    def near(self, terms: list[str], need: int, span: int) -> dict[int, int]:
        """Rows in which at least ``need`` of the terms, given from the rarest on, lie within ``span`` words, with the most found.

        A row with so many of them holds one of the first, so the others are looked up only in the rows of these.
        """
        lists = {t: np.unique(self.keys(t) >> 32) for t in terms if t in self.spans}
        first = [lists[t] for t in terms[: len(terms) - need + 1] if t in lists]
        if not first or len(lists) < need:
            return {}
        rows = np.unique(np.concatenate(first))
        held = np.zeros(len(rows), np.int64)
        for i, t in enumerate(terms):
            if (own := lists.get(t)) is not None:
                at = np.searchsorted(own, rows)
                at[at == len(own)] = 0
                held += own[at] == rows
            enough = held + (len(terms) - 1 - i) >= need
            rows, held = rows[enough], held[enough]
            if not len(rows):
                return {}
        best: dict[int, int] = {}
        for row in rows.tolist():
            if (n := self.closest(terms, row, span)) >= need:
                best[row] = n
        return best

    def closest(self, terms: list[str], row: int, span: int) -> int:
        """The most different terms within ``span`` words of a row."""
        low, high = row << 32, (row + 1) << 32
        places, names = [], []
        for i, t in enumerate(terms):
            if t in self.spans:
                own = self.keys(t)
                part = own[np.searchsorted(own, low) : np.searchsorted(own, high)]
                places.append(part)
                names.append(np.full(len(part), i))
        place, name = np.concatenate(places), np.concatenate(names)
        order = np.argsort(place, kind="stable")
        held, left, different, most = [0] * len(terms), 0, 0, 0
        place, name = place[order].tolist(), name[order].tolist()
        for right, n in enumerate(name):
            different += held[n] == 0
            held[n] += 1
            while place[right] - place[left] >= span:
                held[name[left]] -= 1
                different -= held[name[left]] == 0
                left += 1
            most = max(most, different)
        return most


def _blocks(items: DataFrame, id_column: str, text: str, size: int) -> Iterator[list[tuple[int, list[str]]]]:
    rows = items.select(id_column, text).filter(F.col(id_column).isNotNull() & (F.length(text) > 0)).toLocalIterator()
    while block := [(r[0], words(r[1])) for r in islice(rows, size)]:
        yield block


def _asked(index: DataFrame, asked: list[tuple], by_term: dict[str, list[int]], answer, schema: str) -> DataFrame:
    """``answer(shard, entry)`` for the entries of ``asked`` of which the shard holds a term in ``by_term``, as rows of bigints."""
    shared = index.sparkSession.sparkContext.broadcast((asked, by_term))
    names = [c.split()[0] for c in schema.split(", ")]

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, by = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                docs, terms, ends, rows, positions = (batch.column(i).slice(at, 1).flatten() for i in range(5))
                shard = Shard(docs.to_pylist(), terms.to_pylist(), ends.to_numpy(), rows.to_numpy(), positions.to_numpy())
                wanted = sorted({e for t in shard.spans for e in by.get(t, ())})
                out = list(dict.fromkeys(r for e in wanted for r in answer(shard, entries[e])))
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return index.mapInArrow(query, schema)


def shared_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 10, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id and item_id of every document and item that share at least ``length`` successive words.

    Items or documents that are null, empty or shorter share nothing. Repeated
    rows give one row. Other columns are not read.
    """
    index = build_index(docs, doc_id, doc_text, vocabulary_of(items, item_text))
    counts, found = term_counts(index), []
    for block in _blocks(items, item_id, item_text, block_items):
        asked = [(i, item, anchor) for i, item in block for anchor in covering_anchors(item, length, counts)]
        by_term: dict[str, list[int]] = {}
        for e, (_, item, anchor) in enumerate(asked):
            by_term.setdefault(item[anchor[0]], []).append(e)
        own = {w: counts[w] for _, item, _ in asked for w in item if w in counts}

        def answer(shard: Shard, entry: tuple, own: dict[str, int] = own) -> Iterator[tuple[int | None, int]]:
            return ((shard.docs[r], entry[0]) for r in shard.phrase(entry[1], length, entry[2], own).tolist())

        found.append(_asked(index, asked, by_term, answer, "doc_id bigint, item_id bigint"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return reduce(DataFrame.unionByName, found).distinct()


def near_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.75, span: int = 40, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id and n_terms: at least ``share`` of the item's different words lie within ``span`` words of the document, or within the item's length and a quarter if that is more.

    Words that no document holds don't count. n_terms is the largest number of
    different words so close together. Every such pair is found: passages
    altered here and there, cut or put in another order. Nulls and empty texts
    as in ``shared_passages``.
    """
    index = build_index(docs, doc_id, doc_text, vocabulary_of(items, item_text))
    counts, found = term_counts(index), []
    for block in _blocks(items, item_id, item_text, block_items):
        asked, by_term = [], {}
        for i, item in block:
            terms = sorted((w for w in set(item) if w in counts), key=lambda w: (counts[w], w))
            need = -int(-share * len(terms) // 1)
            if need > 0:
                for t in terms[: len(terms) - need + 1]:
                    by_term.setdefault(t, []).append(len(asked))
                asked.append((i, terms, need, max(span, 5 * len(item) // 4)))

        def answer(shard: Shard, entry: tuple) -> Iterator[tuple[int | None, int, int]]:
            return ((shard.docs[r], entry[0], n) for r, n in shard.near(*entry[1:]).items())

        found.append(_asked(index, asked, by_term, answer, "doc_id bigint, item_id bigint, n_terms bigint"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_terms bigint")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("n_terms").alias("n_terms"))

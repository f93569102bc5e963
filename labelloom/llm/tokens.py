"""Byte-pair encoding of whole corpora by a lazily determinised transducer.

A byte-pair vocabulary is compiled into a transducer over bytes. A state holds
the hypotheses (last finished token, bytes read since); tokens are emitted as
soon as all hypotheses agree on them, after a lookahead bounded by the longest
token. States and transitions are made when first met and kept up to a bound.
Two tokens may follow each other exactly if the merges of their joined bytes
give these two tokens back, so every prefix has one tokenization and the
encoding equals that of the merge rules.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pattern that splits a text into pieces for byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of what a worker keeps: transducer states, finished pieces, token pairs.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 200_000, 200_000, 2_000_000
DEFAULT_FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids (which are also the merge ranks) of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, max_pairs: int = MAX_PAIRS):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.tokens = {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        # trie over the tokens: node -> {byte: node}, and the token that ends at a node
        self.edges: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                after = self.edges[node].get(byte)
                if after is None:
                    after = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(-1)
                node = after
            self.ends[node] = i
        # a token that its own merges don't reproduce never occurs in an encoding
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the start."""
        # a state: tuple of (pending tokens, last token or -1, trie node), the finished hypothesis first
        self.start = (((), -1, 0),)
        self.ids: dict[tuple, int] = {self.start: 0}
        self.states: list[tuple] = [self.start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, data: bytes) -> list[int]:
        """The tokens of ``data`` by the merge rules: the lowest rank first, leftmost among equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return [self.ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the merges of the two tokens' bytes give just them; ``first`` -1: the second alone."""
        known = self.pairs.get((first, second))
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            left = b"" if first < 0 else self.tokens[first]
            known = self.merged(left + self.tokens[second]) == ([second] if first < 0 else [first, second])
            self.pairs[first, second] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that are certain now."""
        move = self.moves[state].get(byte)
        if move is not None:
            return move
        longer, done = [], None
        for pending, last, node in self.states[state]:
            after = self.edges[node].get(byte)
            if after is None:
                continue
            if self.edges[after]:
                longer.append((pending, last, after))
            token = self.ends[after]
            if token >= 0 and done is None and self.may_follow(last, token):
                done = ((*pending, token), token, 0)
        hypotheses = [done, *longer]
        common = 0  # tokens that all hypotheses have begun with
        shortest = min(len(h[0]) for h in hypotheses)
        while common < shortest and len({h[0][common] for h in hypotheses}) == 1:
            common += 1
        out = hypotheses[0][0][:common]
        key = tuple((p[common:], last, node) for p, last, node in hypotheses)
        if (target := self.ids.get(key)) is None:
            target = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = (target, out)
        return target, out

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if len(self.states) > self.max_states:
            self.reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in data:
            move = moves[state].get(byte) or self.step(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.states[state][0][0])
        return out


class Encoder:
    """Texts in, token ids out: pieces by pattern, each by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES, max_pieces: int = MAX_PIECES):
        self.transducer, self.pattern, self.max_pieces = Transducer(ranks), regex.compile(pattern), max_pieces
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts. Lone surrogates become replacement characters."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode("utf-8", "replace"))
                if len(piece) <= 32:
                    if len(known) >= self.max_pieces:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out


class Utf8Decoder:
    """Incremental UTF-8: bytes in, characters out as soon as they are complete.

    A state machine over lead and continuation bytes; a malformed sequence
    gives one replacement character and the byte that broke it is read anew.
    """

    def __init__(self) -> None:
        self.left, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.left and not self.low <= b <= self.high:
                out.append("�")
                self.left = 0
            if self.left:
                self.value, self.left, self.low, self.high = self.value << 6 | b & 0x3F, self.left - 1, 0x80, 0xBF
                if not self.left:
                    out.append(chr(self.value))
            elif b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.left = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.value = b & (0x1F, 0x0F, 0x07)[self.left - 1]
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        """What is left at the end: a replacement character for a cut sequence."""
        cut, self.left = self.left, 0
        return "�" if cut else ""


_KEPT: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = PIECES) -> Encoder:
    """The encoder of a vocabulary file, made once in each worker."""
    if (path, pattern) not in _KEPT:
        _KEPT[path, pattern] = Encoder(read_ranks(path), pattern)
    return _KEPT[path, pattern]


def encode_texts(df: DataFrame, id_column: str, text: str, path: str | None = None, out: str = "ids", pattern: str = PIECES) -> DataFrame:
    """``id_column`` and ``out``, the token ids of every row's whole text.

    Null and empty texts have an empty list. No special tokens are added and
    their strings are ordinary text. Repeated rows and null ids stay as they are.
    """
    path = path or f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"
    rows = df.select(F.col(id_column), F.col(text).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, out])

    schema = T.StructType([rows.schema[0], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(encode, schema)


def decode_ids(df: DataFrame, id_column: str, ids: str, path: str | None = None, out: str = "text") -> DataFrame:
    """``id_column`` and ``out``, the text of every row's ids, decoded token by token.

    A null list gives null, an empty one an empty text; an id outside the
    vocabulary raises.
    """
    path = path or f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"
    rows = df.select(F.col(id_column), F.col(ids).alias("__ids"))

    def one(tokens: dict[int, bytes], row: list[int] | None) -> str | None:
        if row is None:
            return None
        machine = Utf8Decoder()
        return "".join([machine.feed(tokens[i]) for i in row]) + machine.close()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).transducer.tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(tokens, r) for r in part.column(1).to_pylist()], pa.string())], names=[id_column, out])

    return rows.mapInArrow(decode, T.StructType([rows.schema[0], T.StructField(out, T.StringType())]))

"""Encoding of whole texts with a byte-level BPE tokenizer, by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: The public split pattern of byte-level BPE rank files (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a cache is emptied; it changes speed only.
CACHE_ENTRIES = 400_000


class _Cache(dict):
    """Encoded pieces; a missing one is computed, and kept if short."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 48:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Exact ids of a rank file (one base64 token and its rank a line).

    A piece of the split pattern is encoded by its prefixes: an automaton over the vocabulary gives
    the tokens that are suffixes of each prefix, longest first; the last token of a prefix is the
    unique one that is compatible with the last token of the prefix before it, that is, no merge
    crosses the boundary of the two. Following the tokens back from the end gives the ids. The time
    is linear in the bytes, whatever the length of a piece.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.suffixes = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), (rank, len(token)))
        self.suffixes.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, bool], list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.words = re.compile(r" (?=\S)").split
        self.pieces = _Cache(self._piece)
        self.spaced = _Cache(lambda word: self._word(" " + word))
        self.opening = _Cache(self._word)

    def encode(self, text: str | None) -> bytes:
        """The ids as int32 bytes. A blank before another character always begins a piece, so the
        text is cut there and words are looked up; the rest of the pattern works within them."""
        if not text:
            return b""
        first, *rest = self.words(text)
        return self.opening[first] + b"".join(map(self.spaced.__getitem__, rest))

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), np.int32).tolist()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(word)))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return np.int32(whole).tobytes()
        last, lengths = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        pairs = self.pairs
        for end, (token, length) in self.suffixes.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start:
                    pair = last[start], token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.compatible(*pair)
                else:
                    fits = self._reachable(token)
                if fits:
                    last[end + 1], lengths[end + 1] = token, length
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= lengths[at]
        if len(pairs) > CACHE_ENTRIES:
            pairs.clear()
        return np.array(out[::-1], np.int32).tobytes()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of a and b, one after the other, are encoded as just a, b: as both
        grow from bytes in the order of merges, no merge ever takes the pieces at the boundary."""
        left, right = self._edge(a, True), self._edge(b, False)
        if not left or not right:
            return False
        i = j = 0
        never = len(self.ranks) + 1
        while True:
            grow_left = left[i + 1] if i + 1 < len(left) else never
            grow_right = right[j + 1] if j + 1 < len(right) else never
            across = self.ranks.get(self.tokens[left[i]] + self.tokens[right[j]], never)
            if across < grow_left and across <= grow_right and across < never:
                return False
            if grow_left == grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _edge(self, token: int, end: bool) -> list[int]:
        """The pieces that touch one end of a token while it grows, from its byte to itself; empty
        if merges never make the token."""
        key = token, end
        if key not in self.edges:
            halves = self._halves(token)
            if halves:
                inner = self._edge(halves[end], end)
                self.edges[key] = [*inner, token] if inner else []
            else:
                self.edges[key] = [token] if len(self.tokens[token]) == 1 else []
        return self.edges[key]

    def _reachable(self, token: int) -> bool:
        return bool(self._edge(token, False) and self._edge(token, True))

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, k = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a rank file, built once per Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", *, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and ids (array of int) of every text, without special tokens; their names in a text are
    plain text. Null and empty texts give an empty list; a null key stays null; repeated rows come
    out repeated; an empty table gives no rows. Texts are encoded whole, in place: no shuffle.
    `folder` must hold `<vocabulary>.tiktoken` on every executor."""
    path = f"{folder}/{vocabulary}.tiktoken"
    source = documents.select(F.col(key), F.col(text).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for b in batches:
            coded = [model.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", *, keep: tuple[str, ...] = (), vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key, the columns `keep` and n_tokens (int) of every text; 0 for null and empty texts."""
    path = f"{folder}/{vocabulary}.tiktoken"
    source = documents.select(key, *keep, F.col(text).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for b in batches:
            n = pa.array([len(model.encode(t)) // 4 for t in b.column(b.num_columns - 1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[key, *keep, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, n_tokens int")

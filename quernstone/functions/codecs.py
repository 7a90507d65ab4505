"""Exactly invertible transforms of byte strings. No Spark here; `udfs` wraps them.

Every transform is a pair (encode, decode) with decode(encode(x)) == x for all bytes; decoders never
fail on other input."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

from quernstone.functions.hashing import splitmix64_int
from quernstone.operators.text import HOISTED, SUFFIXES

_WORD = re.compile(rb"[A-Za-z]+")
_RUNS = re.compile(rb"[A-Za-z]+|[^A-Za-z]+")
ESC, MARK, MARK2 = 0, 1, 2


def varint(n: int) -> bytes:
    """Seven bits a byte, low first."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place and where it ends; stops at five bytes or the end."""
    n = shift = 0
    while at < len(data) and shift < 35:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    return n, at


# structural strings ------------------------------------------------------------------------------

_FIXED = [s.encode() for s in HOISTED]
_FIXED_CODE = {s: k + 1 for k, s in enumerate(_FIXED)}
_FIXED_OR_RESERVED = re.compile(b"|".join(re.escape(s) for s in sorted(_FIXED, key=lambda s: -len(s))) + rb"|[\x00-\x1f\x7f]")
_CODE = re.compile(rb"\x00([\s\S]?)|([\x01-\x1f])")


def hoist(data: bytes) -> bytes:
    return _FIXED_OR_RESERVED.sub(lambda m: bytes([_FIXED_CODE[m[0]]]) if m[0] in _FIXED_CODE else b"\0" + m[0], data)


def unhoist(data: bytes) -> bytes:
    return _CODE.sub(lambda m: _FIXED[m[2][0] - 1] if m[2] else m[1] or b"\0", data)


# permutation -------------------------------------------------------------------------------------


def frequency_table(data: bytes) -> bytes:
    """Code of every byte: 0 for the most frequent, ties by byte."""
    count = Counter(data)
    order = sorted(range(256), key=lambda b: (-count[b], b))
    table = bytearray(256)
    for code, b in enumerate(order):
        table[b] = code
    return bytes(table)


def permute(data: bytes) -> bytes:
    table = frequency_table(data)
    return table + data.translate(table)


def unpermute(data: bytes) -> bytes:
    table, inverse = data[:256], bytearray(256)
    for b, code in enumerate(table):
        inverse[code] = b
    return data[256:].translate(bytes(inverse))


def permute_random(data: bytes, seed: int = 1) -> bytes:
    """The control: an alphabet in an order that has nothing to do with the data."""
    table, state = list(range(256)), seed
    for i in range(255, 0, -1):
        state = splitmix64_int(state)
        j = state % (i + 1)
        table[i], table[j] = table[j], table[i]
    return bytes(table) + data.translate(bytes(table))


# letter case -------------------------------------------------------------------------------------

_CASED = re.compile(rb"[A-Za-z]+|[\x00-\x03]")
_UNCASE = re.compile(rb"\x00([\s\S])|([\x01-\x03])([A-Za-z]*)")


def _case(w: bytes) -> int:
    return 0 if w.islower() else 1 if w[:1].isupper() and (len(w) == 1 or w[1:].islower()) else 2 if w.isupper() else 3


def _case_encode(data: bytes, fold: bool) -> bytes:
    def sub(m: re.Match) -> bytes:
        w = m[0]
        if w[0] < 4:
            return b"\0" + w
        k = _case(w)
        return (bytes([k]) if k else b"") + (w.lower() if fold and k < 3 else w)

    return _CASED.sub(sub, data)


def case_fold(data: bytes) -> bytes:
    return _case_encode(data, True)


def case_unfold(data: bytes) -> bytes:
    def sub(m: re.Match) -> bytes:
        if m[2] is None:
            return m[1]
        k, w = m[2][0], m[3]
        return w[:1].upper() + w[1:] if k == 1 else w.upper() if k == 2 else w

    return _UNCASE.sub(sub, data)


def case_mark(data: bytes) -> bytes:
    """The control: marks without folding."""
    return _case_encode(data, False)


def case_unmark(data: bytes) -> bytes:
    return _UNCASE.sub(lambda m: m[1] if m[2] is None else m[3], data)


# vocabularies ------------------------------------------------------------------------------------


def vocabulary(counts: Counter, top: int = 255) -> list[bytes]:
    """Words that save bytes as one-byte ids, by count, ties by word."""
    ok = [(n, w) for w, n in counts.items() if len(w) >= 3 and n >= 2 and n * (len(w) - 2) - (len(w) + 1) > 0]
    return [w for n, w in sorted(ok, key=lambda x: (-x[0], x[1]))[:top]]


def wide_vocabulary(counts: Counter, top: int = 65_534) -> list[bytes]:
    """The same for ids of two bytes, or three from the 255th kept word on: whether a word saves
    depends on how many were kept before it."""
    kept: list[bytes] = []
    for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        code = 2 if len(kept) < 254 else 3
        if len(w) >= 3 and n >= 2 and n * (len(w) - code) - (len(w) + 1) > 0:
            kept.append(w)
            if len(kept) == top:
                break
    return kept


_LOW = re.compile(rb"[\x00-\x02]")


def _escape(run: bytes) -> bytes:
    return _LOW.sub(lambda m: b"\0" + m[0], run) if _LOW.search(run) else run


def _words_of(data: bytes) -> Counter:
    return Counter(_WORD.findall(data))


def _header(vocab: list[bytes]) -> bytes:
    return varint(len(vocab)) + b"".join(varint(len(w)) + w for w in vocab)


def _read_header(data: bytes) -> tuple[list[bytes], int]:
    n, at = read_varint(data, 0)
    vocab = []
    for _ in range(min(n, len(data))):
        size, at = read_varint(data, at)
        vocab.append(data[at : at + size])
        at += size
    return vocab, at


class _Ids:
    """A list of ids that may change with use: `static`, `front` or `second`."""

    def __init__(self, n: int, how: str):
        self.how = how
        self.order = np.arange(n) if how != "static" else range(n)

    def rank(self, word: int) -> int:
        r = int((self.order == word).argmax()) if self.how != "static" else word
        self._use(r)
        return r

    def word(self, rank: int) -> int:
        w = int(self.order[rank]) if rank < len(self.order) else -1
        self._use(rank)
        return w

    def _use(self, rank: int) -> None:
        if self.how != "static" and 0 < rank < len(self.order):
            to, w = 0 if self.how == "front" or rank == 1 else 1, self.order[rank]
            self.order[to + 1 : rank + 1] = self.order[to:rank]
            self.order[to] = w


def tokenize(data: bytes, vocab: list[bytes] | None = None, *, how: str = "static", reverse: bool = False, blocked: Iterable[bytes] = ()) -> bytes:
    """Vocabulary words as MARK and a rank; blocked words keep their ids but are not used."""
    vocab = vocabulary(_words_of(data)) if vocab is None else vocab
    vocab = vocab[::-1] if reverse else vocab
    blocked = set(blocked)
    index = {w: k for k, w in enumerate(vocab) if w not in blocked}
    ids, out = _Ids(len(vocab), how), [_header(vocab)]
    for run in _RUNS.findall(data):
        k = index.get(run)
        out.append(_escape(run) if k is None else bytes([MARK]) + varint(ids.rank(k)))
    return b"".join(out)


def untokenize(data: bytes, *, how: str = "static") -> bytes:
    return _read_body(*_read_header(data), data, how)


def _read_body(vocab: list[bytes], at: int, data: bytes, how: str = "static") -> bytes:
    ids, out = _Ids(len(vocab), how), bytearray()
    while at < len(data):
        b = data[at]
        if b == ESC:
            out += data[at + 1 : at + 2]
            at += 2
        elif b == MARK:
            rank, at = read_varint(data, at + 1)
            k = ids.word(rank)
            out += vocab[k] if 0 <= k < len(vocab) else b""
        else:
            out.append(b)
            at += 1
    return bytes(out)


def tokenize_wide(data: bytes) -> bytes:
    return tokenize(data, wide_vocabulary(_words_of(data)))


def tokenize_first_use(data: bytes, top: int = 254) -> bytes:
    """No header: the first use of a word defines it, later ones refer to it."""
    vocab, ids, out = set(vocabulary(_words_of(data), top)), {}, []
    for run in _RUNS.findall(data):
        if run not in vocab:
            out.append(_escape(run))
        elif run in ids:
            out.append(bytes([MARK, ids[run]]))
        else:
            ids[run] = len(ids)
            out.append(bytes([MARK2]) + varint(len(run)) + run)
    return b"".join(out)


def untokenize_first_use(data: bytes) -> bytes:
    words, out, at = [], bytearray(), 0
    while at < len(data):
        b = data[at]
        if b == ESC:
            out += data[at + 1 : at + 2]
            at += 2
        elif b == MARK:
            k = data[at + 1] if at + 1 < len(data) else 255
            out += words[k] if k < len(words) else b""
            at += 2
        elif b == MARK2:
            size, at = read_varint(data, at + 1)
            words.append(data[at : at + size])
            out += words[-1]
            at += size
        else:
            out.append(b)
            at += 1
    return bytes(out)


def tokenize_phrases(data: bytes, reverse: bool = False) -> bytes:
    """Words and one-space pairs; a pair is taken before its first word and uses up both."""
    runs = _RUNS.findall(data)
    counts = _words_of(data)
    counts.update(a + b" " + c for a, b, c in zip(runs, runs[1:], runs[2:], strict=False) if b == b" ")
    vocab = vocabulary(counts)[:: -1 if reverse else 1]
    index, out, i = {w: k for k, w in enumerate(vocab)}, [_header(vocab)], 0
    while i < len(runs):
        pair = b"".join(runs[i : i + 3]) if i + 2 < len(runs) and runs[i + 1] == b" " and runs[i][:1].isalpha() else b""
        if pair in index:
            out.append(bytes([MARK]) + varint(index[pair]))
            i += 3
            continue
        k = index.get(runs[i])
        out.append(_escape(runs[i]) if k is None else bytes([MARK]) + varint(k))
        i += 1
    return b"".join(out)


def tokenize_front(data: bytes) -> bytes:
    """The vocabulary in word order, each entry by the letters it shares with the one before."""
    vocab = sorted(vocabulary(_words_of(data)))
    head, before = [varint(len(vocab))], b""
    for w in vocab:
        same = next((k for k, (a, b) in enumerate(zip(w, before, strict=False)) if a != b), min(len(w), len(before)))
        head.append(varint(same) + varint(len(w) - same) + w[same:])
        before = w
    return b"".join(head) + tokenize(data, vocab)[len(_header(vocab)) :]


def untokenize_front(data: bytes) -> bytes:
    n, at = read_varint(data, 0)
    vocab, before = [], b""
    for _ in range(min(n, len(data))):
        same, at = read_varint(data, at)
        size, at = read_varint(data, at)
        before = before[:same] + data[at : at + size]
        vocab.append(before)
        at += size
    return _read_body(vocab, at, data)


_SUFFIX = sorted((s.encode() for s in SUFFIXES), key=lambda s: -len(s))


@lru_cache(65_536)  # it changes speed only
def _suffix(w: bytes) -> int | None:
    return next((k for k, s in enumerate(_SUFFIX) if len(w) >= len(s) + 2 and w.endswith(s)), None)


def stem(data: bytes) -> bytes:
    """A word with a known suffix as MARK, the suffix, the stem."""
    out = []
    for run in _RUNS.findall(data):
        k = _suffix(run) if run[:1].isalpha() else None
        out.append(_escape(run) if k is None else bytes([MARK, k + 3]) + run[: len(run) - len(_SUFFIX[k])])
    return b"".join(out)


def unstem(data: bytes) -> bytes:
    def sub(m: re.Match) -> bytes:
        if m[2] is None:
            return m[1]
        k = m[2][0] - 3
        return m[3] + (_SUFFIX[k] if 0 <= k < len(_SUFFIX) else b"")

    return re.sub(rb"\x00([\s\S]?)|\x01([\s\S])([A-Za-z]*)", sub, data)


def tokenize_affix(data: bytes) -> bytes:
    """Words of the vocabulary, and words that are an entry with a known suffix."""
    counts = _words_of(data)
    for w, n in [*counts.items()]:
        if (k := _suffix(w)) is not None:
            counts[w[: len(w) - len(_SUFFIX[k])]] += n
    vocab = vocabulary(counts)
    index, out = {w: k for k, w in enumerate(vocab)}, [_header(vocab)]
    for run in _RUNS.findall(data):
        if run in index:
            out.append(bytes([MARK]) + varint(index[run]))
        elif (k := _suffix(run)) is not None and run[: len(run) - len(_SUFFIX[k])] in index:
            out.append(bytes([MARK2, k]) + varint(index[run[: len(run) - len(_SUFFIX[k])]]))
        else:
            out.append(_escape(run))
    return b"".join(out)


def untokenize_affix(data: bytes) -> bytes:
    vocab, at = _read_header(data)
    out = bytearray()
    while at < len(data):
        b = data[at]
        if b == ESC:
            out += data[at + 1 : at + 2]
            at += 2
        elif b in (MARK, MARK2):
            s = data[at + 1] if b == MARK2 and at + 1 < len(data) else 255
            k, at = read_varint(data, at + 1 + (b == MARK2))
            out += (vocab[k] if k < len(vocab) else b"") + (_SUFFIX[s] if s < len(_SUFFIX) else b"")
        else:
            out.append(b)
            at += 1
    return bytes(out)


def subword_units(vocab: list[bytes], rounds: int = 254) -> list[bytes]:
    """Units of byte-pair merging over the vocabulary; both sides derive them from it."""
    parts, units = [[w[i : i + 1] for i in range(len(w))] for w in vocab], []
    for _ in range(rounds):
        pairs = Counter(p for w in parts for p in zip(w, w[1:], strict=False))
        if not pairs or max(pairs.values()) < 2:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        units.append(a + b)
        for w in parts:
            i = 0
            while i + 1 < len(w):
                if w[i] == a and w[i + 1] == b:
                    w[i : i + 2] = [a + b]
                i += 1
    return units


def tokenize_subword(data: bytes) -> bytes:
    vocab = vocabulary(_words_of(data))
    units = [u for u in subword_units(vocab) if len(u) > 2]
    index = {u: k for k, u in enumerate(units)}
    find = re.compile(b"|".join(re.escape(u) for u in sorted(units, key=lambda u: (-len(u), u)))) if units else None
    out = [_header(vocab)]
    for run in _RUNS.findall(data):
        if find is None or not run[:1].isalpha():
            out.append(_escape(run))
        else:
            out.append(find.sub(lambda m: bytes([MARK]) + varint(index[m[0]]), run))
    return b"".join(out)


def untokenize_subword(data: bytes) -> bytes:
    vocab, at = _read_header(data)
    return _read_body([u for u in subword_units(vocab) if len(u) > 2], at, data)


# grammars ----------------------------------------------------------------------------------------


def pair_grammar(data: bytes, rules: int = 256, least: int = 8, whole_repeats: bool = False) -> tuple[list[tuple[int, int]], list[int]]:
    """Repeated pairs become rules (256 and up), the most frequent first, ties by pair. With
    whole_repeats a pair is extended while one symbol always follows it."""
    body, table = np.frombuffer(data, np.uint8).astype(np.int64), []
    while len(table) < rules and len(body) > 1:
        keys, counts = np.unique(body[:-1] << 16 | body[1:], return_counts=True)
        top = int(np.argmax(counts))  # keys ascend, so the first maximum is the smallest pair
        if counts[top] < least:
            break
        pair = int(keys[top]) >> 16, int(keys[top]) & 0xFFFF
        body = _replace(body, pair, 256 + len(table))
        table.append(pair)
        while whole_repeats and len(table) < rules:
            new = 255 + len(table)
            at = np.flatnonzero(body == new)
            after = body[at + 1] if len(at) and at[-1] + 1 < len(body) else None
            if after is None or (after != after[0]).any() or after[0] == new:
                break
            table.append((new, int(after[0])))
            body = _replace(body, table[-1], new + 1)
    return table, body.tolist()


def _replace(body: np.ndarray, pair: tuple[int, int], by: int) -> np.ndarray:
    """The body with each occurrence of a pair, from left to right, as one symbol."""
    at = np.flatnonzero((body[:-1] == pair[0]) & (body[1:] == pair[1]))
    if pair[0] == pair[1]:  # occurrences may overlap: every other one of a run counts
        fresh = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        run = np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))
        at = at[run % 2 == 0]
    out = body.copy()
    out[at] = by
    return np.delete(out, at + 1)


def _expand(table: list[tuple[int, int]], body: Iterable[int]) -> bytes:
    made: list[bytes] = []
    at = lambda s: bytes([s]) if s < 256 else made[s - 256] if s - 256 < len(made) else b""
    for a, b in table:
        made.append(at(a) + at(b))
    return b"".join(at(s) for s in body)


def _pack(table: list[tuple[int, int]], body: Iterable[int]) -> bytes:
    return varint(len(table)) + b"".join(varint(a) + varint(b) for a, b in table) + b"".join(map(varint, body))


def _unpack(data: bytes) -> tuple[list[tuple[int, int]], list[int]]:
    n, at = read_varint(data, 0)
    table, body = [], []
    for _ in range(min(n, len(data))):
        a, at = read_varint(data, at)
        b, at = read_varint(data, at)
        table.append((a, b))
    while at < len(data):
        s, at = read_varint(data, at)
        body.append(s)
    return table, body


def grammar(data: bytes) -> bytes:
    return _pack(*pair_grammar(data))


def ungrammar(data: bytes) -> bytes:
    return _expand(*_unpack(data))


def grammar_repeats(data: bytes) -> bytes:
    return _pack(*pair_grammar(data, whole_repeats=True))


def grammar_mtf(data: bytes) -> bytes:
    """The body as move-to-front ranks."""
    table, body = pair_grammar(data)
    ids = _Ids(256 + len(table), "front")
    return _pack(table, [ids.rank(s) for s in body])


def ungrammar_mtf(data: bytes) -> bytes:
    table, ranks = _unpack(data)
    ids = _Ids(256 + len(table), "front")
    return _expand(table, [w for w in (ids.word(r) for r in ranks) if w >= 0])


def _by_first_use(table: list[tuple[int, int]], body: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules in the order in which a reader meets them, parts before wholes."""
    order: dict[int, int] = {}

    def meet(s: int) -> None:
        stack = [(s, False)]
        while stack:
            x, ready = stack.pop()
            if x < 256 or x in order:
                continue
            if ready:
                order[x] = 256 + len(order)
            else:
                a, b = table[x - 256]
                stack += [(x, True), (b, False), (a, False)]

    for s in body:
        meet(s)
    new = lambda s: s if s < 256 else order[s]
    return [(new(table[x - 256][0]), new(table[x - 256][1])) for x in order], [new(s) for s in body]


def grammar_ranked(data: bytes) -> bytes:
    return _pack(*_by_first_use(*pair_grammar(data)))


def grammar_inline(data: bytes) -> bytes:
    """No rule table: a rule is written out where it first occurs (symbol 1 before its two parts)."""
    table, body = _by_first_use(*pair_grammar(data))
    known, out = set(), []

    def put(s: int) -> None:
        stack = [s]
        while stack:
            x = stack.pop()
            if x < 0:
                known.add(-x)
            elif x < 256 or x in known:
                out.append(x + 1 if x < 256 else x + 1)
            else:
                out.append(0)
                a, b = table[x - 256]
                stack += [-x, b, a]

    for s in body:
        put(s)
    return b"".join(map(varint, out))


def ungrammar_inline(data: bytes) -> bytes:
    out, at, made = [], 0, []
    open_: list[list[bytes]] = []
    while at < len(data):
        s, at = read_varint(data, at)
        if s == 0:
            open_.append([])
            continue
        value = bytes([s - 1]) if s <= 256 else made[s - 257] if s - 257 < len(made) else b""
        while open_:
            open_[-1].append(value)
            if len(open_[-1]) < 2:
                value = None
                break
            value = b"".join(open_.pop())
            made.append(value)
        if value is not None:
            out.append(value)
    out += [x for level in open_ for x in level]
    return b"".join(out)


def grammar_once(data: bytes, top: int = 256, least: int = 8) -> bytes:
    """One pass: the most frequent pairs of the input, replaced from left to right."""
    count = Counter(zip(data, data[1:], strict=False))
    table = sorted((p for p in count if count[p] >= least), key=lambda p: (-count[p], p))[:top]
    index, body, i = {p: 256 + k for k, p in enumerate(table)}, [], 0
    while i < len(data):
        k = index.get((data[i], data[i + 1])) if i + 1 < len(data) else None
        body.append(data[i] if k is None else k)
        i += 1 if k is None else 2
    return _pack(table, body)


def factor(data: bytes, window: int = 256, longest: int = 64, least: int = 3) -> bytes:
    """LZ begin-end: a factor is a byte or a run of up to `longest` earlier factors that begins among the
    last `window`; the longest in bytes, of equals the first. The number of factors, then for each 0 and
    the byte, or 1, the first factor of the run and how many."""
    begins, out, starts, p = [0], [], {}, 0  # begins: where each factor begins, and the place now
    while p < len(data):
        n, best, first, run = len(begins) - 1, least - 1, 0, 0
        near = starts.get(data[p : p + least], [])
        for s in near[bisect_left(near, n - window) :]:
            m, at = s, p
            while m < n and m - s < longest and data.startswith(data[begins[m] : begins[m + 1]], at):
                at += begins[m + 1] - begins[m]
                m += 1
            if at - p > best:
                best, first, run = at - p, s, m - s
        out.append(b"\1" + varint(first) + varint(run) if run else bytes([0, data[p]]))
        starts.setdefault(data[p : p + least], []).append(n)
        p += best if run else 1
        begins.append(p)
    return varint(len(out)) + b"".join(out)


def unfactor(data: bytes) -> bytes:
    n, at = read_varint(data, 0)
    factors: list[bytes] = []
    while at < len(data) and len(factors) < n:
        tag, at = data[at], at + 1
        if tag:
            first, at = read_varint(data, at)
            run, at = read_varint(data, at)
            if first + run > len(factors):
                break
            factors.append(b"".join(factors[first : first + run]))
        elif at < len(data):
            factors.append(data[at : at + 1])
            at += 1
    return b"".join(factors)


#: name -> (encode, decode)
TRANSFORMS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "hoist": (hoist, unhoist),
    "permute": (permute, unpermute),
    "permute_random": (permute_random, unpermute),
    "case": (case_fold, case_unfold),
    "case_mark": (case_mark, case_unmark),
    "token": (tokenize, untokenize),
    "token_reverse": (lambda d: tokenize(d, reverse=True), untokenize),
    "token_front": (lambda d: tokenize(d, how="front"), lambda d: untokenize(d, how="front")),
    "token_second": (lambda d: tokenize(d, how="second"), lambda d: untokenize(d, how="second")),
    "token_first_use": (tokenize_first_use, untokenize_first_use),
    "token_wide": (tokenize_wide, untokenize),
    "token_phrase": (tokenize_phrases, untokenize),
    "token_phrase_reverse": (lambda d: tokenize_phrases(d, True), untokenize),
    "token_front_coded": (tokenize_front, untokenize_front),
    "token_affix": (tokenize_affix, untokenize_affix),
    "token_subword": (tokenize_subword, untokenize_subword),
    "stem": (stem, unstem),
    "grammar": (grammar, ungrammar),
    "grammar_mtf": (grammar_mtf, ungrammar_mtf),
    "grammar_repeats": (grammar_repeats, ungrammar),
    "grammar_ranked": (grammar_ranked, ungrammar),
    "grammar_inline": (grammar_inline, ungrammar_inline),
    "grammar_once": (grammar_once, ungrammar),
    "factor": (factor, unfactor),
}

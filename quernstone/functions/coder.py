"""The sequential coder: context experts, matches, logistic mixing, calibration, a range coder.

A stream can only be coded bit by bit, but streams are independent: a batch of them advances in
step, one array operation per step over all of them, each with tables of its own. The code of a
stream depends on nothing but its bytes and the configuration. Whole numbers throughout, but for the
masses of the PPM expert (one order of operations), so that encoder and decoder agree."""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

import numpy as np

from quernstone.operators.experiments import ACCEPTED_RATES, APM_RATES, MIXER_RATES
from quernstone.operators.seqstats import SQUASH
from quernstone.operators.text import FUNCTION_WORDS


def squash(d: int) -> int:
    if d > 2047:
        return 4095
    if d < -2047:
        return 0
    w, i = d & 127, (d >> 7) + 16
    return (SQUASH[i] * (128 - w) + SQUASH[min(i + 1, 32)] * w + 64) >> 7


def _stretch_table() -> list[int]:
    table, at = [2047] * 4096, 0
    for d in range(-2047, 2048):
        p = squash(d)
        for j in range(at, p + 1):
            table[j] = d
        at = max(at, p + 1)
    return table


STRETCH = _stretch_table()
_ST = np.array(STRETCH, np.int32)
_SQ = np.array([squash(d) for d in range(-2047, 2048)], np.int32)
_BITS = -np.log2(np.maximum(np.arange(4097), 0.5) / 4096)
_C = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_U = np.uint64
_CELLS, COLD_WEIGHT = np.array([squash((j - 16) * 128) * 16 for j in range(33)], np.uint16), 65536 // 3
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass(frozen=True)
class Config:
    """What predicts: experts, match tiers, calibration; and their rates."""

    orders: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6, 8, 12, 16)
    word: bool = True
    pair: bool = True
    column: str = ""  # real, shuffled, noline
    literal: str = ""  # real, const
    word_class: str = ""  # class, flag
    stem: str = ""  # stem, raw
    sparse: tuple[tuple[int, int], ...] = ()  # order and gap
    indirect: tuple[tuple[int, int, str], ...] = ()  # order, history, and plain, chained or relabelled
    states: tuple[int, ...] = ()  # orders of history experts
    matches: tuple[tuple[int, int], ...] = ((6, 0),)  # least length and gap
    by_distance: bool = False
    ring: int = 0
    ppm: int = 0
    collision: str = ""  # real, const
    inherit: str = ""  # parent, unrelated
    third: str = ""  # order2, distant, indirect, const
    corrector: tuple = ()  # w1, b1, w2, b2
    mixer_rate: int = 12
    scale: int = 0
    apm_rates: tuple[int, int, int] = (7, 7, 7)
    shift: int = 0  # of all adaptation rates
    off: str = ""  # an expert left out
    moved: tuple[tuple[str, int], ...] = ()  # shifts of the adaptation rates of single experts

    def tuned(self, tune: int, apm: bool = False) -> Config:
        """Learning rate from the low half of a tune, table scale (at most 3) from the high one; with
        `apm` the high half sets the calibration rates."""
        return replace(self, mixer_rate=MIXER_RATES[tune & 15], scale=min(tune >> 4, 3), apm_rates=APM_RATES[tune >> 4] if apm else self.apm_rates)

    def experts(self) -> list[tuple[str, int]]:
        """Names and adaptation rates of the experts with a table of probabilities."""
        rate = dict(zip((0, 1, 2, 3, 4, 5, 6, 8, 12, 16), ACCEPTED_RATES, strict=False))
        out = [(f"o{k}", rate.get(k, 4)) for k in self.orders]
        out += [(n, r) for n, r, on in (("word", 3, self.word), ("pair", 3, self.pair), ("column", 4, self.column), ("literal", 5, self.literal), ("class", 4, self.word_class), ("stem", 3, self.stem)) if on]
        out += [(f"sparse{k}/{g}", 3) for k, g in self.sparse] + [(f"indirect{k}/{h}", 3) for k, h, _ in self.indirect]
        moved = dict(self.moved)
        return [(n, min(12, max(1, r + self.shift + moved.get(n, 0)))) for n, r in out if n != self.off]


_P4 = Config(column="real", literal="real", matches=((6, 0), (8, 0), (4, 1)))
_P6 = replace(_P4, third="order2")


def for_method(i: int) -> Config:
    """The configuration of a method of the registry by its id."""
    hot = Config(column="real")  # with reversed tokens
    changes = {
        1: replace(Config(), word=False, pair=False), 5: Config(inherit="parent"), 6: Config(inherit="unrelated"), 7: Config(inherit="parent"), 9: Config(column="shuffled"), 10: Config(column="noline"),
        **{21 + k: replace(hot, matches=((6, 0), (m, 0))) for k, m in enumerate((6, 8, 12, 16, 24))}, **{26 + k: replace(hot, matches=((6, 0), t)) for k, t in enumerate(((4, 1), (6, 1), (6, 2)))},
        **{28 + k: replace(hot, ring=k) for k in range(1, 5)}, 33: replace(hot, literal="real"), 34: replace(hot, literal="const"), 36: replace(hot, by_distance=True), 38: replace(hot, word_class="class"), 39: replace(hot, word_class="flag"),
        51: replace(_P4, states=(2, 4, 6)), 52: replace(_P4, orders=(*_P4.orders, 2, 4, 6)), 53: replace(_P4, orders=(0, 1, 3, 5, 8, 12, 16), states=(2, 4, 6)), 54: _P6, 55: replace(_P4, third="distant"),
        56: replace(_P4, sparse=((4, 1),)), 57: replace(_P4, orders=(*_P4.orders, 4)), 58: replace(_P4, orders=(0, 1, 2, 3, 5, 6, 8, 12, 16), sparse=((4, 1),)), 59: replace(_P4, indirect=((2, 2, "plain"),)), 60: replace(_P4, indirect=((2, 2, "relabelled"),)),
        61: replace(_P4, indirect=((2, 2, "chained"),)), 62: replace(_P4, indirect=((5, 2, "plain"),)), 63: replace(_P6, collision="real"), 64: replace(_P6, collision="const"), 65: replace(_P6, ppm=4), 66: replace(_P6, ppm=1),
        67: replace(_P6, stem="stem"), 68: replace(_P6, stem="raw"), 69: replace(_P4, third="indirect"), 70: replace(_P4, third="const"), 71: _P6, 72: replace(_P6, ppm=4, orders=(0, 1, 2, 3, 5, 6)),
    }
    if i in changes:
        return changes[i]
    if i == 35 or i >= 88:
        return _P4
    if i >= 71:
        return _P6
    return hot if i in (8, 13, 14, 17, 18, 20, 40, 41, 42, 43) else Config()


def table_bits(n: int, scale: int) -> int:
    """Bits of a stream's tables by its length, so that they don't depend on the batch."""
    return min(22, max(6, n.bit_length()) + scale)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h + _U(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * _C
    return (h ^ (h >> _U(29))) * _C2


_FOLDS: tuple[np.ndarray, np.ndarray] | None = None


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    global _FOLDS
    if _FOLDS is None:
        pairs = []
        for k, words in FUNCTION_WORDS.items():
            for w in words:
                h = 0
                for b in w.encode():
                    h = (h * int(_C) & 0xFFFFFFFFFFFFFFFF) ^ (b | 256)
                pairs.append((h, k))
        pairs.sort()
        _FOLDS = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64)
    return _FOLDS


_STRIP = [(b"ingly", 5, 5), (b"ies", 4, 3), (b"ing", 4, 3), (b"ely", 4, 3), (b"ly", 4, 2), (b"ed", 3, 2), (b"es", 3, 2), (b"s", 2, 1)]  # ending, length above, letters off


class Predictors:
    """The state of a batch of streams of one table size, longest first."""

    def __init__(self, lengths: list[int], c: Config):
        d = len(lengths)
        self.c, self.d, self.n = c, d, np.array(lengths, np.int64)
        self.bits = table_bits(max(lengths, default=0), c.scale)
        roster = self._roster()
        e, size = len(roster), 1 << self.bits
        self.e, self.hashes, self.rates = e, [x[:2] for x in roster], np.array([x[2] for x in roster], np.int32)
        self.marks = bool(c.collision or c.inherit)  # whether it matters that an entry is cold (0), not just even
        self.t = np.zeros(d * e * size, np.uint16) if self.marks else np.full(d * e * size, 32768, np.uint16)
        self.base = (np.arange(d * e, dtype=np.int64) * size).reshape(d, e)
        self.check = np.zeros(d * e * size, np.uint8) if c.collision else None
        s = len(c.states)
        self.s, self.sbase = np.zeros(d * s * size, np.uint8), (np.arange(d * s, dtype=np.int64) * size).reshape(d, s)
        n0, n1 = np.arange(256) >> 5, np.arange(256) >> 2 & 7
        self.map = np.tile((65536 * (n1 + 1) // (n0 + n1 + 2)).astype(np.uint16), (d, s, 1))
        m = len(c.matches)
        self.ptr, self.len = np.zeros((d, m), np.int64), np.zeros((d, m), np.int64)
        self.seen = np.zeros((d, m, size), np.int32)
        self.sure = np.tile(np.minimum(65535, 40000 + 400 * np.arange(64)).astype(np.int32), (d, m, 1))
        self.ring, self.hits = np.zeros((d, c.ring), np.int64), np.zeros((d, c.ring), np.int64)
        self.rsure = np.tile(np.minimum(65535, 33000 + 2000 * np.arange(16)).astype(np.int32), (d, c.ring, 1))
        self.follow = [np.zeros((d, size), np.uint32) for _ in c.indirect]
        self.fslot = [np.zeros(d, np.int64) for _ in c.indirect]
        self.counts = np.zeros((d, c.ppm, 2, size), np.float32) if c.ppm else None
        self.total = np.zeros((d, c.ppm, 2, size), np.float32) if c.ppm else None  # uses and distinct symbols
        self.inputs = e + s + m + c.ring + (c.ppm > 0)
        self._mixers()
        self.key3, self.follow3 = np.zeros(d, np.uint64), np.zeros((d, 256), np.uint32)
        self.buf = np.zeros((d, int(self.n.max(initial=0)) + 40), np.uint8)  # 32 zeros before the start
        self.c8, self.c16 = np.zeros(d, np.uint64), np.zeros(d, np.uint64)
        self.word, self.before, self.stem, self.kind = (np.zeros(d, np.uint64) for _ in range(4))
        self.letters, self.tail, self.prefix = np.zeros(d, np.int64), np.zeros(d, np.uint64), np.zeros((d, 6), np.uint64)
        self.line, self.above = np.full(d, 32, np.int64), np.full(d, 32, np.int64)
        self.pos, self.rows = 32, np.arange(d)
        self.active(d)
        self._contexts()

    def _roster(self) -> list[tuple[str, int, int]]:
        """Name, salt of its hash and rate of every expert."""
        return [(n, k + 1, r) for k, (n, r) in enumerate(self.c.experts())]

    def _mixers(self) -> None:
        d = self.d
        self.w = np.full((d, 4096, self.inputs), COLD_WEIGHT, np.int32)
        self.a1, self.a2 = np.tile(_CELLS, (d, 1024, 1)), np.tile(_CELLS, (d, 256, 1))
        self.a3 = np.tile(_CELLS, (d, 4096, 1)) if self.c.third else None

    def active(self, a: int) -> None:
        """Go on with the first a streams."""
        self.a, self.r = a, self.rows[:a]

    # a byte ------------------------------------------------------------------------------------

    def _contexts(self) -> None:
        a, plain, done = self.a, {}, {}
        c8, c16 = self.c8[:a], self.c16[:a]
        expect = np.where(self.len[:a, 0] > 0, self.buf[self.r, self.ptr[:a, 0]], 0).astype(np.uint64) + _U(1) * (self.len[:a, 0] > 0).astype(np.uint64) * _U(256) if self.c.matches else np.zeros(a, np.uint64)
        for name in dict.fromkeys(n for n, _ in self.hashes):
            if name[0] == "o":
                o = int(name[1:])
                h = c8 & _MASKS[o] if o <= 8 else c8 + (c16 & _MASKS[o - 8]) * _C2
            elif name == "word":
                h = self.word[:a] * _C + _U(1)
            elif name == "pair":
                h = self.word[:a] * _C + self.before[:a]
            elif name == "column":
                col = self.pos - self.line[:a]
                at = self.above[:a] + col + (7 if self.c.column == "shuffled" else 0)
                up = np.where(at < self.line[:a] - 1, self.buf[self.r, np.minimum(at, self.pos - 1)], 0).astype(np.uint64)
                up = np.zeros(a, np.uint64) if self.c.column == "noline" else up
                h = up << _U(8) | np.minimum(col, 255).astype(np.uint64)
            elif name == "literal":
                h = (expect if self.c.literal == "real" else np.zeros(a, np.uint64)) << _U(8) | c8 & _MASKS[1]
            elif name == "class":
                inside = (self.word[:a] != 0).astype(np.uint64)
                h = inside if self.c.word_class == "flag" else self.kind[:a] << _U(9) | inside << _U(8) | c8 & _MASKS[1]
            elif name == "stem":
                h = (self.stem[:a] if self.c.stem == "stem" else self.before[:a]) * _C2 + self.word[:a]
            elif name[:3] == "spa":
                o, g = map(int, name[6:].split("/"))
                h = c8 >> _U(8 * g) & _MASKS[o]
            else:
                j = [f"indirect{o}/{h}" for o, h, _ in self.c.indirect].index(name)
                h = self.follow[j][self.r, self.fslot[j][:a]].astype(np.uint64) << _U(8)
                h = h if self.c.indirect[j][2] != "chained" else h | c8 & _MASKS[1]
                h = h if self.c.indirect[j][2] != "relabelled" else h * _C + self.fslot[j][:a].astype(np.uint64)
            plain[name] = h
        for name, salt in self.hashes:
            if (name, salt) not in done:
                done[name, salt] = _mix(plain[name], salt)
        self.h = np.stack([done[x] for x in self.hashes], 1) if done else np.zeros((a, 0), np.uint64)
        self.sh = np.stack([_mix(c8 & _MASKS[o], 100 + o) for o in self.c.states], 1) if self.c.states else None
        if self.c.ppm:
            self.ph = np.stack([_mix(c8 & _MASKS[o], 200 + o) for o in range(1, self.c.ppm + 1)], 1)
            self.pslot = (self.ph >> _U(64 - self.bits)).astype(np.int64)
        self.node = np.ones(a, np.int64)
        self.shown = self.buf[self.r[:, None], self.ptr[:a]].astype(np.int64) | 256 if self.c.matches else None
        if self.c.ring:
            there = (self.ring[:a] > 0) & (self.ring[:a] <= self.pos - 32)
            self.rshown = np.where(there, self.buf[self.r[:, None], np.maximum(self.pos - self.ring[:a], 0)].astype(np.int64) | 256, 0)
        length = self.len[:a, 0] if self.c.matches else np.zeros(a, np.int64)
        if self.c.by_distance:
            far = self.pos - self.ptr[:a, 0]
            length = np.where(length > 0, np.maximum(1, length - np.maximum(0, np.floor(np.log2(np.maximum(far, 1))).astype(np.int64) - 9)), 0)
        self.mstate = (length > 0).astype(np.int64) + (length >= 12) + (length >= 24)
        self.set = self.mstate << 8 | (self.word[:a] != 0).astype(np.int64) << 10 | (self.ring[:a] > 0).any(1).astype(np.int64) << 11
        self.slot, self.bit = None, 0

    def _byte(self) -> None:
        """All that a finished byte changes."""
        a, c = self.a, self.c
        b = (self.node & 255).astype(np.uint8)
        wide, i = b.astype(np.uint64), self.pos
        self.buf[:a, i] = b
        for j in range(len(c.indirect)):
            f = self.follow[j]
            f[self.r, self.fslot[j][:a]] = (f[self.r, self.fslot[j][:a]] << np.uint32(8) | b) & np.uint32((1 << 8 * c.indirect[j][1]) - 1)
        if c.third in ("indirect", "const"):
            last = (self.c8[:a] & _MASKS[1]).astype(np.int64)
            self.follow3[self.r, last] = (self.follow3[self.r, last] << np.uint32(8) | b) & np.uint32(65535)
        if c.ppm:
            fresh = self.counts[self.r[:, None], np.arange(c.ppm), (b & 1).astype(np.int64)[:, None], self._pnode(self.node >> 1)] == 0
            self.total[self.r[:, None], np.arange(c.ppm), 0, self.pslot] += 1
            self.total[self.r[:, None], np.arange(c.ppm), 1, self.pslot] += fresh
            for k in range(8):
                self.counts[self.r[:, None], np.arange(c.ppm), (b >> (7 - k) & 1).astype(np.int64)[:, None], self._pnode(self.node >> (8 - k))] += 1
        self.c16[:a] = self.c16[:a] << _U(8) | self.c8[:a] >> _U(56)
        self.c8[:a] = self.c8[:a] << _U(8) | wide
        low = wide | _U(32)
        letter = (low >= 97) & (low <= 122)
        ended = ~letter & (self.word[:a] != 0)
        if ended.any():
            self._word_end(np.flatnonzero(ended))
        self.word[:a] = np.where(letter, self.word[:a] * _C ^ (low | _U(256)), _U(0))
        if c.stem:
            self.letters[:a] = np.where(letter, self.letters[:a] + 1, 0)
            self.tail[:a] = np.where(letter, self.tail[:a] << _U(8) | low, _U(0))
            self.prefix[:a, 1:] = np.where(letter[:, None], self.prefix[:a, :-1], _U(0))
            self.prefix[:a, 0] = self.word[:a]
        new = b == 10
        self.above[:a] = np.where(new, self.line[:a], self.above[:a])
        self.line[:a] = np.where(new, i + 1, self.line[:a])
        self.pos = i + 1
        fresh_at = self._matches(b)
        if c.ring:
            right = self.rshown == (b.astype(np.int64)[:, None] | 256)
            self.hits[:a] = np.where(right, np.minimum(self.hits[:a] + 1, 15), 0)
            for row in fresh_at:  # few rows at a time begin a match
                dist = self.pos - self.ptr[row, 0]
                old = [x for x in self.ring[row] if x != dist and x > 0]
                keep = [self.hits[row][list(self.ring[row]).index(x)] for x in old]
                self.ring[row] = (dist, *old, *[0] * c.ring)[: c.ring]
                self.hits[row] = (0, *keep, *[0] * c.ring)[: c.ring]
        for j, (o, _, _) in enumerate(c.indirect):
            self.fslot[j][:a] = (_mix(self.c8[:a] & _MASKS[o], 300 + j) >> _U(64 - self.bits)).astype(np.int64)
        if c.third:
            last = self.c8[:a] & _MASKS[1]
            if c.third == "order2":
                self.key3[:a] = self.c8[:a] & _MASKS[2]
            elif c.third == "distant":
                self.key3[:a] = last << _U(8) | self.buf[:a, max(0, self.pos - 252)]
            elif c.third == "indirect":
                self.key3[:a] = self.follow3[self.r, last.astype(np.int64)]
        self._contexts()

    def _word_end(self, rows: np.ndarray) -> None:
        self.before[rows] = self.word[rows]
        if self.c.word_class == "class":
            known, kinds = _function_words()
            at = np.minimum(np.searchsorted(known, self.word[rows]), len(known) - 1)
            self.kind[rows] = np.where(known[at] == self.word[rows], kinds[at], _U(0))
        if self.c.stem:
            off, done = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            tail, n = self.tail[rows], self.letters[rows]
            for end, least, cut in _STRIP:
                hit = ~done & (n > least) & (tail & _MASKS[len(end)] == _U(int.from_bytes(end, "big")))
                if end == b"s":
                    hit &= tail & _MASKS[2] != _U(int.from_bytes(b"ss", "big"))
                off, done = np.where(hit, cut, off), done | hit
            self.stem[rows] = self.prefix[rows, off]

    def _matches(self, b: np.ndarray) -> np.ndarray:
        """Extend or find the matches of every tier; the rows whose first tier found a new one."""
        a, c, begun = self.a, self.c, np.zeros(0, np.int64)
        for j, (least, gap) in enumerate(c.matches):
            ptr, length = self.ptr[:a, j], self.len[:a, j]
            good = (length > 0) & (self.buf[self.r, ptr] == b)
            length = np.where(good, np.minimum(length + 1, 63), 0)
            ptr = np.where(good, ptr + 1, 0)
            if least + gap <= 8:
                h = self.c8[:a] >> _U(8 * gap) & _MASKS[least]
            else:
                h = self.c8[:a] + (self.c16[:a] & _MASKS[min(least, 16) - 8]) * _C2
            slot = (_mix(h, 400 + j) >> _U(64 - self.bits)).astype(np.int64)
            at = self.seen[self.r, j, slot].astype(np.int64)
            find = np.flatnonzero(~good & (at > 0))
            if len(find) and self.pos - 32 >= least + gap:
                back = np.arange(gap, gap + least)
                same = (self.buf[find[:, None], np.maximum(at[find][:, None] - 1 - back, 0)] == self.buf[find[:, None], self.pos - 1 - back]).all(1)
                hit = find[same]
                length[hit], ptr[hit] = least, at[hit]
                begun = hit if j == 0 else begun
            self.ptr[:a, j], self.len[:a, j] = ptr, length
            if self.pos - 32 >= least + gap:
                self.seen[self.r, j, slot] = self.pos
        return begun

    # a bit -------------------------------------------------------------------------------------

    def _pnode(self, node: np.ndarray) -> np.ndarray:
        return ((self.ph + node.astype(np.uint64)[:, None] * _C) * _C2 >> _U(64 - self.bits)).astype(np.int64)

    def _inputs(self) -> np.ndarray:
        """Of each active stream what every expert says."""
        a, c, e, node = self.a, self.c, self.e, self.node
        x = np.zeros((a, self.inputs), np.int32)
        mixed = (self.h + node.astype(np.uint64)[:, None] * _C) * _C2
        self.slot = (mixed >> _U(64 - self.bits)).view(np.int64) + self.base[:a]
        t = self.t.take(self.slot, mode="clip")
        if c.collision:
            sign = (mixed >> _U(8) & _U(255)).astype(np.uint8) if c.collision == "real" else np.ones(self.slot.shape, np.uint8)
            t = np.where(self.check[self.slot] == sign, t, 0)
            self.check[self.slot] = sign
        cold = t == 0 if self.marks else None
        t = np.where(cold, 32768, t).astype(np.int32) if self.marks else t.astype(np.int32)
        if c.inherit:
            for k in range(1, e):  # an expert that knows nothing starts from a simpler one, or from another
                t[:, k] = np.where(cold[:, k], t[:, k - 1 if c.inherit == "parent" else (k * 5 + 3) % e if (k * 5 + 3) % e < k else 0], t[:, k])
        self.was = t
        x[:, :e] = _ST[t >> 4]
        k = e
        if c.states:
            self.sslot = ((self.sh + node.astype(np.uint64)[:, None] * _C) * _C2 >> _U(64 - self.bits)).astype(np.int64) + self.sbase[:a]
            self.state = self.s[self.sslot]
            self.smap = (self.r[:, None], np.arange(len(c.states)), self.state.astype(np.int64))
            x[:, k : k + len(c.states)] = _ST[self.map[self.smap] >> 4]
            k += len(c.states)
        left = 8 - self.bit
        if c.matches:
            m = len(c.matches)
            self.alive = (self.len[:a] > 0) & (self.shown >> left == node[:, None])
            self.says = self.shown >> left - 1 & 1
            self.sureness = self.sure[self.r[:, None], np.arange(m), self.len[:a]]
            s = _ST[self.sureness >> 4]
            x[:, k : k + m] = np.where(self.alive, np.where(self.says == 1, s, -s), 0)
            k += m
        if c.ring:
            self.ralive = self.rshown >> left == node[:, None]
            self.rsays = self.rshown >> left - 1 & 1
            s = _ST[self.rsure[self.r[:, None], np.arange(c.ring), self.hits[:a]] >> 4]
            x[:, k : k + c.ring] = np.where(self.ralive, np.where(self.rsays == 1, s, -s), 0)
            k += c.ring
        if c.ppm:
            x[:, k] = self._ppm()
        return x

    def p(self) -> np.ndarray:
        """Of each active stream the probability of a one, in 1/4096."""
        a, c, node, x = self.a, self.c, self.node, self._inputs()
        self.x, self.cell = x, self.set | node
        self.wrow = self.w[self.r, self.cell]
        dot = (self.wrow.astype(np.int64) * x).sum(1) >> 16
        self.raw = _SQ[np.clip(dot, -2047, 2047) + 2047]
        self.i1, v1 = self._calibrated(self.a1, self.raw, node | self.mstate << 8)
        self.i2, v2 = self._calibrated(self.a2, self.raw, (self.c8[:a] & _MASKS[1]).astype(np.int64))
        out = self.raw + v1 + 2 * v2 + 2 >> 2
        if c.third:
            self.i3, v3 = self._calibrated(self.a3, out, self._third())
            out = 3 * out + v3 + 2 >> 2
        if c.corrector:
            out = _SQ[np.clip(_ST[np.clip(out, 0, 4095)] + self._correction(), -2047, 2047) + 2047]
        return np.clip(out, 1, 4095)

    def _third(self) -> np.ndarray:
        return ((self.key3[: self.a] ^ self.node.astype(np.uint64) * _C2) * _C >> _U(52)).astype(np.int64)

    def features(self) -> np.ndarray:
        """Twelve small numbers about the prediction, for the corrector."""
        f = np.zeros((self.a, 12), np.int32)
        f[:, : min(11, self.inputs)] = np.clip(self.x[:, :11] >> 6, -32, 31)
        f[:, 11] = np.where(self.word[: self.a] != 0, 1, -1)
        return f

    def _correction(self) -> np.ndarray:
        w1, b1, w2, b2 = self.c.corrector
        z = np.clip(self.features() @ np.array(w1, np.int32).T + np.array(b1, np.int32) >> 8, -127, 127)
        return np.clip(z @ np.array(w2, np.int32) + b2 >> 8, -1024, 1024)

    def _calibrated(self, table: np.ndarray, p: np.ndarray, key: np.ndarray) -> tuple:
        d = _ST[np.clip(p, 0, 4095)] + 2048
        lo, part = d >> 7, d & 127
        up = np.minimum(lo + 1, 32)
        value = table[self.r, key, lo].astype(np.int32) * (128 - part) + table[self.r, key, up].astype(np.int32) * part >> 11
        return (self.r, key, np.where(part >= 64, up, lo)), value

    def _ppm(self) -> np.ndarray:
        """Masses of both bits: symbols of the longest context first, what it leaves for new symbols
        shared out by the shorter ones."""
        a, at = self.a, self._pnode(self.node)
        orders = np.arange(self.c.ppm)
        n = self.counts[self.r[:, None], orders, :, at]
        total, kinds = self.total[self.r[:, None], orders, 0, self.pslot], self.total[self.r[:, None], orders, 1, self.pslot]
        mass, rest = np.zeros((a, 2), np.float64), np.ones(a, np.float64)
        for o in range(self.c.ppm - 1, -1, -1):
            known = total[:, o] > 0
            new = np.maximum(kinds[:, o], 1)  # a slot may be shared: at least one symbol was seen
            all_ = (total[:, o] + new).astype(np.float64)
            share = np.where(known, rest / np.where(known, all_, 1.0), 0.0)
            mass += share[:, None] * n[:, o]
            rest = np.where(known, share * new, rest)
        mass += (rest * 0.5 ** (self.bit + 1))[:, None]
        p = mass[:, 1] / (mass[:, 0] + mass[:, 1])
        return _ST[np.clip((p * 4096).astype(np.int64), 1, 4095)]

    def _mixed(self, b: np.ndarray) -> None:
        """What the mixers and the calibration learn."""
        c, target = self.c, 65535 * b
        error = ((b << 12) - self.raw) * c.mixer_rate
        self.w[self.r, self.cell] = self.wrow + (self.x * error[:, None] + 0x2000 >> 14)
        rates = c.apm_rates
        for table, i, rate in ((self.a1, self.i1, rates[0]), (self.a2, self.i2, rates[1]), *(((self.a3, self.i3, rates[2]),) if c.third else ())):
            v = table[i].astype(np.int32)
            table[i] = v + (target - v >> rate)

    def update(self, bit: np.ndarray) -> None:
        a, c = self.a, self.c
        b = bit.astype(np.int32)
        target = 65535 * b
        self._mixed(b)
        self.t[self.slot] = np.maximum(self.was + (target[:, None] - self.was >> self.rates), 1)  # never above 65535
        if c.states:
            v = self.map[self.smap].astype(np.int32)
            self.map[self.smap] = np.clip(v + (target[:, None] - v >> 6), 1, 65535).astype(np.uint16)
            n0, n1, one = self.state >> 5, self.state >> 2 & 7, bit[:, None] == 1
            up = lambda n: np.minimum(n + 1, 7)
            down = lambda n: np.where(n > 2, (n + 1) >> 1, n)
            m0, m1 = np.where(one, down(n0), up(n0)), np.where(one, up(n1), down(n1))
            self.s[self.sslot] = (m0 << 5 | m1 << 2 | bit[:, None]).astype(np.uint8)
        if c.matches:
            m = np.arange(len(c.matches))
            right = self.says == bit[:, None]
            v = self.sureness
            self.sure[self.r[:, None], m, self.len[:a]] = np.where(self.alive, np.clip(v + (np.where(right, 65535, 0) - v >> 6), 1, 65535), v)
        if c.ring:
            i = (self.r[:, None], np.arange(c.ring), self.hits[:a])
            v = self.rsure[i]
            self.rsure[i] = np.where(self.ralive, np.clip(v + (np.where(self.rsays == bit[:, None], 65535, 0) - v >> 6), 1, 65535), v)
        self.node = self.node << 1 | bit
        self.bit += 1
        if self.bit == 8:
            self._byte()


_LO, _PART = (_ST + 2048 >> 7).astype(np.int64), (_ST + 2048 & 127).astype(np.int32)
_NEAR = _LO + (_PART >= 64)


#: Memory that batches use in turn: to ask the system for it each time costs more than what is done with it.
_kept_memory: dict[str, np.ndarray] = {}


def _memory(name: str, n: int, dtype) -> np.ndarray:
    now = _kept_memory.get(name)
    if now is None or now.size < n or now.dtype != dtype:
        _kept_memory[name] = now = np.empty(n, dtype)
    return now[:n]


class _Rows:
    """The rows of tables by stream and key, in the order of their first use: others take no memory."""

    def __init__(self, name: str, steps: np.ndarray, keys: int, first: np.ndarray):
        self.id, self.base, self.first, self.used = np.zeros(len(steps) * keys, np.int64), np.arange(len(steps)) * keys, first, 0
        self.flat = _memory(name, int(np.minimum(steps, keys).sum()) * first.size, first.dtype)
        self.data = self.flat.reshape(-1, first.size)

    def at(self, a: int, key: np.ndarray) -> np.ndarray:
        place = self.base[:a] + key
        i = self.id.take(place, mode="clip") - 1
        new = (i < 0).nonzero()[0]
        if len(new):
            upto = self.used + len(new)
            i[new] = range_ = np.arange(self.used, upto)
            self.id[place[new]] = range_ + 1
            self.data[self.used : upto] = self.first
            self.used = upto
        return i


class Shared(Predictors):
    """The state of a batch of streams under configurations that differ only in their experts, in the rates of these and
    in the mixers' rate. What an expert says depends on no other one and on no mixer, so each is kept
    once, however many configurations have it; mixers and calibration are kept for each configuration.
    Arrays are by stream, input and configuration."""

    def __init__(self, lengths: list[int], configs: list[Config]):
        self.configs = configs
        super().__init__(lengths, configs[0])

    def _roster(self) -> list[tuple[str, int, int]]:
        known: dict[tuple[str, int, int], int] = {}
        self.own = [[known.setdefault((n, k + 1, r), len(known)) for k, (n, r) in enumerate(c.experts())] for c in self.configs]
        return list(known)

    def _mixers(self) -> None:
        k, m, width = len(self.own), len(self.c.matches), max(map(len, self.own))
        self.inputs = self.e + m + 1  # the last one says nothing: it stands for experts left out
        pick = np.full((width + m, k), self.e + m)
        for j, own in enumerate(self.own):
            pick[: len(own), j], pick[width:, j] = own, range(self.e, self.e + m)
        self.same = bool((pick == pick[:, :1]).all())
        self.shape, self.pick = pick.shape, pick[:, 0] if self.same else pick.reshape(-1)
        self.speeds = np.array([c.mixer_rate for c in self.configs], np.int32)
        steps, cells = 8 * self.n, np.repeat(_CELLS, k)  # configurations mostly use the same or near cells: side by side
        self.w = _Rows("w", steps, 4096, np.full(pick.size, COLD_WEIGHT, np.int32))
        self.tables = [_Rows(f"a{n}", steps, n, cells) for n in (1024, 256, *([4096] if self.c.third else []))]
        self.offset, self.lo, self.nearer = np.arange(k), _LO * k, _NEAR * k

    def p(self) -> np.ndarray:
        """Of each active stream and configuration the probability of a one, in 1/4096."""
        a, node, (i, k) = self.a, self.node, self.shape
        x = self._inputs()[:, self.pick]
        self.wat = self.w.at(a, self.set | node)
        self.wrow = self.w.data.take(self.wat, 0, mode="clip").reshape(a, i, k)
        w = self.wrow.astype(np.float64)  # sums of whole numbers below 2^53: exact
        if k == 1:
            dot = np.einsum("ai,ai->a", w.reshape(a, i), x.astype(np.float64)).reshape(a, 1)
        elif self.same:
            dot = (x.astype(np.float64).reshape(a, 1, i) @ w).reshape(a, k)
        else:
            dot = np.einsum("aik,aik->ak", w, x.astype(np.float64).reshape(a, i, k))
        self.x = x.reshape(a, i, -1)
        at = dot.astype(np.int64)
        at >>= 16
        at += 2047
        self.raw = _SQ.take(at, mode="clip")
        self.near = []
        out = self.raw + self._looked_up(0, self.raw, node | self.mstate << 8)
        out += 2 * self._looked_up(1, self.raw, (self.c8[:a] & _MASKS[1]).view(np.int64))
        out += 2
        out >>= 2
        if self.c.third:
            out = 3 * out + self._looked_up(2, out, self._third())
            out += 2
            out >>= 2
        return np.minimum(np.maximum(out, 1), 4095)

    def _looked_up(self, j: int, p: np.ndarray, key: np.ndarray) -> np.ndarray:
        t = self.tables[j]
        row, p = (t.at(self.a, key) * t.first.size)[:, None] + self.offset, p.astype(np.int64)
        part, at = _PART.take(p, mode="clip"), self.lo.take(p, mode="clip")
        at += row
        row += self.nearer.take(p, mode="clip")
        self.near.append(row)
        low = t.flat.take(at, mode="clip").astype(np.int32)
        at += len(self.offset)
        out = t.flat.take(at, mode="clip").astype(np.int32)
        out -= low
        out *= part
        low <<= 7
        out += low
        out >>= 11
        return out

    def _mixed(self, b: np.ndarray) -> None:
        error = (b << 12)[:, None] - self.raw
        error *= self.speeds
        new = self.x * error[:, None, :]
        new += 0x2000
        new >>= 14
        new += self.wrow
        self.w.data[self.wat] = new.reshape(self.a, -1)
        target = (65535 * b)[:, None]
        for t, at, rate in zip(self.tables, self.near, self.c.apm_rates, strict=False):
            v = t.flat.take(at, mode="clip").astype(np.int32)
            t.flat[at] = (v + (target - v >> rate)).astype(np.uint16)


#: Streams that advance together, also where mixers keep only what they use, and the bytes that their tables may take.
BATCH, SHARED_BATCH, BATCH_BYTES = 256, 1_024, 400_000_000


def batches(lengths: list[int], c: Config, configs: list[Config] | None = None) -> list[list[int]]:
    """Indices of streams to be coded together: of one table size, longest first, within memory."""
    out: list[list[int]] = []
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    e = len(c.experts()) + len(c.states) + 2 * len(c.matches) + len(c.indirect) * 2 + 8 * c.ppm
    if configs:
        e = len({(n, i, r) for x in configs for i, (n, r) in enumerate(x.experts())}) + 2 * len(c.matches)
        width = len(configs) * (4 * max(len(x.experts()) for x in configs) + 4 * len(c.matches) + 3 * 66)
    for k in order:
        bits = table_bits(lengths[k], c.scale)
        # of the 5,376 rows of a configuration, a stream uses a quarter as many as it has bits, as measured on receipts
        own = min(2 * lengths[k], 5_376) * width if configs else 500_000
        room = max(1, min(SHARED_BATCH if configs else BATCH, BATCH_BYTES // (2 * e * (1 << bits) + own)))
        if out and len(out[-1]) < room and table_bits(lengths[out[-1][0]], c.scale) == bits:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def _run(lengths: list[int], c: Config, step, begin=lambda m: None, configs: list[Config] | None = None) -> None:
    """step(model, indices, p) gives the bits of the active streams, in batches; p for all of `configs`, if given."""
    for batch in batches(lengths, c, configs):
        batch = [k for k in batch if lengths[k]]
        if not batch:
            continue
        n = np.array([lengths[k] for k in batch])
        m = Shared(n.tolist(), configs) if configs else Predictors(n.tolist(), c)
        begin((m, batch))
        for at in range(int(n[0])):
            live = int(np.searchsorted(-n, -at, "left"))
            if live < m.a:
                m.active(live)
                m._contexts()
            for _ in range(8):
                m.update(step(m, batch, at, m.p()))


def costs(streams: list[bytes], c: Config, watch=None) -> list[np.ndarray]:
    """Of every stream the bits that each of its bytes costs."""
    out = [np.zeros(len(s), np.float64) for s in streams]
    grid: dict = {}

    def begin(now) -> None:
        m, batch = now
        grid["data"] = np.zeros((len(batch), len(streams[batch[0]])), np.uint8)
        for r, k in enumerate(batch):
            grid["data"][r, : len(streams[k])] = np.frombuffer(streams[k], np.uint8)
        grid["bits"] = np.zeros(grid["data"].shape, np.float64)
        grid["batch"] = batch
        starts.append(grid.copy())

    starts: list[dict] = []

    def step(m, batch, at, p) -> np.ndarray:
        bit = (grid["data"][: m.a, at] >> 7 - m.bit & 1).astype(np.int64)
        grid["bits"][: m.a, at] += _BITS[np.where(bit == 1, p, 4096 - p)]
        if watch:
            watch(m, p, bit)
        return bit

    _run([len(s) for s in streams], c, step, begin)
    for g in starts:
        for r, k in enumerate(g["batch"]):
            out[k] = g["bits"][r, : len(streams[k])]
    return out


def _plain(c: Config) -> bool:
    """Whether Shared has what the configuration asks for."""
    return not (c.states or c.indirect or c.ring or c.ppm or c.collision or c.inherit or c.corrector)


def _kept(c: Config) -> Config:
    """What configurations that are priced together have in common."""
    return replace(c, orders=(), word=False, pair=False, mixer_rate=0, shift=0, off="", moved=())


def sweep(streams: list[bytes], configs: list[Config]) -> np.ndarray:
    """Of every stream the bits that it costs by each configuration, as costs() gives them. The configurations
    have the same matches, calibration and table scale; those with more kinds of state are priced one by one."""
    c = configs[0]
    if any(_kept(x) != _kept(c) for x in configs) or not _plain(c):
        return np.array([[float(y.sum()) for y in costs(streams, x)] for x in configs]).T.reshape(len(streams), len(configs))
    out = np.zeros((len(streams), len(configs)), np.float64)
    g: dict = {}

    def begin(now) -> None:
        m, batch = now
        g["data"] = np.zeros((len(batch), len(streams[batch[0]])), np.uint8)
        for r, k in enumerate(batch):
            g["data"][r, : len(streams[k])] = np.frombuffer(streams[k], np.uint8)

    def step(m, batch, at, p) -> np.ndarray:
        bit = (g["data"][: m.a, at] >> 7 - m.bit & 1).astype(np.int64)
        out[batch[: m.a]] += _BITS.take(np.where(bit[:, None] == 1, p, 4096 - p))
        return bit

    _run([len(s) for s in streams], c, step, begin, configs)
    return out


def encode(streams: list[bytes], c: Config) -> list[bytes]:
    """The codes of streams by a binary range coder of 12-bit probabilities."""
    out: list[bytes] = [b"\0\0\0\0"] * len(streams)
    g: dict = {}

    def finish() -> None:
        if g:
            for r, k in enumerate(g["batch"]):
                out[k] = g["out"][r, : g["n"][r]].tobytes() + struct.pack(">I", int(g["lo"][r]) + (1 if g["lo"][r] < g["hi"][r] else 0))

    def begin(now) -> None:
        finish()
        batch = now[1]
        width = len(streams[batch[0]])
        g.update(batch=batch, data=np.zeros((len(batch), width), np.uint8), lo=np.zeros(len(batch), np.uint64), hi=np.full(len(batch), 0xFFFFFFFF, np.uint64), n=np.zeros(len(batch), np.int64), out=np.zeros((len(batch), width * 12 // 8 + 64), np.uint8))
        for r, k in enumerate(batch):
            g["data"][r, : len(streams[k])] = np.frombuffer(streams[k], np.uint8)

    def step(m, batch, at, p) -> np.ndarray:
        a, p = m.a, p.reshape(-1)
        bit = (g["data"][:a, at] >> 7 - m.bit & 1).astype(np.int64)
        lo, hi = _narrow(g["lo"][:a], g["hi"][:a], p, bit == 1)
        same = np.flatnonzero((lo ^ hi) >> _U(24) == 0)
        while len(same):
            n = g["n"][same]
            if n.max() >= g["out"].shape[1]:
                g["out"] = np.pad(g["out"], ((0, 0), (0, g["out"].shape[1])))
            g["out"][same, n] = hi[same] >> _U(24)
            g["n"][same] += 1
            lo[same] = lo[same] << _U(8) & _U(0xFFFFFFFF)
            hi[same] = hi[same] << _U(8) & _U(0xFFFFFFFF) | _U(255)
            same = same[(lo[same] ^ hi[same]) >> _U(24) == 0]
        g["lo"][:a], g["hi"][:a] = lo, hi
        return bit

    _run([len(s) for s in streams], c, step, begin, [c] if _plain(c) else None)
    finish()
    return out


def _narrow(lo: np.ndarray, hi: np.ndarray, p: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, p = hi - lo, p.astype(np.uint64)
    mid = lo + (size >> _U(12)) * p + ((size & _U(4095)) * p >> _U(12))
    return np.where(one, lo, mid + _U(1)), np.where(one, mid, hi)


def decode(codes: list[bytes], lengths: list[int], c: Config) -> list[bytes]:
    out = [b""] * len(codes)
    g: dict = {}

    def finish() -> None:
        if g:
            for r, k in enumerate(g["batch"]):
                out[k] = g["m"].buf[r, 32 : 32 + lengths[k]].tobytes()

    def begin(now) -> None:
        finish()
        m, batch = now
        width = max(len(codes[k]) for k in batch) + 8
        code = np.zeros((len(batch), width), np.uint64)
        for r, k in enumerate(batch):
            code[r, : len(codes[k])] = np.frombuffer(codes[k], np.uint8)
        x = code[:, 0] << _U(24) | code[:, 1] << _U(16) | code[:, 2] << _U(8) | code[:, 3]
        g.update(m=m, batch=batch, code=code, x=x, at=np.full(len(batch), 4, np.int64), lo=np.zeros(len(batch), np.uint64), hi=np.full(len(batch), 0xFFFFFFFF, np.uint64))

    def step(m, batch, at, p) -> np.ndarray:
        a, p = m.a, p.reshape(-1)
        lo, hi, x = g["lo"][:a], g["hi"][:a], g["x"][:a]
        size, q = hi - lo, p.astype(np.uint64)
        one = x <= lo + (size >> _U(12)) * q + ((size & _U(4095)) * q >> _U(12))
        lo, hi = _narrow(lo, hi, p, one)
        same = np.flatnonzero((lo ^ hi) >> _U(24) == 0)
        while len(same):
            lo[same] = lo[same] << _U(8) & _U(0xFFFFFFFF)
            hi[same] = hi[same] << _U(8) & _U(0xFFFFFFFF) | _U(255)
            g["x"][same] = g["x"][same] << _U(8) & _U(0xFFFFFFFF) | g["code"][same, np.minimum(g["at"][same], g["code"].shape[1] - 1)]
            g["at"][same] += 1
            same = same[(lo[same] ^ hi[same]) >> _U(24) == 0]
        g["lo"][:a], g["hi"][:a] = lo, hi
        return one.astype(np.int64)

    _run(lengths, c, step, begin, [c] if _plain(c) else None)
    finish()
    return out

"""Archives of the sequential coder, images, an order-0 coder, the learned corrector, match profiles.

Coding does not distribute within a stream; it distributes over streams. No Spark here."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

import numpy as np

from quernstone.functions import codecs, coder, pages
from quernstone.functions.coder import STRETCH
from quernstone.functions.hashing import splitmix64_int
from quernstone.functions.registry import NAMES, page_order, stages

#: The accepted method and tune.
ACCEPTED_METHOD, ACCEPTED_TUNE = 86, 51

MAGIC, LONGEST = b"QRN2", 2_000_000_000


def word_gains(streams: list[bytes], c: coder.Config) -> list[dict[bytes, float]]:
    """Of every stream the gain in bits of its words as entries of a vocabulary: what the coder spends
    on their letters, less a reference of two bytes for each use and a definition, at the mean price."""
    out = []
    for data, cost in zip(streams, coder.costs(streams, c), strict=True):
        upto = np.concatenate([[0.0], np.cumsum(cost)])
        spent: dict[bytes, float] = {}
        for m in re.finditer(rb"[A-Za-z]+", data):
            spent[m[0]] = spent.get(m[0], 0.0) + upto[m.end()] - upto[m.start()]
        mean = upto[-1] / len(data) if data else 0.0
        n = codecs._words_of(data)
        out.append({w: b - mean * (2 * n[w] + len(w) + 1) for w, b in spent.items()})
    return out


def transformed(streams: list[bytes], method: int, tune: int) -> list[tuple[bool, bytes]]:
    """The streams as the coder gets them after the stages of the method, and whether their pages were
    put in another order (not where that couldn't be undone). Methods with a priced vocabulary code
    the stream once more to learn the prices."""
    how, out = page_order(method), []
    for data in streams:
        moved = pages.reorder(data, how) if how else None
        out.append((moved is not None, data if moved is None else moved))
    for stage in stages(method):
        now = [x for _, x in out]
        if stage in ("token_repriced", "token_paying"):
            gains = word_gains(now, coder.for_method(method).tuned(tune))
            if stage == "token_repriced":
                lists = [[w for w, v in sorted(g.items(), key=lambda x: (-x[1], x[0])) if v > 0 and len(w) > 2][:255] for g in gains]
                now = [codecs.tokenize(x, v) for x, v in zip(now, lists, strict=True)]
            else:
                shipped = [codecs.vocabulary(codecs._words_of(x))[::-1] for x in now]
                now = [codecs.tokenize(x, v, blocked=[w for w in v if g.get(w, 0.0) <= 0]) for x, v, g in zip(now, shipped, gains, strict=True)]
        else:
            now = [codecs.TRANSFORMS[stage][0](x) for x in now]
        out = [(f, x) for (f, _), x in zip(out, now, strict=True)]
    return out


def archives(streams: list[bytes], method: int = ACCEPTED_METHOD, tune: int = ACCEPTED_TUNE) -> list[bytes]:
    """magic, method, tune, whether pages were reordered, length of the coded stream, code."""
    ready = transformed(streams, method, tune)
    codes = coder.encode([x for _, x in ready], coder.for_method(method).tuned(tune))
    return [MAGIC + bytes([method, tune, moved]) + struct.pack("<Q", len(x)) + code for (moved, x), code in zip(ready, codes, strict=True)]


def archive(data: bytes, method: int = ACCEPTED_METHOD, tune: int = ACCEPTED_TUNE) -> bytes:
    return archives([data], method, tune)[0]


def header(data: bytes) -> tuple[str, int, int] | None:
    """Method name, tune and coded length of an archive; None if it isn't one."""
    if len(data) < 15 or data[:4] != MAGIC or data[4] >= len(NAMES):
        return None
    n = struct.unpack("<Q", data[7:15])[0]
    return (NAMES[data[4]], data[5], n) if n <= LONGEST else None


_BACK = {"token_repriced": codecs.untokenize, "token_paying": codecs.untokenize} | {k: u for k, (_, u) in codecs.TRANSFORMS.items()}


def unarchives(archives_: list[bytes]) -> list[bytes | None]:
    """What archives were made of, by the inverse stages of the method that each names; None for what
    is no archive. Archives of one method and tune are decoded together."""
    out: list[bytes | None] = [None] * len(archives_)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(archives_):
        if header(x) is not None:
            groups.setdefault((x[4], x[5]), []).append(k)
    for (method, tune), ks in groups.items():
        plain = coder.decode([archives_[k][15:] for k in ks], [header(archives_[k])[2] for k in ks], coder.for_method(method).tuned(tune))
        for k, x in zip(ks, plain, strict=True):
            for stage in reversed(stages(method)):
                x = _BACK[stage](x)
            out[k] = pages.restore(x) if archives_[k][6] else x
    return out


def unarchive(data: bytes) -> bytes | None:
    return unarchives([data])[0]


def append_image(program: bytes, payload: bytes) -> bytes:
    return program + payload + struct.pack("<Q", len(payload)) + MAGIC + b"IMG"


def extract_image(image: bytes) -> bytes | None:
    """The payload before the last marker."""
    end = image.rfind(MAGIC + b"IMG")
    if end < 8:
        return None
    n = struct.unpack("<Q", image[end - 8 : end])[0]
    return image[end - 8 - n : end - 8] if n <= end - 8 else None


def rans_table(counts: list[int], bits: int = 12) -> tuple[list[int], list[int]]:
    """Frequencies that sum to 2^bits and their running sums."""
    scale, total = 1 << bits, sum(counts)
    if not total:
        k = len(counts)
        freq = [scale * (i + 1) // k - scale * i // k for i in range(k)]
    else:
        freq = [max(1, c * scale // total) if c else 0 for c in counts]
        top = max(range(len(freq)), key=lambda i: (freq[i], i))
        freq[top] += scale - sum(freq)
    cum = [0]
    for f in freq:
        cum.append(cum[-1] + f)
    return freq, cum[:-1]


def rans_encode(data: bytes, freq: list[int], cum: list[int], bits: int = 12) -> bytes:
    x, low, out = 1 << 23, 1 << 23, bytearray()
    for s in reversed(data):
        limit = (low >> bits << 8) * freq[s]
        while x >= limit:
            out.append(x & 255)
            x >>= 8
        x = (x // freq[s] << bits) + x % freq[s] + cum[s]
    return struct.pack("<I", x) + bytes(reversed(out))


def rans_decode(code: bytes, n: int, freq: list[int], cum: list[int], bits: int = 12) -> bytes:
    slots = [s for s, f in enumerate(freq) for _ in range(f)]
    x, at, out, low = struct.unpack("<I", code[:4])[0], 4, bytearray(), 1 << 23
    for _ in range(n):
        slot = x & (1 << bits) - 1
        s = slots[slot]
        out.append(s)
        x = freq[s] * (x >> bits) + slot - cum[s]
        while x < low and at < len(code):
            x = x << 8 | code[at]
            at += 1
    return bytes(out)


def train_corrector(rows: Iterable[tuple[list[int], int, int]], hidden: int = 8, rate: float = 0.02, seed: int = 1) -> tuple[list[list[int]], list[int], list[int], int, float, float]:
    """Integer weights of a one-layer corrector, trained event by event on (features, p, bit): the
    loss is that of the corrected probability. Returns the weights, the mean loss in bits and its moving average (0.00005 new)."""
    from math import exp, log2, tanh

    state, init = seed, []
    for _ in range(hidden * 12):
        state = splitmix64_int(state)
        init.append((state % 2001 - 1000) / 10_000)
    w1 = [init[j * 12 : j * 12 + 12] for j in range(hidden)]
    b1, w2, b2, loss, n, smooth = [0.0] * hidden, [0.0] * hidden, 0.0, 0.0, 0, 1.0
    for f, p, bit in rows:
        x = [v / 32 for v in f]
        hid = [tanh(b + sum(a * v for a, v in zip(row, x, strict=True))) for row, b in zip(w1, b1, strict=True)]
        z = STRETCH[max(1, min(4095, p))] / 256 + b2 + sum(a * h for a, h in zip(w2, hid, strict=True))
        q = 1 / (1 + exp(-max(-30, min(30, z))))
        now = -log2(max(1e-6, q if bit else 1 - q))
        loss, n, smooth = loss + now, n + 1, smooth + 0.00005 * (now - smooth)
        g = rate * (bit - q)
        for j, h in enumerate(hid):
            back = g * w2[j] * (1 - h * h)
            w2[j] = max(-4.0, min(4.0, w2[j] + g * h))
            b1[j] = max(-4.0, min(4.0, b1[j] + back))
            w1[j] = [max(-4.0, min(4.0, a + back * v)) for a, v in zip(w1[j], x, strict=True)]
        b2 = max(-4.0, min(4.0, b2 + g))
    r = lambda v: int(abs(v) * 256 + 0.5) * (1 if v >= 0 else -1)  # halves away from zero
    return [[r(a) for a in row] for row in w1], [r(b) for b in b1], [r(a) for a in w2], r(b2), loss / max(n, 1), smooth


def weights_bytes(w1: list[list[int]], b1: list[int], w2: list[int], b2: int) -> bytes:
    flat = [*(a for row in w1 for a in row), *b1, *w2, b2]
    return b"QNET" + struct.pack("<H", len(b1)) + struct.pack(f"<{len(flat)}h", *flat)


def read_weights(data: bytes) -> tuple[list[list[int]], list[int], list[int], int] | None:
    if data[:4] != b"QNET" or len(data) < 6:
        return None
    n = struct.unpack("<H", data[4:6])[0]
    if len(data) != 6 + 2 * (14 * n + 1):
        return None
    v = struct.unpack(f"<{14 * n + 1}h", data[6:])
    return [list(v[12 * j : 12 * j + 12]) for j in range(n)], list(v[12 * n : 13 * n]), list(v[13 * n : 14 * n]), v[-1]


def match_states(data: bytes, least: int = 6) -> list[int]:
    """The match state before every byte: 0 none, then 1 to 3 by length (12, 24)."""
    seen: dict[bytes, int] = {}
    pointer, length, out = -1, 0, []
    for i, b in enumerate(data):
        out.append(0 if not length else 1 if length < 12 else 2 if length < 24 else 3)
        if length and data[pointer] == b:
            length, pointer = min(length + 1, 63), pointer + 1
        else:
            length = 0
        key = data[max(0, i + 1 - least) : i + 1]
        if len(key) == least:
            if not length and key in seen:
                pointer, length = seen[key], least
            seen[key] = i + 1
    return out


def ring_hits(data: bytes, depth: int = 4, least: int = 6) -> int:
    """Bytes that one of the `depth` most recently used repeat distances predicts."""
    ring: list[int] = []
    seen: dict[bytes, int] = {}
    hits = 0
    for i, b in enumerate(data):
        good = next((d for d in ring if d <= i and data[i - d] == b), None)
        if good is not None:
            hits += 1
            ring.remove(good)
            ring.insert(0, good)
        key = data[max(0, i + 1 - least) : i + 1]
        if len(key) == least:
            if key in seen and i + 1 - seen[key] not in ring:
                ring = [i + 1 - seen[key], *ring][:depth]
            seen[key] = i + 1
    return hits


def front_ranks(symbols: Iterable[str]) -> list[int]:
    """Move-to-front ranks; a new symbol has rank -1."""
    order, out = [], []
    for s in symbols:
        if s in order:
            k = order.index(s)
            out.append(k)
            order.pop(k)
        else:
            out.append(-1)
        order.insert(0, s)
    return out

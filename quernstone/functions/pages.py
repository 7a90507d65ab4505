"""Pages of a dump within one stream: other orders, and the way back by their ids."""

from __future__ import annotations

import re

from quernstone.functions.codecs import read_varint, varint
from quernstone.functions.hashing import GOLDEN, fnv1a_int, splitmix64_int

_PAGE = re.compile(rb"[\s\S]*?</page>")
_ID = re.compile(rb"<id>([0-9]+)</id>")
_TITLE = re.compile(rb"<title>([^<]*)</title>")
_CATEGORY = re.compile(rb"(?i)\[\[category:([^|\]\n]*)")
_TEMPLATE = re.compile(rb"\{\{([^|}\n]*)")
_BOILER = re.compile(rb"(?i)\{\{([^|}\n]+)|\[\[((?:category|file|image):[^|\]\n]*)")
_NAMESPACES = (b"template", b"category", b"wikipedia", b"image", b"user", b"help", b"portal", b"mediawiki", b"talk", b"media", b"special")


def split(data: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """Header, pages and tail, or None if there are no pages or their ids don't ascend strictly: then
    an order could not be undone."""
    at = data.find(b"<page>")
    if at < 0:
        return None
    pages = _PAGE.findall(data, at)
    ids = [_ID.search(p) for p in pages]
    if not pages or None in ids or any(int(a[1]) >= int(b[1]) for a, b in zip(ids, ids[1:], strict=False)):
        return None
    return data[:at], pages, data[at + sum(map(len, pages)) :]


def _names(p: bytes, pattern: re.Pattern) -> list[bytes]:
    return sorted({x.lower() for x in pattern.findall(p)})


def _signature(words: set[bytes], k: int = 8) -> list[int]:
    hashes = [fnv1a_int(w.decode("latin-1")) for w in words]
    return [min((splitmix64_int(h ^ (i * GOLDEN & (1 << 64) - 1)) for h in hashes), default=(1 << 64) - 1) for i in range(k)]


def _walk(signatures: list[list[int]], window: int = 64) -> list[int]:
    left, out = sorted(range(len(signatures)), key=lambda i: (signatures[i], i)), []
    while left:
        pick = 0
        if out:
            now = signatures[out[-1]]
            pick = min(range(min(window, len(left))), key=lambda j: (sum((x ^ y).bit_count() for x, y in zip(now, signatures[left[j]], strict=True)), j))
        out.append(left.pop(pick))
    return out


def order(pages: list[bytes], how: str) -> list[int]:
    """The indices of the pages in an order; ties by place."""
    title = lambda p: m[1] if (m := _TITLE.search(p)) else b""
    first = lambda p, x: m[1].lower() if (m := x.search(p)) else b""
    sets = lambda p, x: b"\0".join(_names(p, x))
    space = lambda p: _NAMESPACES.index(n) + 1 if b":" in title(p) and (n := title(p).split(b":")[0].lower()) in _NAMESPACES else 0
    if how in ("minhash", "greedy"):
        signed = [_signature({w.lower() for w in re.findall(rb"[A-Za-z]+", p)}) for p in pages]
        return _walk(signed) if how == "greedy" else sorted(range(len(pages)), key=lambda i: (signed[i], i))
    keys = {
        "identity": lambda p: (),
        "title": lambda p: (title(p),),
        "size": lambda p: (len(p),),
        "namespace": lambda p: (space(p), title(p)),
        "boilerplate": lambda p: _signature({(a or b).lower() for a, b in _BOILER.findall(p)}),
        "shuffle": lambda p: splitmix64_int(int(_ID.search(p)[1])),
        "category": lambda p: (first(p, _CATEGORY), title(p)),
        "template": lambda p: (first(p, _TEMPLATE), title(p)),
        "category_set": lambda p: (sets(p, _CATEGORY), title(p)),
        "full": lambda p: (sets(p, _CATEGORY), sets(p, _TEMPLATE), title(p)),
        "full_novelty": lambda p: (sets(p, _CATEGORY), sets(p, _TEMPLATE), len({p[max(0, i - 2) : i + 1] for i in range(len(p))}), title(p)),
    }
    return sorted(range(len(pages)), key=lambda i: (keys[how](pages[i]), i))


def reorder(data: bytes, how: str) -> bytes | None:
    """The length of the header, and the stream with its pages in an order (what lies between two pages
    goes with the second); None if that could not be undone."""
    parts = split(data)
    if parts is None:
        return None
    out = varint(len(parts[0])) + parts[0] + b"".join(parts[1][i] for i in order(parts[1], how)) + parts[2]
    return out if restore(out) == data else None


def restore(data: bytes) -> bytes:
    """The stream with its pages sorted by their ids again."""
    size, begin = read_varint(data, 0)
    at = begin + size
    pages = _PAGE.findall(data, at)
    back = sorted(pages, key=lambda p: int(m[1]) if (m := _ID.search(p)) else -1)
    return data[begin:at] + b"".join(back) + data[at + sum(map(len, pages)) :]

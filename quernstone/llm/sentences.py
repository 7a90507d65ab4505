"""Sentences of texts in many languages and scripts: prose blocks, candidate boundaries, and a
maximum-entropy classifier trained on reliable boundaries of the corpus itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents whose candidates the classifier is fitted on, at most: those with the smallest id hashes.
SAMPLE_DOCS = 2_500
#: Entries after which a worker's cache is emptied; it changes speed only.
CACHE_ENTRIES = 200_000

_MARKS = "!.?…。！？｡।॥؟۔։።፧;;"
_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "‘": "’", "‚": "‘’"}
_CLOSE = {c for cs in _OPEN.values() for c in cs}
_BRACKETS = "([（"
#: Fillers of the shadow text: a reference, markup that only decorates, a region that isn't prose.
_REF, _NIL, _GAP = "\ue000", "\ue001", "\ue002"

_PAGE = re.compile(r"<text\b[^>]*>")
_LINES = re.compile(r"[^\r\n]+")
_BREAK = re.compile(r"\r\n|\n|\r")
_REGION = re.compile(r"^[ \t\ufeff\u200b]*(\{\{|\{\||<!--|&lt;!--)", re.M)
_BRACES = re.compile(r"\{\{|\}\}")
_TAGS = re.compile(r"\s*(?:</?[A-Za-z][^<>]*>\s*)+\Z")
_HEADING = re.compile(r"=+[^=].*=\s*\Z")
#: A line of nothing but links into a namespace (categories, in any language) isn't prose.
_NAMESPACED = re.compile(r"(?:\[\[[^\[\]|:\n]+:[^\[\]\n]*\]\]\s*)+\Z")
_ITEM = re.compile(r"[*#:;]+")
_REFS = re.compile(r"<ref\b[^<>]*/\s*>|<ref\b[^<>]*>.*?</ref\s*>|&lt;ref\b(?:(?!&gt;).)*?/\s*&gt;|&lt;ref\b(?:(?!&gt;).)*&gt;.*?&lt;/ref\s*&gt;", re.S | re.I)
_DECOR = re.compile(r"'{2,}|</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|]*)\]\]")
_PAIRED = re.compile("[\"'()\\[\\]" + "".join(sorted({*_OPEN, *_CLOSE} - set("()[]"))) + "]")
_SOFT = re.escape("!.?…;;")
_HARD = re.escape("".join(c for c in _MARKS if c not in "!.?…;;"))
#: A run of marks; Latin ones before a digit or small letter belong to a number or name.
_RUN = re.compile(rf"[{_SOFT}]*[{_HARD}][{_SOFT}{_HARD}]*|[{_SOFT}]++(?![0-9a-z_])")
_ALL = re.compile(f"[{_SOFT}{_HARD}]+")
_ABSORB = {*_MARKS, *_CLOSE, *"\"'", " ", "\u00a0", "\u202f", _NIL, _REF} - {";"}
_TAIL = re.compile(f"[{_NIL}]*")
_EDGE = " \t\r\n\u00a0\u2003\u3000\ufeff\u200b"
_THAI = "ก-๛"
_THAI_GAP = re.compile(rf"(?<=[{_THAI}])([{_NIL}{_REF}]*)(\s+)(?=[{_NIL}]*[{_THAI}])")


def _gaps(text: str) -> str:
    """Templates, tables and comments that begin a line, as fillers of the same length."""
    out, at = [], 0
    for m in _REGION.finditer(text):
        start, kind = m.start(1), m[1]
        if start < at:
            continue
        if kind == "{{":
            depth, end = 0, -1
            for b in _BRACES.finditer(text, start):
                depth += 1 if b[0] == "{{" else -1
                if not depth:
                    end = b.end()
                    break
        else:
            close = {"{|": "|}", "<!--": "-->", "&lt;!--": "--&gt;"}[kind]
            end = text.find(close, start + len(kind))
            end = end + len(close) if end >= 0 else -1
        if end < 0:  # never closed: up to the next blank line
            m = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)").search(text, start)
            end = m.start() if m else len(text)
        out += [text[at:start], _GAP * (end - start)]
        at = end
    return "".join(out) + text[at:] if out else text


def blocks(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with regions that aren't prose filled, and the spans of its prose: paragraphs and
    list items."""
    lo, hi = 0, len(text)
    if "<text" in text and (page := _PAGE.search(text)):
        lo = page.end()
        end = text.find("</text", lo)
        hi = end if end >= 0 else hi
    if "{{" in text or "{|" in text or "!--" in text:
        text = _gaps(text)
    out: list[tuple[int, int]] = []
    start = stop = -1
    for m in _LINES.finditer(text, lo, hi):
        a, b = m.span()
        if start >= 0 and a - stop > 1 and (a - stop > 2 or text[stop:a] != "\r\n"):  # a blank line
            out.append((start, stop))
            start = -1
        line = m[0]
        bare = line.lstrip(_EDGE)
        lead = bare[:1]
        if lead in "=<[-|!*#:;" + _GAP or lead == "":
            mark = None
            if lead == _GAP:
                rest = bare.lstrip(_GAP).lstrip(_EDGE)
                skip, begin = not rest, b - len(rest)
                if start >= 0:
                    out.append((start, stop))
                    start = -1
                if not skip:
                    start, stop = begin, b
                continue
            skip = not bare or lead == "=" and _HEADING.match(bare) or bare.startswith("--") or lead == "[" and _NAMESPACED.match(bare) or lead == "<" and _TAGS.match(bare)
            if skip or lead in "*#:;" and (mark := _ITEM.match(bare)):
                if start >= 0:
                    out.append((start, stop))
                    start = -1
                if mark:
                    out.append((b - len(bare) + mark.end(), b))
                continue
        if start < 0:
            start = a
        stop = b
    if start >= 0:
        out.append((start, stop))
    return text, out


def _shade(s: str) -> str:
    """The block as the scanner sees it, character by character in the same places."""
    if "&" in s or "<" in s:
        s = _REFS.sub(lambda m: _REF * len(m[0]), s)
        if "&quot;" in s:
            s = s.replace("&quot;", '"' + _NIL * 5)
        if "&apos;" in s:
            s = s.replace("&apos;", "'" + _NIL * 5)
    if "''" in s or "<" in s:
        s = _DECOR.sub(lambda m: _NIL * len(m[0]), s)
    if "[[" in s:
        s = _LINK.sub(_link, s)
    return s


_PARTNERS = {c: "".join(o for o in _OPEN if c in _OPEN[o]) for c in _CLOSE}


def _top(stack: list[tuple[str, int]], openers: str, c: str) -> int:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in openers:
            return k
    return -1


_DULL = str.maketrans(dict.fromkeys(_MARKS + "()（）\"“”„«»「」", "·"))


def _link(m: re.Match) -> str:
    """A link as its words: the target before a bar is filler, marks within are none."""
    word = m[1]
    return _NIL * (len(m[0]) - len(word) - 2) + word.translate(_DULL) + _NIL * 2


def _regions(s: str) -> list[tuple[int, int, str]]:
    """Outermost pairs of quotes and brackets: (opener, closer, opening mark)."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int, str]] = []
    for m in _PAIRED.finditer(s):
        c, i = m[0], m.start()
        if c == "'" or c == '"':
            before, after = s[i - 1 : i], s[i + 1 : i + 2]
            at = _top(stack, c, c) if stack else -1
            if at >= 0 and not (c == "'" and (before.isspace() or after.isalnum())):
                found.append((stack[at][1], i, c))
                del stack[at:]
            elif at < 0 and (c == '"' or (not before or before.isspace() or before in "([—“\"") and after and not after.isspace()):
                stack.append((c, i))
            continue
        if stack and c in _CLOSE:
            at = _top(stack, _PARTNERS[c], c)
            if at >= 0:
                found.append((stack[at][1], i, stack[at][0]))
                del stack[at:]
                continue
        if c in _OPEN:
            stack.append((c, i))
    if not found:
        return found
    found.sort()
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] > out[-1][1]:
            out.append(f)
    return out


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if o < 0x400:
        return "greek"
    if o < 0x530:
        return "cyril"
    if o < 0x590:
        return "armen"
    if o < 0x900:
        return "arab"
    if o < 0xE00:
        return "indic"
    if o < 0xE80:
        return "thai"
    if 0x1200 <= o < 0x1400:
        return "ethio"
    if 0xAC00 <= o < 0xD7B0 or 0x1100 <= o < 0x1200:
        return "hangul"
    return "cjk" if o >= 0x2E80 else "other"


def _wide(c: str) -> bool:
    return "⺀" <= c < "가" or "豈" <= c < "ﬀ" or "＀" <= c < "ﾠ"


def candidates(s: str) -> list[tuple[int, int, int, int, str]]:
    """Possible ends in a shaded block: (mark, end of the sentence, where the next one starts, how
    the last region began or -1, kind). Marks inside quotes and brackets are none, except the last
    before the closer."""
    regions = _regions(s) if _PAIRED.search(s) else []
    out: list[tuple[int, int, int, int, str]] = []
    k, size, done = 0, len(s), 0
    for m in _RUN.finditer(s):
        i, e = m.span()
        if i < done:
            continue
        while k < len(regions) and regions[k][1] < i:
            k += 1
        kind, opened = "m", -1
        if k < len(regions) and regions[k][0] < i:
            o, c, q = regions[k]
            if s[e:c].strip(_EDGE + _NIL + _REF + "\"'”»’)]“"):
                continue
            kind, opened, e = ("b" if q in _BRACKETS else "q"), o, c + 1
            if q == "[":
                continue
        nxt = s[e : e + 1]
        if kind == "m":
            c = m[0][-1]
            if nxt and c in ".;!?" and (nxt.isalnum() or nxt == "_"):
                # no blank: only between a word or number and a capital, or before wide letters
                if not (_wide(nxt) and len(m[0]) > 1 or nxt.isupper() and (s[i - 1 : i].islower() or s[i - 1 : i].isdigit()) and "/" not in s[s.rfind(" ", 0, i) + 1 : i]):
                    continue
            if m[0] == ";" and not (i and _script(s[i - 1]) == "greek"):
                continue
            if c in ".:" and nxt in ",:" and nxt:
                continue
        if kind == "m" and nxt == " " and (c := s[e + 1 : e + 2]) and c != "»" and not c.isspace():
            done = e
            out.append((i, e, e + 1, -1, "m"))
            continue
        # further marks, closers, references
        while e < size and (c := s[e]) in _ABSORB:
            if c in _CLOSE or c == '"' or c == "'":
                if c in "\"'“‘" and any(r[0] == e for r in regions[k : k + 3]):
                    break
            elif c in " \u00a0\u202f":
                if s[e + 1 : e + 2] != "»":
                    break
            e += 1
        n = _skip(s, e)
        done = e
        out.append((i, e, n, opened, kind))
    return out


class _Words(dict):
    """Words as features with their shapes, by the word as it stands."""

    def __missing__(self, w: str) -> tuple[str, str, str]:
        value = self._of(w)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[w] = value
        return value

    @staticmethod
    def _of(w: str) -> tuple[str, str, str]:
        core = w.strip(_NIL + _REF + "\"'“”„«»()[]「」（）‘’¿¡—")
        lead = w.lstrip(_NIL)[:1]
        lead = lead if lead in "\"'“„«「‘(（¿¡—" else ""
        if not core:
            return "-", lead + "z", "none"
        first, n = core[0], len(core)
        script = _script(core[-1])
        digits = sum(c.isdigit() for c in core)
        if digits:
            return "#", f"{lead}d{min(n, 5)}{'x' if digits < n else ''}", script
        if _wide(first):
            return core, lead + "w", script
        case = "U" if first.isupper() else "l" if first.islower() else script
        if n == 1:
            return core.lower(), f"{lead}{case}1", script
        rest = ("U" if core[1:].isupper() else "l") if case == "U" else ""
        return core.lower(), f"{lead}{case}{rest}{min(n, 5)}{'.' if '.' in core else ''}", script


_words = _Words()
_CUT = re.compile(r"[^\s、，。：；！？「“（]*.?")


def _left(s: str, start: int, i: int) -> tuple[str, list[str]]:
    """The end of s[start:i], and after its last two words if it ends within them; looked at in
    growing stretches, so that the words are whole however long they are."""
    size = 48
    while True:
        left = s[i - size if i - size > start else start : i]
        words = left.rsplit(None, 2)
        if len(words) > 2 or i - size <= start:
            return left, words
        size *= 4


def _right(s: str, at: int, n: int) -> list[str]:
    """The first n words from a place on, whole, in the same way."""
    size = 60
    while True:
        words = s[at : at + size].split(None, n)
        if len(words) > n or at + size >= len(s):
            return words[:n]
        size *= 4


def context(s: str, start: int, cand: tuple[int, int, int, int, str], t: str, at: int) -> tuple:
    """What the classifier sees of a candidate end of the sentence that begins at start; what
    follows begins at a place of t."""
    i, e, _, opened, kind = cand
    run = s[i] if e == i + 1 else _ALL.match(s, i)[0]
    left, words = _left(s, start, i)
    spaced = left[-1:].isspace()
    p = words[-1] if words and not spaced else ""
    p2 = words[-2] if len(words) > 1 else ""
    if p and _wide(p[-1]):
        p2, p = p[-4:-2], p[-2:]
    while t[at : at + 1] == _NIL:
        at += 1
    how, bag = "", ()
    if at < len(t) and _wide(t[at]):
        n = t[at : at + 2]
        if kind == "q":
            cut = _CUT.match(t, at)[0].replace(_NIL, "")
            bag = (cut[-2:], cut[-1:])
    else:
        ahead = _right(t, at, 5 if kind == "q" else 1)
        n = ahead[0] if ahead else ""
        if kind == "q":
            bag = tuple(w.lower() for w in ahead)
    if kind != "m":
        intro = s[start:opened].strip(_EDGE + _NIL)
        how = "0" if not intro else intro[-1] if intro[-1] in ":：,，،" else "i"
    return run if len(run) == 1 else run[0] + "+", p, p2, n, spaced, kind, how, bag


def features(ctx: tuple) -> list[str]:
    m, p, p2, n, spaced, kind, how, bag = ctx
    (pw, ps, script), (qw, _, _), (nw, ns, _) = _words[p], _words[p2], _words[n]
    n2 = ns[:2]
    f = [f"m{m}|{script}", f"p{pw}", f"s{ps}", f"n{nw}", f"N{ns}", f"{m}|{ps}|{n2}", f"{m}|N{ns}", f"S{script}|{n2}", f"P{pw}|{n2}", f"2{qw}|{ps}", f"3{ps}|{nw}"]
    if spaced:
        f.append(f"sp{m}|{n2}")
    if kind != "m":
        f += [f"k{kind}{how}", f"k{kind}{how}|{n2}", f"k{kind}{how}|{nw}", *[f"b{how}|{w}" for w in bag]]
    return f


class Boundaries:
    """A logistic (maximum-entropy) model of sentence ends.

    Reliable ends are marks at the end of a paragraph or list item, seen with the beginning of the
    next one as what follows. All other candidates are a mixture, so a first model only tells how
    probably a candidate is one of the reliable ends; relative to the mean of that probability over
    reliable ends of the script, candidates are likely ends, unlikely ones or neither. The final model is fitted on the
    reliable ends, the likely and the unlikely ones.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.first = {x[1:] for x in weights if x[:1] == "p"} | {x[1:].rpartition("|")[0] for x in weights if x[:1] == "P"}
        self.second = {x[1:].rpartition("|")[0] for x in weights if x[:1] == "2"}
        self.next = {x[1:] for x in weights if x[:1] == "n"} | {x.rpartition("|")[2] for x in weights if x[:1] in "3k"}
        self.bag = {x.partition("|")[2] for x in weights if x[:1] == "b"}
        self.asked: dict[tuple, bool] = {}

    def is_end(self, ctx: tuple) -> bool:
        """The decision, remembered by what the model knows of the context."""
        m, p, p2, n, spaced, kind, how, bag = ctx
        pw, ps, script = _words[p]
        qw, nw = _words[p2][0], _words[n]
        key = (m, pw if pw in self.first else "", ps, script, qw if qw in self.second else "", nw[0] if nw[0] in self.next else "", nw[1], spaced, kind, how, tuple(w for w in bag if w in self.bag) if bag else bag)
        got = self.asked.get(key)
        if got is None:
            w = self.weights
            got = w.get("", 0.0) + sum(w.get(x, 0.0) for x in features(ctx)) > 0
            if len(self.asked) >= CACHE_ENTRIES:
                self.asked.clear()
            self.asked[key] = got
        return got

    @staticmethod
    def fit(rows: list[tuple[tuple, int]], *, least: int = 6) -> "Boundaries":
        if not any(s for _, s in rows):
            return Boundaries({"": 1.0})
        table = [features(c) for c, _ in rows]
        seen = Counter(x for f in table for x in f)
        index = {"": 0} | {x: k + 1 for k, x in enumerate(sorted(x for x, n in seen.items() if n >= least))}
        which, where = [], []
        for r, f in enumerate(table):
            ks = [0, *(index[x] for x in f if x in index)]
            which += ks
            where += [r] * len(ks)
        which, where = np.array(which, np.int64), np.array(where, np.int64)
        y = np.array([s for _, s in rows], float)
        first = _logistic(which, where, y, np.ones(len(y)), len(index), 12.0)
        p = 1 / (1 + np.exp(-np.bincount(where, first[which], len(y))))
        script = np.array([f[0].rpartition("|")[2] for f in table])
        share = p / p[y > 0].mean()
        for name in set(script):
            own = (script == name) & (y > 0)
            if own.sum() >= 30:
                share[script == name] = p[script == name] / p[own].mean()
        sure = (y > 0) | (share > 0.7) | (share < 0.3)
        end = np.where((y > 0) | (share > 0.5), 1.0, 0.0)
        w = _logistic(which, where, end, sure.astype(float), len(index), 1.5)
        return Boundaries({x: float(w[k]) for x, k in index.items() if k == 0 or abs(w[k]) > 0.03})


def _logistic(which: np.ndarray, where: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, ridge: float, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic model with a quadratic prior, by adaptive gradient steps."""
    w, total, n = np.zeros(size), np.full(size, 1e-8), max(weight.sum(), 1)
    for k in range(rounds):
        z = np.bincount(where, w[which], len(y))
        g = np.bincount(which, ((1 / (1 + np.exp(-z)) - y) * weight / n)[where], size) + ridge / n * w
        total += g * g
        w -= 0.5 * g / np.sqrt(total)
    return w


def training_rows(text: str | None) -> list[tuple[tuple, int]]:
    """Contexts and labels of all candidates of a text: 1 for reliable ends."""
    out: list[tuple[tuple, int]] = []
    if not text:
        return out
    full, spans = blocks(text)
    shades = [_shade(full[a:b]) for a, b in spans]
    for k, s in enumerate(shades):
        found = candidates(s)
        start = len(s) - len(s.lstrip(_EDGE))
        for c in found:
            if c[4] == "b" and s[start : c[3]].strip(_EDGE + _NIL):
                continue
            if c[2] < len(s):
                ctx = context(s, start, c, s, c[2])
                out.append((ctx, 0))
                nw = s[c[2] : c[2] + 1]
                if ctx[0] != "." or nw.isupper() and len(ctx[1]) > 3:  # where the next one may begin
                    start = c[2]
            elif k + 1 < len(shades):
                after = shades[k + 1].lstrip(_EDGE)
                if after:
                    out.append((context(s, start, c, after, 0), 1))
    return out


def split(text: str | None, model: Boundaries | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, without outer white space."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    full, spans = blocks(text)
    for a, b in spans:
        s = _shade(full[a:b])
        start = _skip(s, 0)
        gaps = [(m.start(2), m.end()) for m in _THAI_GAP.finditer(s)] if _THAI_ANY.search(s) else []
        found = candidates(s)
        if gaps:
            inner = _regions(s)
            gaps = [(x, y) for x, y in gaps if not any(o < x < c for o, c, q in inner)]
            found = sorted([*found, *((x, x, y, -1, "t") for x, y in gaps)], key=lambda c: (c[1], c[4] != "t"))
        for c in found:
            i, e, n, opened, kind = c
            if n >= len(s):
                break
            if i < start:
                continue
            if kind == "b" and s[start:opened].strip(_EDGE + _NIL):
                continue
            if kind == "t" or model is None or model.is_end(context(s, start, c, s, n)):
                if e > start:
                    out.append((a + start, a + e))
                start = _skip(s, n)
        end = len(s)
        while end > start and s[end - 1] in _EDGE or end > start and s[end - 1].isspace():
            end -= 1
        if end > start:
            out.append((a + start, a + end))
    return out


_THAI_ANY = re.compile(f"[{_THAI}]")


def _skip(s: str, i: int) -> int:
    while i < len(s) and (s[i].isspace() or s[i] in _EDGE):
        i += 1
    return i


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text", *, sample: int = SAMPLE_DOCS) -> Boundaries:
    """The classifier, fitted on the candidates of at most `sample` documents: those whose hashes of
    the key lie under a threshold that the number of rows sets, the smallest first; of rows with the same
    hash one counts. So a partition hands on its share of the sample only, and neither the one
    fitting task nor the driver grows with the corpus."""
    n = documents.count()
    share = min(1.0, (sample + 8 * sample**0.5 + 8) / max(n, 1))
    h = F.xxhash64(key)
    rows = documents.filter(F.col(text) != "").filter(h <= int(-(2.0**63) + share * (2.0**64 - 4096))).select(F.col(text).alias("t"), h.alias("h"))
    rows = rows.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for t in b.column(0).to_pylist() for r in training_rows(t)]
        model = Boundaries.fit(found)
        yield pa.RecordBatch.from_arrays([pa.array([*model.weights], pa.string()), pa.array([*model.weights.values()], pa.float64())], names=["name", "value"])

    got = rows.select("t").coalesce(1).mapInArrow(run, "name string, value double").collect()
    return Boundaries({r.name: r.value for r in got})


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", *, model: Boundaries | None = None, sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row (key, start_pos, end_pos) per sentence of every text; offsets in code points, end
    exclusive.

    Prose is split into blocks: blank lines, markup lines and the ends of list items end a
    sentence. Within a block every mark outside quotes and brackets, the last mark of a quote or of
    brackets that begin a sentence, and every blank between Thai words are candidates; the Thai
    blanks always end a sentence, the others where the classifier says so. Whole texts are split in
    place: no shuffle.

    Null, empty and blank texts and texts of markup alone give no rows; text without any mark is
    one sentence; repeated rows come out repeated; an empty table gives no rows.
    """
    model = fit(documents, key, text, sample=sample) if model is None else model
    source = documents.select(F.col(key), F.col(text).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [split(t, model) for t in b.column(1).to_pylist()]
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(spans)), [len(x) for x in spans])))
            flat = np.array([p for x in spans for p in x], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([keys, pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=[key, "start_pos", "end_pos"])

    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, start_pos int, end_pos int")

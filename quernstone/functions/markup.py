"""Segmentation of markup with balanced templates and links, and its table function."""

from __future__ import annotations

import re

from quernstone.operators.text import TOKEN

#: Characters a template or link may span.
SPAN = 65_536
TABLE_SPAN = 1 << 20
_TOKEN = re.compile(TOKEN)
_BRACE = {"{{": re.compile(r"[{}]"), "[[": re.compile(r"[\[\]]")}
_KINDS = [("<!--", "comment"), ("<?", "pi"), ("<![CDATA[", "cdata")]


def _balanced(text: str, at: int, opener: str) -> int:
    """The end of a construct whose single braces balance, or -1."""
    depth = 0
    for m in _BRACE[opener].finditer(text, at, min(len(text), at + SPAN)):
        depth += 1 if m[0] == opener[0] else -1
        if not depth:
            return m.end()
    return -1


def segment(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, length) of every token; they partition the text. A template, link or table
    that is not closed within its bound is two characters of punctuation."""
    out, at = [], 0
    while at < len(text):
        two, kind = text[at : at + 2], None
        if two in _BRACE:
            end = _balanced(text, at, two)
            kind, end = ("template" if two == "{{" else "link", end) if end >= 0 else ("punct", at + 2)
        elif two == "{|":
            end = text.find("|}", at + 2, at + TABLE_SPAN)
            kind, end = ("table", end + 2) if end >= 0 else ("punct", at + 2)
        else:
            m = _TOKEN.match(text, at)
            t, end = m[0], m.end()
            kind = _kind(t)
        out.append((kind, at, end - at))
        at = end
    return out


def _kind(t: str) -> str:
    c = t[0]
    if c == "<" and len(t) > 1:
        for lead, kind in _KINDS:
            if t.startswith(lead):
                return kind
        if t[-1] == ">":
            return "close_tag" if t[1] == "/" else "empty_tag" if t[-2] == "/" else "open_tag"
    if c == "&" and t[-1] == ";" and len(t) > 2:
        return "entity"
    if "://" in t and t[:1] in "hf" and re.match(r"(?:https?|ftps?)://", t):
        return "url"
    if c in "\r\n":
        return "newlines"
    if c in " \t":
        return "spaces"
    if c.isascii() and c.isalpha():
        return "word"
    if c in "0123456789":
        return "number"
    return "punct" if "!" <= c <= "~" else "raw"


class Segment:
    """Table function: the tokens of a text, for `LATERAL segment(text)`."""

    def eval(self, text: str):
        for seq, (kind, start, length) in enumerate(segment(text or "")):
            yield seq, kind, start, length

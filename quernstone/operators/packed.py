"""Several values packed in one text: one row per value, with its place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.numbers import stripped
from quernstone.session import stage

#: Marks that the broadcast rules may have together: with some tens of bytes a mark it bounds the
#: broadcast's size.
BROADCAST_MARKS = 1_000_000

_PAIRS = {"(": ")", "[": "]", "{": "}"}
_RULE = "field string, skeleton string, n bigint, slots array<struct<place: int, parts: array<int>>>"


def _marks(delimiters: str) -> tuple[str, str, str]:
    """Patterns of a hard delimiter with its blanks, of an ordinary run, and of any token."""
    d = "".join("\\" + c for c in delimiters)
    cut = rf"\s*[{d}]\s*"
    plain = rf"(?:[^\s{d}\"'()\[\]{{}}=]|=(?![\"']))+"
    return f"(?U){cut}", f"(?U){plain}", rf"(?U)({cut}|\s+|{plain}|[\"'()\[\]{{}}=])"


def skeleton(text: Column, delimiters: str) -> Column:
    """The text with each ordinary run as `a`, each hard delimiter with its blanks as `d` and other
    blanks as `s`; quotes, brackets and an equals sign before a quote stay."""
    cut, plain, _ = _marks(delimiters)
    masked = F.regexp_replace(stripped(text), plain, "a")
    return F.regexp_replace(F.regexp_replace(masked, cut, "d"), r"(?U)\s+", "s")


def split_rule(s: str) -> list[dict]:
    """Where the values of a skeleton lie: for each value that isn't empty its place and the
    tokens that make it up; nothing if there are fewer than two such values."""
    lo, hi = 0, len(s)
    while hi - lo > 1 and s[lo] in _PAIRS and _closing(s, lo, hi) == hi - 1:
        lo, hi = lo + 1, hi - 1
        lo, hi = lo + (s[lo] == "s"), hi - (hi - lo > 1 and s[hi - 1] == "s")
    values, now, i = [], [], lo
    while i < hi:
        c = s[i]
        end = _quote_end(s, i, hi) if c in "\"'" and (not now and (i == lo or s[i - 1] in "ds") or s[i - 1 : i] == "=") else None
        if end is not None:
            k = i + 1
            while k < end:
                now.append(k)
                k += 2 if s[k] == c else 1
            i = end + 1
        elif c in "ds":
            values.append(now)
            now, i = [], i + 1
        else:
            now.append(i)
            i += 1
    values.append(now)
    out = []
    for place, v in enumerate(values):
        if len(v) > 1 and _PAIRS.get(s[v[0]]) == s[v[-1]]:
            v = v[1:-1]
        if v:
            out.append({"place": place, "parts": v})
    return out if len(out) > 1 else []


def _quote_end(s: str, i: int, hi: int) -> int | None:
    """The mark that closes the quote opened at i: not doubled, before a delimiter, a closing
    bracket or the end."""
    k = i + 1
    while k < hi:
        if s[k] == s[i]:
            if k + 1 < hi and s[k + 1] == s[i]:
                k += 2
                continue
            if k + 1 == hi or s[k + 1] in "ds)]}":
                return k
        k += 1
    return None


def _closing(s: str, lo: int, hi: int) -> int | None:
    """The bracket that closes the one at lo, without looking into quotes."""
    depth, i = [], lo
    while i < hi:
        c = s[i]
        if c in "\"'" and (s[i - 1 : i] in ("d", "s", "=") or s[i - 1 : i] in _PAIRS) and (end := _quote_end(s, i, hi)) is not None:
            i = end
        elif c in _PAIRS:
            depth.append(_PAIRS[c])
        elif depth and c == depth[-1]:
            depth.pop()
            if not depth:
                return i
        i += 1
    return None


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(slots=[split_rule(s) for s in b["skeleton"]])[["field", "skeleton", "n", "slots"]]


def split_packed(df: DataFrame, key: str, fields: dict[str, str], *, broadcast_marks: int = BROADCAST_MARKS) -> DataFrame:
    """One row (key, field, place, value) per value of each text that holds two or more.

    fields: column -> its hard delimiters. A delimiter takes the blanks around it; blanks alone
    are one; inside quotes (opened at the start of a value or after `=`) nothing delimits. Values
    come without the quotes or brackets that enclose them, a doubled quote mark inside its own
    quotes as one. place counts from 0; empty values take a place without a row.

    Each text is masked to a skeleton; the splitting rule is found once per distinct skeleton, in
    parallel, and applied to the rows by token positions. Rules are broadcast while their marks,
    summed, stay within `broadcast_marks`. Beyond that, classes of skeletons (by the powers of two
    of their texts and lengths) are taken from the most frequent on as far as they fit, and the
    rules of the others are joined by shuffle.

    Null, empty and blank texts and texts with one value that isn't empty give no rows. A quote that never closes is an
    ordinary mark. Repeated rows come out repeated. Texts of any length are split whole.
    """
    rows = None
    for field, delimiters in fields.items():
        cut, _, token = _marks(delimiters)
        one = df.select(F.col(key).alias("key"), F.lit(field).alias("field"), stripped(F.col(field)).alias("text")).filter(F.col("text").rlike(rf"{cut}|\s"))
        one = one.select("key", "field", F.regexp_extract_all("text", F.lit(token), F.lit(1)).alias("tokens"), skeleton(F.col("text"), delimiters).alias("skeleton"))
        rows = one if rows is None else rows.unionByName(one)
    found = rows.groupBy("field", "skeleton").agg(F.count("*").alias("n"))
    rules = stage(found.mapInPandas(_resolve, _RULE)).filter(F.size("slots") > 0)
    on = ["field", "skeleton"]
    # at most 64 x 64 classes, however many rules there are
    marks, often = F.length("skeleton"), F.floor(F.log2("n"))
    rules = rules.withColumns({"_often": often, "_size": F.floor(F.log2(marks))})
    classes = rules.groupBy("_often", "_size").agg(F.sum(marks).alias("marks")).collect()
    kept, left = [], broadcast_marks
    for c in sorted(classes, key=lambda c: (-c["_often"], c["_size"])):
        if c.marks <= left:
            kept, left = [*kept, c["_often"] * 64 + c["_size"]], left - c.marks
    chosen = (F.col("_often") * 64 + F.col("_size")).isin(kept)
    few = F.broadcast(rules.filter(chosen).drop("_often", "_size"))
    hit = rows.join(few, on)
    if len(kept) < len(classes):
        rare = rules.filter(~chosen).drop("_often", "_size")
        hit = hit.unionByName(rows.join(few.select(*on), on, "left_anti").join(rare, on))
    slot = hit.select("key", "field", "tokens", F.explode("slots").alias("slot"))
    value = F.array_join(F.transform("slot.parts", lambda i: F.get("tokens", i)), "")
    return slot.select(F.col("key").alias(key), "field", F.col("slot.place").alias("place"), value.alias("value"))

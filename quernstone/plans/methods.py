"""The registry of coding methods as a dimension table, and the projected memory of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.registry import NAMES, ORDERS

def _between(c: Column, *ranges: tuple[int, int]) -> Column:
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | c.between(lo, hi)
    return out


def stages(i: Column) -> dict[str, Column]:
    """What a method enables, by its id."""
    p4 = _between(i, (35, 35), (51, 94))
    none = F.lit(None)
    order = none.cast("string")
    for k, name in reversed(list(enumerate(ORDERS, 73))):
        order = F.when(i == k, name).otherwise(order)
    return {
        "phase4": p4,
        "permutation": F.when(i.isin(3, 7), "frequency").when(i == 4, "random"),
        "inherit": F.when(i.isin(5, 7), "parent").when(i == 6, "unrelated"),
        "case_kind": F.when(i.isin(11, 13), "merge").when(i.isin(12, 14), "mark"),
        "match2_min": F.when(p4 | (i == 22), 8).when(i == 21, 6).when(i == 23, 12).when(i == 24, 16).when(i == 25, 24),
        "sparse_tier": F.when(p4 | (i == 26), "4/1").when(i == 27, "6/1").when(i == 28, "6/2"),
        "ring": F.when(i.between(29, 32), i - 28).otherwise(0),
        "match_byte": F.when(p4 | (i == 33), True).when(i == 34, False),
        "grammar": F.when(i == 44, "pairs").when(i == 45, "pairs+mtf").when(i == 46, "maximal repeat").when(i == 47, "rule rank").when(i == 48, "first use").when(i == 49, "one shot"),
        "factors": i == 50,
        "stems": i == 37,
        "base6": _between(i, (63, 68), (71, 87)),
        "hoists": p4 | _between(i, (2, 10), (13, 14), (17, 18), (20, 36), (38, 43)),
        "token_kind": F.when(i == 88, "front").when(i == 89, "second").when(i.isin(90, 91), "priced").when(i == 92, "affix").when(i == 93, "first use").when(i == 94, "subword")
        .when(p4 | i.isin(16, 18) | _between(i, (21, 36), (38, 39)), "reversed").when(i.isin(15, 17), "words").when(i.isin(19, 20), "wide").when(i == 40, "phrase reversed").when(i == 41, "phrase").when(i == 42, "front coded").when(i == 43, "affix"),
        "dist_match": i == 36,
        "word_class": F.when(i == 38, True).when(i == 39, False),
        "state_map": F.when(i == 51, True).when(i == 52, False),
        "state_map_rep": i == 53,
        "reorder_parent": F.when(i >= 73, 54),
        "sse3": F.when((i == 54) | _between(i, (63, 68), (71, 87)), True).when(i == 55, False),
        "vocabulary": F.when(i == 91, "filter").when(i == 90, "rerank").otherwise("shipped"),
        "page_order": F.when(i >= 86, "full").otherwise(order),
        "corrector": i >= 86,
    }


def registry(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id int, name string")
    return rows.select("id", "name", *[c.alias(k) for k, c in stages(F.col("id")).items()])


REGISTRY_SQL = (
    "WITH m AS (SELECT i - 1 AS id, n[i] AS name FROM (SELECT " + str(NAMES) + " AS n), range(1, 96) r(i)), p AS (SELECT *, id = 35 OR id >= 51 AS p4 FROM m) SELECT id::INT AS id, name, p4 AS phase4, CASE id WHEN 3 THEN 'frequency' WHEN 7 THEN 'frequency' WHEN 4 THEN 'random' END AS permutation, "
    "CASE id WHEN 5 THEN 'parent' WHEN 7 THEN 'parent' WHEN 6 THEN 'unrelated' END AS inherit, CASE WHEN id IN (11, 13) THEN 'merge' WHEN id IN (12, 14) THEN 'mark' END AS case_kind, "
    "CASE WHEN p4 THEN 8 WHEN id BETWEEN 21 AND 25 THEN [6, 8, 12, 16, 24][id - 20] END AS match2_min, CASE WHEN p4 OR id = 26 THEN '4/1' WHEN id = 27 THEN '6/1' WHEN id = 28 THEN '6/2' END AS sparse_tier, "
    "CASE WHEN id BETWEEN 29 AND 32 THEN id - 28 ELSE 0 END AS ring, CASE WHEN p4 OR id = 33 THEN true WHEN id = 34 THEN false END AS match_byte, "
    "['pairs', 'pairs+mtf', 'maximal repeat', 'rule rank', 'first use', 'one shot'][CASE WHEN id BETWEEN 44 AND 49 THEN id - 43 END] AS grammar, id = 50 AS factors, id = 37 AS stems, "
    "name IN ('collision', 'collision-ctl', 'ppm', 'ppm-ctl', 'stem-model', 'stem-model-ctl', 'phase6', 'spine', 'residual', 'residual-ctl') OR name LIKE 'reorder-%' AS base6, "
    "p4 OR name IN ('struct-hoist', 'info-inherit', 'info-unrelated', 'dist-match', 'column-case', 'column-case-mark') OR name LIKE 'alphabet-%' OR name LIKE 'column%' OR name LIKE 'long-match%' OR name LIKE 'sparse-match%' OR name LIKE 'rep-state%' OR name LIKE 'match-byte%' OR name LIKE 'word-class%' AS hoists, "
    "CASE name WHEN 'residual-mtf' THEN 'front' WHEN 'residual-move-to-second' THEN 'second' WHEN 'residual-priced' THEN 'priced' WHEN 'residual-price-filter' THEN 'priced' WHEN 'residual-affix' THEN 'affix' WHEN 'residual-first-use' THEN 'first use' WHEN 'residual-subword' THEN 'subword' WHEN 'word-token' THEN 'words' WHEN 'column-word-token' THEN 'words' "
    "WHEN 'word-token2' THEN 'wide' WHEN 'column-word-token2' THEN 'wide' WHEN 'column-word-token-phrase' THEN 'phrase reversed' WHEN 'column-word-token-phrase-freq' THEN 'phrase' WHEN 'column-word-token-front' THEN 'front coded' WHEN 'column-word-token-affix' THEN 'affix' "
    "ELSE CASE WHEN p4 OR name IN ('word-token-reverse', 'column-word-token-reverse', 'dist-match') OR name LIKE 'long-match%' OR name LIKE 'sparse-match%' OR name LIKE 'rep-state%' OR name LIKE 'match-byte%' OR name LIKE 'word-class%' THEN 'reversed' END END AS token_kind, "
    "name = 'dist-match' AS dist_match, CASE name WHEN 'word-class' THEN true WHEN 'word-class-const' THEN false END AS word_class, CASE name WHEN 'state-map' THEN true WHEN 'state-map-ctl' THEN false END AS state_map, name = 'state-map-rep' AS state_map_rep, CASE WHEN name LIKE 'reorder-%' OR name LIKE 'residual%' THEN 54 END AS reorder_parent, "
    "CASE WHEN name = 'sse-3-ctl' THEN false WHEN name IN ('sse-3', 'collision', 'collision-ctl', 'ppm', 'ppm-ctl', 'stem-model', 'stem-model-ctl', 'phase6', 'spine', 'residual', 'residual-ctl') OR name LIKE 'reorder-%' THEN true END AS sse3, "
    "CASE id WHEN 91 THEN 'filter' WHEN 90 THEN 'rerank' ELSE 'shipped' END AS vocabulary, CASE WHEN id >= 86 THEN 'full' WHEN id BETWEEN 73 AND 85 THEN " + str(ORDERS) + "[id - 72] END AS page_order, id >= 86 AS corrector FROM p"
)


def experts(n: Column) -> list[Column]:
    """Table bits of the base roster: orders 0, 1-6, 8, 12, 16, word, word pair."""
    bits = F.when(n <= 2_000_000, 18).when(n <= 20_000_000, 20).when(n <= 200_000_000, 22).otherwise(24)
    return [F.least(bits, F.lit(20)), *[bits] * 9, *[F.least(bits, F.lit(22))] * 2]


def projection(sizes: DataFrame) -> DataFrame:
    """n, bits, model_bytes, encode_bytes, decode_bytes, fits (8 GiB) for input sizes n."""
    n, e = F.col("n"), experts(F.col("n"))
    two = lambda b: F.pow(F.lit(2.0), b).cast("bigint")
    model = sum((2 * two(b) for b in e[1:]), 2 * two(e[0])) + 4 * two(e[1]) + 132 * (4096 + 65536)
    s = sizes.select("n", e[1].alias("bits"), model.alias("model_bytes"))
    encode = 2 * n + F.floor(n / 3) + (1 << 20) + F.col("model_bytes")
    return s.select("n", "bits", "model_bytes", encode.alias("encode_bytes"), (3 * n + F.col("model_bytes")).alias("decode_bytes"), (encode <= 8 << 30).alias("fits"))

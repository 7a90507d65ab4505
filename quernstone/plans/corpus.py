"""Queries over the documents: segmentation, vocabularies, sequence statistics, page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators import layout, seqstats, vocab
from quernstone.operators import text as tx
from quernstone.operators.prefix import running
from quernstone.session import spread
from quernstone.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = lambda spark, d: f(spread(table(spark, d, "documents").select("doc_id", "text")))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


_VOCAB = """WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents WHERE text IS NOT NULL),
c AS (SELECT word, count(*) AS cnt FROM w GROUP BY word),
v AS (SELECT row_number() OVER (ORDER BY cnt DESC, word) AS id, word, cnt, cnt * (length(word) - 2) - (length(word) + 1) AS gain FROM c
WHERE length(word) >= 3 AND cnt >= 2 AND cnt * (length(word) - 2) - (length(word) + 1) > 0 QUALIFY id <= 255)
"""


def _vocab(d: DataFrame) -> DataFrame:
    return vocab.vocabulary(tx.word_counts(d))


@_query("SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def corpus_receipts(d):
    """Length and digest of every text."""
    return tx.texts(d).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))


@_query("""WITH t AS (SELECT doc_id, strlen(text) AS n, sum(strlen(text)) OVER (ORDER BY doc_id) AS upto FROM documents WHERE text IS NOT NULL)
SELECT rung, count(*) FILTER (upto <= rung) AS whole_docs, least(rung, max(upto))::BIGINT AS n_bytes FROM t, (VALUES (1000), (10000), (100000), (1000000)) AS r(rung) GROUP BY rung""")
def corpus_ladder(d):
    """Documents within prefixes of the corpus in document order; offsets from sums by blocks of ids."""
    return _ladder(d, (1000, 10000, 100000, 1000000))


@_query("""WITH t AS (SELECT doc_id, strlen(text) AS n, sum(strlen(text)) OVER (ORDER BY doc_id) AS upto FROM documents WHERE text IS NOT NULL)
SELECT rung, count(*) FILTER (upto <= rung) AS whole_docs, least(rung, max(upto))::BIGINT AS n_bytes FROM t, (VALUES (1000000), (10000000), (100000000), (1000000000)) AS r(rung) GROUP BY rung""")
def corpus_ladder_full(d):
    """The same for the rungs from 10^6 to 10^9 bytes."""
    return _ladder(d, (10**6, 10**7, 10**8, 10**9))


def _ladder(d: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    t = tx.texts(d).select("doc_id", F.octet_length("text").cast("bigint").alias("n"), F.floor(F.col("doc_id") / 4096).alias("block"))
    sums = t.groupBy("block").agg(F.sum("n").alias("b"))
    low, top = (d.agg(F.min("doc_id"), F.max("doc_id")).first() or (0, 0))
    low, top = ((low or 0) // 4096, (top or 0) // 4096)
    sums = running(sums.withColumn("_at", F.col("block") - low), "_at", top - low, total=F.col("b"), before=True).select("block", F.col("total_").alias("before"))
    upto = t.join(sums, "block").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("doc_id")))
    rungs = F.explode(F.array(*[F.lit(x) for x in sizes])).alias("rung")
    r = upto.select("upto", rungs).groupBy("rung").agg(F.count_if(F.col("upto") <= F.col("rung")).alias("whole_docs"), F.max("upto").alias("top"))
    return r.select("rung", "whole_docs", F.least("top", F.col("rung").cast("bigint")).alias("n_bytes"))


@_query("WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS cnt FROM w GROUP BY word")
def word_counts(d):
    return tx.word_counts(d)


@_query(_VOCAB + "SELECT id, word, cnt, gain FROM v")
def vocab_top255(d):
    return _vocab(d)


@_query(_VOCAB + "SELECT max(id) OVER () + 1 - id AS id, word, cnt, gain FROM v")
def vocab_reverse_ids(d):
    return vocab.reverse_ids(_vocab(d))


@_query(_VOCAB + """, p AS (SELECT word, coalesce(lag(word) OVER (ORDER BY word), '') AS b FROM v)
SELECT word, len(list_filter(range(1, length(word) + 1), lambda i: word[1:i] = b[1:i])) AS shared, word[len(list_filter(range(1, length(word) + 1), lambda i: word[1:i] = b[1:i])) + 1:] AS rest FROM p""")
def vocab_front_coding(d):
    return vocab.front_coding(_vocab(d))


@_query(_VOCAB + """, o AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents WHERE text IS NOT NULL))
SELECT id, word, doc_id, pos FROM (SELECT v.id, o.*, row_number() OVER (PARTITION BY o.word ORDER BY doc_id, pos) AS rn FROM o JOIN v USING (word)) WHERE rn = 1""")
def vocab_first_use(d):
    return vocab.first_use(d, _vocab(d))


_RUNS = "SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t, l FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') AS l FROM documents WHERE text IS NOT NULL)"


@_query(f"""WITH r AS ({_RUNS}), p AS (SELECT t AS phrase FROM r WHERE regexp_matches(t, '^[A-Za-z]') UNION ALL
SELECT t || ' ' || l[i + 2] FROM r WHERE regexp_matches(t, '^[A-Za-z]') AND l[i + 1] = ' ' AND i + 2 <= len(l)),
c AS (SELECT phrase AS word, count(*) AS cnt FROM p GROUP BY phrase)
SELECT row_number() OVER (ORDER BY cnt DESC, word) AS id, word, cnt, cnt * (length(word) - 2) - (length(word) + 1) AS gain FROM c
WHERE length(word) >= 3 AND cnt >= 2 AND cnt * (length(word) - 2) - (length(word) + 1) > 0 QUALIFY id <= 255""")
def phrase_counts(d):
    """The vocabulary of words and one-space pairs of words."""
    return vocab.vocabulary(tx.phrases(d).groupBy("phrase").agg(F.count("*").alias("cnt")).withColumnRenamed("phrase", "word"))


_TOK = tx.TOKEN_PLAIN.replace("'", "''")
_KIND = r"""CASE WHEN starts_with(token, '<!--') AND ends_with(token, '-->') AND length(token) >= 7 THEN 'comment' WHEN starts_with(token, '<?') AND ends_with(token, '?>') THEN 'pi' WHEN starts_with(token, '<![CDATA[') THEN 'cdata'
WHEN regexp_full_match(token, '</[A-Za-z:_][^>\n<]*>') THEN 'close_tag' WHEN regexp_full_match(token, '<[A-Za-z:_][^>\n<]*/>') THEN 'empty_tag' WHEN regexp_full_match(token, '<[A-Za-z:_][^>\n<]*>') THEN 'open_tag'
WHEN regexp_full_match(token, '&[A-Za-z0-9#]{1,33};') THEN 'entity' WHEN token = '{{' THEN 'template' WHEN token = '[[' THEN 'link' WHEN token = '{|' THEN 'table' WHEN regexp_matches(token, '^(https?|ftps?)://') THEN 'url'
WHEN regexp_matches(token, '^[A-Za-z]') THEN 'word' WHEN regexp_matches(token, '^[0-9]') THEN 'number' WHEN regexp_matches(token, '^[ \t]') THEN 'spaces' WHEN regexp_matches(token, '^[\r\n]') THEN 'newlines' WHEN regexp_matches(token, '^[!-~]') THEN 'punct' ELSE 'raw' END"""
_TOKENS = f"SELECT doc_id, generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS l FROM documents WHERE text != '')"


@_query(f"WITH t AS ({_TOKENS}) SELECT doc_id, count(*) AS n_tokens, sum(length(token))::BIGINT AS n_chars, sum(seq * length(token))::BIGINT AS fingerprint FROM t GROUP BY doc_id")
def token_partition(d):
    """Per text the number of tokens, their total length and a sum that depends on every boundary."""
    t = tx.texts(d).filter("text != ''").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(tx.TOKEN_PLAIN), F.lit(0)), lambda x: F.length(x).cast("bigint")).alias("l"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return t.select("doc_id", F.size("l").cast("bigint").alias("n_tokens"), total(F.col("l")).alias("n_chars"), total(F.transform("l", lambda v, i: v * i)).alias("fingerprint"))


@_query(f"WITH t AS ({_TOKENS}), k AS (SELECT {_KIND} AS kind, token FROM t) SELECT s.kind, count(k.token) AS n, coalesce(sum(strlen(token)), 0)::BIGINT AS n_bytes FROM (SELECT unnest({tx.KINDS}) AS kind) s LEFT JOIN k USING (kind) GROUP BY s.kind")
def kind_stats(d):
    return tx.kind_counts(tx.tokens(d, tx.TOKEN_PLAIN))


@_query(r"WITH e AS (SELECT unnest(regexp_extract_all(text, '&[A-Za-z0-9#]{1,33};')) AS entity FROM documents) SELECT entity, count(*) AS n FROM e GROUP BY entity")
def entity_counts(d):
    return tx.texts(d).select(F.explode(F.regexp_extract_all("text", F.lit("&[A-Za-z0-9#]{1,33};"), F.lit(0))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


@_query(r"WITH e AS (SELECT unnest(regexp_extract_all(text, '</?([A-Za-z:_][A-Za-z0-9:_-]*)[^>\n<]*>', 1)) AS tag FROM documents) SELECT tag, count(*) AS n FROM e GROUP BY tag")
def tag_counts(d):
    return tx.texts(d).select(F.explode(F.regexp_extract_all("text", F.lit(r"</?([A-Za-z:_][A-Za-z0-9:_-]*)[^>\n<]*>"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@_query("WITH e AS (SELECT unnest(regexp_extract_all(text, '(?:https?|ftps?)://([^/ \\t\\n\\f\\r<>\"\\]|]*)', 1)) AS host FROM documents) SELECT host, count(*) AS n FROM e GROUP BY host")
def url_hosts(d):
    return tx.texts(d).select(F.explode(F.regexp_extract_all("text", F.lit(r'(?:https?|ftps?)://([^/ \t\n\f\r<>"\]|]*)'), F.lit(1))).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


@_query("""WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS s FROM documents WHERE text != ''), c AS (SELECT ('0x' || s)::INT AS byte, count(*) AS cnt FROM b GROUP BY 1)
SELECT r.range::INT AS byte, coalesce(cnt, 0) AS cnt, row_number() OVER (ORDER BY coalesce(cnt, 0) DESC, r.range) - 1 AS code FROM range(256) r LEFT JOIN c ON c.byte = r.range""")
def byte_histogram_rank(d):
    return tx.byte_ranks(d)


@_query("WITH c AS (SELECT unnest(string_split(text, '')) AS symbol FROM documents WHERE text != '') SELECT symbol, count(*) AS cnt FROM c GROUP BY symbol")
def char_counts(d):
    return tx.symbol_counts(d)


def _entropy_sql(order: int, gap: int = 0) -> str:
    ctx = " || ".join(f"coalesce(l[CASE WHEN i - {gap + k} >= 1 THEN i - {gap + k} END], '')" for k in range(order, 0, -1)) or "''"
    return f"""WITH c AS (SELECT generate_subscripts(l, 1) AS i, l FROM (SELECT string_split(text, '') AS l FROM documents WHERE text != '')), e AS (SELECT {ctx} AS ctx, l[i] AS sym FROM c),
p AS (SELECT ctx, sym, count(*) AS n FROM e GROUP BY ctx, sym), o AS (SELECT ctx, sum(n) AS t, count(*) AS k, sum(n * log2(n)) AS s FROM p GROUP BY ctx)
SELECT count(*) AS contexts, sum(k)::BIGINT AS pairs, sum(t)::BIGINT AS total, round(sum(t * log2(t) - s), 2) AS bits FROM o"""


@_query(_entropy_sql(0))
def order0_entropy(d):
    return seqstats.entropy(seqstats.context_counts(d, 0))


@_query(_entropy_sql(1))
def order1_entropy(d):
    return seqstats.entropy(seqstats.context_counts(d, 1))


@_query(_entropy_sql(2))
def order2_entropy(d):
    return seqstats.entropy(seqstats.context_counts(d, 2))


@_query(_entropy_sql(3, 1))
def sparse_entropy(d):
    """Three characters that end one before the predicted one."""
    return seqstats.entropy(seqstats.context_counts(d, 3, 1))


@_query("WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT CASE WHEN regexp_full_match(w, '[a-z]+') THEN 0 WHEN regexp_full_match(w, '[A-Z][a-z]*') THEN 1 WHEN regexp_full_match(w, '[A-Z]+') THEN 2 ELSE 3 END AS case_class, count(*) AS n FROM w GROUP BY 1")
def case_classes(d):
    return tx.words(d).groupBy(tx.case_class(F.col("word")).alias("case_class")).agg(F.count("*").alias("n"))


@_query("""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents), s AS (SELECT w, length(w) AS n FROM w),
t AS (SELECT w, CASE WHEN n > 5 AND w LIKE '%ingly' THEN w[:n-5] WHEN n > 4 AND (w LIKE '%ies' OR w LIKE '%ing' OR w LIKE '%ely') THEN w[:n-3] WHEN n > 4 AND w LIKE '%ly' THEN w[:n-2]
WHEN n > 3 AND (w LIKE '%ed' OR w LIKE '%es') THEN w[:n-2] WHEN n > 2 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:n-1] ELSE w END AS stem FROM s)
SELECT stem, count(*) AS n, count(DISTINCT w) AS forms FROM t GROUP BY stem""")
def stem_groups(d):
    w = tx.words(d).select(F.lower("word").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.groupBy(tx.model_stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


_CLASS = "CASE " + " ".join(f"WHEN lower(w) IN ({', '.join(repr(x) for x in ws)}) THEN {k}" for k, ws in tx.FUNCTION_WORDS.items()) + " ELSE 0 END"


@_query(f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT doc_id, {_CLASS} AS word_class, count(*) AS n FROM w GROUP BY ALL")
def function_words(d):
    return tx.words(d).groupBy("doc_id", tx.word_class(F.col("word")).alias("word_class")).agg(F.count("*").alias("n"))


_SUF = "coalesce(" + ", ".join(f"CASE WHEN length(w) >= {len(s) + 2} AND ends_with(w, '{s}') THEN '{s}' END" for s in sorted(tx.SUFFIXES, key=lambda s: -len(s))) + ")"


@_query(f"WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT coalesce({_SUF}, '') AS suffix, count(*) AS n FROM w GROUP BY 1")
def suffix_census(d):
    return tx.words(d).groupBy(F.coalesce(tx.longest_suffix(F.col("word")), F.lit("")).alias("suffix")).agg(F.count("*").alias("n"))


_LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


@_query(f"WITH t AS ({_LINES}) SELECT doc_id, line_no, length(line) AS len, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1)::BIGINT AS start FROM t")
def line_offsets(d):
    return tx.line_offsets(d)


@_query(f"""WITH t AS ({_LINES}), c AS (SELECT doc_id, line_no, generate_subscripts(l, 1) AS col, unnest(l) AS sym FROM (SELECT doc_id, line_no, string_split(line, '') AS l FROM t WHERE line != ''))
SELECT a.col - 1 AS col, count(*) AS n, count(b.sym) AS with_above, count(*) FILTER (a.sym = b.sym) AS agreeing FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND a.col = b.col AND b.line_no = a.line_no - 1 GROUP BY a.col""")
def column_above_agreement(d):
    return seqstats.column_agreement(d)


@_query("""WITH c AS (SELECT doc_id, unnest(range(9, length(text) + 2)) AS pos, text FROM documents WHERE length(text) >= 8), e AS (SELECT doc_id, pos - 1 AS pos, substring(text, pos - 8, 8) AS ctx FROM c),
r AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id, ctx ORDER BY pos) AS distance FROM e)
SELECT doc_id, count(*) AS repeats, sum(distance)::BIGINT AS total_distance, min(distance) AS nearest FROM r WHERE distance IS NOT NULL GROUP BY doc_id""")
def repeat_distance_k8(d):
    return seqstats.repeat_summary(d, 8)


@_query("""WITH c AS (SELECT generate_subscripts(l, 1) AS i, l FROM (SELECT string_split(text, '') AS l FROM documents WHERE length(text) > 1)), p AS (SELECT l[i] AS a, l[i + 1] AS b FROM c WHERE i < len(l))
SELECT a, b, count(*) AS cnt FROM p GROUP BY a, b HAVING count(*) >= 8 ORDER BY cnt DESC, a, b LIMIT 256""")
def pair_counts_top(d):
    """The pairs of a one-shot pair grammar."""
    return vocab.pair_counts(d).filter("cnt >= 8").orderBy(F.desc("cnt"), "a", "b").limit(256)


@_query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), t AS (SELECT string_split(word, '') AS l, count(*) AS n FROM w GROUP BY word),
c AS (SELECT generate_subscripts(l, 1) AS i, l, n FROM t), p AS (SELECT l[i] AS a, l[i + 1] AS b, n FROM c WHERE i < len(l))
SELECT a, b, sum(n)::BIGINT AS cnt FROM p GROUP BY a, b ORDER BY cnt DESC, a, b LIMIT 1""")
def bpe_first_merge(d):
    return vocab.type_pair_counts(tx.word_counts(d)).orderBy(F.desc("cnt"), "a", "b").limit(1)


_HOIST = "|".join("".join("\\" + c if c in "{}[]|.&#/" else c for c in s) for s in sorted(tx.HOISTED, key=lambda s: (-len(s), s)))


@_query(f"""SELECT doc_id, (coalesce(list_sum([strlen(x) - 1 for x in regexp_extract_all(text, '({_HOIST})', 1)]), 0) - len(regexp_extract_all(text, '[\\x00-\\x1F\\x7F]')))::BIGINT AS saved FROM documents WHERE text IS NOT NULL""")
def hoist_savings(d):
    return tx.texts(d).select("doc_id", vocab.hoist_saving(F.col("text")).cast("bigint").alias("saved"))


@_query(_VOCAB + ", o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS uses, sum(length(word) - 2)::BIGINT AS saved FROM o JOIN v USING (word) GROUP BY doc_id")
def token_savings(d):
    return vocab.token_savings(d, _vocab(d))


@_query("""WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS i, l FROM (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE text != '')),
e AS (SELECT doc_id, coalesce(l[CASE WHEN i > 2 THEN i - 2 END], '') || coalesce(l[CASE WHEN i > 1 THEN i - 1 END], '') || chr(9) || l[i] AS e FROM c)
SELECT d.doc_id, count(DISTINCT e) AS novelty FROM documents d LEFT JOIN e USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def novelty_exact(d):
    return seqstats.novelty(d).withColumn("novelty", F.col("novelty").cast("bigint"))


@_query("""WITH w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(md5('0' || w)) AS s0, min(md5('1' || w)) AS s1, min(md5('2' || w)) AS s2, min(md5('3' || w)) AS s3 FROM w GROUP BY doc_id""")
def minhash_md5(d):
    w = tx.texts(d).select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower))).alias("w"))
    return w.groupBy("doc_id").agg(*[F.min(F.md5(F.concat(F.lit(str(k)), "w"))).alias(f"s{k}") for k in range(4)])


@_query("""WITH b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS s FROM documents WHERE text != ''), c AS (SELECT s AS symbol, count(*) AS cnt FROM b GROUP BY 1),
f AS (SELECT symbol, cnt, greatest(cnt * 4096 // (SELECT sum(cnt) FROM c)::BIGINT, 1) AS f FROM c), g AS (SELECT symbol, cnt, f + CASE WHEN row_number() OVER (ORDER BY f DESC, symbol DESC) = 1 THEN 4096 - (SELECT sum(f) FROM f) ELSE 0 END AS freq FROM f)
SELECT symbol, cnt, freq::INT AS freq, (sum(freq) OVER (ORDER BY symbol) - freq)::INT AS cum FROM g""")
def rans_table(d):
    return seqstats.normalized_frequencies(tx.symbol_counts(d, "byte"), "symbol")


_PAGES = r"""WITH p AS (SELECT doc_id AS pos, TRY_CAST(regexp_extract(text, '<id>([0-9]+)</id>', 1) AS BIGINT) AS page_id, regexp_extract(text, '<title>([^<]*)</title>', 1) AS title,
list_sort(list_distinct([lower(x) for x in regexp_extract_all(text, '(?i)\[\[category:([^|\]\n]*)', 1)])) AS cats, list_sort(list_distinct([lower(x) for x in regexp_extract_all(text, '\{\{([^|}\n]*)', 1)])) AS temps,
lower(regexp_extract(text, '(?i)\[\[category:([^|\]\n]*)', 1)) AS cat, lower(regexp_extract(text, '\{\{([^|}\n]*)', 1)) AS temp, strlen(text) AS n FROM documents WHERE contains(text, '<page>'))
"""


@_query(_PAGES + "SELECT pos, page_id, title, array_to_string(cats, '|') AS categories, array_to_string(temps, '|') AS templates, cat AS first_category, temp AS first_template, n AS n_bytes FROM p")
def page_metadata(d):
    p = layout.pages(d).drop("text")
    return p.withColumns({"categories": F.array_join("categories", "|"), "templates": F.array_join("templates", "|"), "n_bytes": F.col("n_bytes").cast("bigint")})


_NS = "CASE WHEN contains(title, ':') THEN CASE lower(split_part(title, ':', 1)) " + " ".join(f"WHEN '{n.lower()}' THEN {k}" for k, n in enumerate(layout.NAMESPACES, 1)) + " ELSE 0 END ELSE 0 END"
_SET = "array_to_string({}, chr(0))"
_ORDERS = {
    "identity": "pos",
    "title": "title, pos",
    "size": "n, page_id, pos",
    "namespace": f"{_NS}, title, pos",
    "category": "cat, title, pos",
    "template": "temp, title, pos",
    "category_set": f"{_SET.format('cats')}, title, pos",
    "full": f"{_SET.format('cats')}, {_SET.format('temps')}, title, pos",
    "shuffle": "sha256(pos::VARCHAR), pos",
}
for _name, _keys in _ORDERS.items():
    _Q[f"page_order_{_name}"] = lambda spark, d, o=_name: layout.ordered(layout.pages(table(spark, d, "documents")), o)
    _SQL[f"page_order_{_name}"] = _PAGES + f"SELECT pos, row_number() OVER (ORDER BY {_keys}) - 1 AS place FROM p"


@_query(_PAGES + "SELECT count(*) AS n_pages, (count(page_id) = count(*) AND count(*) FILTER (page_id <= before) = 0) AS ascending, ceil((SELECT sum(log2(i)) FROM range(2, (SELECT count(*) FROM p) + 1) r(i)) / 8)::BIGINT AS permutation_bytes FROM (SELECT page_id, lag(page_id) OVER (ORDER BY pos) AS before FROM p)")
def layout_info(d):
    """Whether every page has an id and ids ascend strictly, and what an explicit order would cost.
    Neighbours are compared within ranges of positions and across the ranges' ends."""
    p = layout.pages(d).select("pos", "page_id").withColumn("block", F.floor(F.col("pos") / 4096))
    inner = F.lag("page_id").over(Window.partitionBy("block").orderBy("pos"))
    b = p.withColumn("bad", F.col("page_id") <= inner).groupBy("block").agg(F.count("*").alias("n"), F.count("page_id").alias("ids"), F.count_if("bad").alias("bad"), F.min_by("page_id", "pos").alias("first"), F.max_by("page_id", "pos").alias("last"))
    low, top = (p.agg(F.min("block"), F.max("block")).first())
    ends = running(b.withColumn("_at", F.col("block") - (low or 0)), "_at", (top or 0) - (low or 0), last=F.col("last"), before=True)
    ends = ends.withColumn("bad", F.col("bad") + F.when(F.col("first") <= F.col("last_"), 1).otherwise(0))
    t = ends.agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.sum("bad").alias("bad"))
    logs = layout.permutation_bytes(d.sparkSession, p.count())
    return t.select(F.col("n").alias("n_pages"), ((F.col("ids") == F.col("n")) & (F.col("bad") == 0)).alias("ascending"), F.lit(logs).alias("permutation_bytes"))


@_query(_PAGES + "SELECT pos, row_number() OVER (ORDER BY coalesce(page_id, 9223372036854775807), pos) - 1 AS place FROM p")
def restore_order(d):
    """The original order from any other: by id, missing ids last, then by position."""
    p = layout.pages(d).select("pos", F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("k"))
    return layout.rank_all(p, ["k", "pos"]).select("pos", "place")


@_query(r"""WITH p AS (SELECT doc_id, text, split_part(text, '<page>', 1) AS header FROM documents WHERE contains(text, '<page>')), s AS (SELECT doc_id, text, header, regexp_extract_all(text[length(header) + 1:], '([\s\S]*?</page>)', 1) AS pages FROM p),
u AS (SELECT *, length(header) + coalesce(list_sum([length(x) for x in pages]), 0) AS used FROM s) SELECT doc_id, length(header) AS header, len(pages) AS pages, (length(text) - used)::BIGINT AS tail, header || array_to_string(pages, '') || text[(used + 1)::BIGINT:] = text AND len(pages) > 0 AS tiles FROM u""")
def page_tiling(d):
    """Header, pages and tail of every dump text, and whether they tile it."""
    s = layout.split_stream(d)
    return s.select("doc_id", F.length("header").alias("header"), F.size("pages").alias("pages"), F.length("tail").cast("bigint").alias("tail"), "tiles")


def _escape_sql(order: int) -> str:
    head = _entropy_sql(order).split(", o AS")[0]
    return head + " SELECT count(*) AS contexts, round(sum(s * 1.0 / (s + t)) / count(*), 6) AS mean_escape, count(*) FILTER (s = 1) AS settled FROM (SELECT ctx, sum(n) AS t, count(*) AS s FROM p GROUP BY ctx)"


@_query(_escape_sql(2))
def ppm_escapes(d):
    """Contexts of two characters: the mean probability of a new symbol, and those with one symbol."""
    e = seqstats.escapes(seqstats.context_counts(d, 2))
    return e.agg(F.count("*").alias("contexts"), F.round(F.sum("escape") / F.count("*"), 6).alias("mean_escape"), F.count_if(F.col("symbols") == 1).alias("settled"))


@_query("""WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS i, l FROM (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE length(text) > 2)), e AS (SELECT doc_id, i, l[i - 2] || l[i - 1] AS ctx, l[i] AS sym FROM c WHERE i > 2),
h AS (SELECT ctx, sym, coalesce(lag(sym, 2) OVER w, '') || coalesce(lag(sym) OVER w, '') AS last FROM e WINDOW w AS (PARTITION BY doc_id, ctx ORDER BY i)) SELECT last, count(*) AS n, count(DISTINCT ctx) AS contexts FROM h GROUP BY last""")
def indirect_history(d):
    """Symbols by the two that last followed their context."""
    return seqstats.indirect(d).groupBy("last").agg(F.sum("n").alias("n"), F.countDistinct("ctx").alias("contexts"))


@_query("""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, l FROM (SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '[A-Za-z'']+')] AS l FROM documents WHERE text IS NOT NULL))
SELECT coalesce(l[CASE WHEN i > 1 THEN i - 1 END], '') AS before, l[i] AS word, count(*) AS n FROM w GROUP BY ALL""")
def word_bigrams(d):
    return seqstats.word_positions(d).groupBy("before", "word").agg(F.count("*").alias("n"))


@_query("""SELECT name, count(DISTINCT sha256(text)) = 1 AS one_digest, count(*) AS n FROM (SELECT 'blank' AS name, text FROM documents WHERE text = '' UNION ALL SELECT 'text', '' FROM documents WHERE text != '') GROUP BY name""")
def pinned_digest(d):
    """Digest verification against a pinned value: empty texts have the known digest of no bytes."""
    pinned = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    t = tx.texts(d).select(F.when(F.col("text") == "", "blank").otherwise("text").alias("name"), F.sha2("text", 256).alias("h"))
    return t.groupBy("name").agg(F.bool_and(F.when(F.col("name") == "blank", F.col("h") == pinned).otherwise(True)).alias("one_digest"), F.count("*").alias("n"))


_SQL["page_order_full_novelty"] = _PAGES[: _PAGES.rindex("FROM documents")] + """, text FROM documents WHERE contains(text, '<page>')), c AS (SELECT pos, generate_subscripts(l, 1) AS i, l FROM (SELECT pos, string_split(text, '') AS l FROM p)),
v AS (SELECT pos, count(DISTINCT coalesce(l[CASE WHEN i > 2 THEN i - 2 END], '') || coalesce(l[CASE WHEN i > 1 THEN i - 1 END], '') || chr(9) || l[i]) AS novelty FROM c GROUP BY pos)
""" + f"SELECT pos, row_number() OVER (ORDER BY {_SET.format('cats')}, {_SET.format('temps')}, novelty, title, pos) - 1 AS place FROM p JOIN v USING (pos)"


@_query(_SQL["page_order_full_novelty"])
def page_order_full_novelty(d):
    """The full order with the novelty of each page before its title."""
    p = layout.pages(d).join(seqstats.novelty(d.filter(F.col("text").contains("<page>"))).withColumnRenamed("doc_id", "pos"), "pos")
    return layout.ordered(p, "full_novelty")


@_query()
def boilerplate_order(d):
    """Places by signatures of the markup names that a page uses."""
    return layout.rank_all(layout.boilerplate_signatures(d), ["sig", "doc_id"]).select("doc_id", "place")


@_query()
def minhash_order(d):
    """Places by exact 64-bit signatures."""
    return layout.rank_all(layout.signatures(d), ["sig", "doc_id"]).select("doc_id", "place")


@_query()
def greedy_order(d):
    return layout.greedy_walk(layout.signatures(d))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

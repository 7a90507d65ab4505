"""Typed segmentation of markup text, words, symbols and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import per_text

#: Segmentation of markup text; the order of the alternatives is their precedence.
TOKEN = (
    r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!\[CDATA\[[\s\S]*?\]\]>|</?[A-Za-z:_][^>\n<]*>"
    r"|&(?=[A-Za-z0-9#]{1,33};)(?:#[xX]?+)?+[A-Za-z0-9#]++;"
    r"|(?=[\s\S]{7})(?:https?|ftps?)://[^ \t\n\f\r<>\"\]|]*"
    r"|[A-Za-z]+|[0-9]+|[ \t]+|[\r\n]+|\{\{|\[\[|\{\|"
    r"|[!-~](?:(?![A-Za-z0-9<&\[{])[!-~])*|[\s\S][^\x00-\x7F]*"
)
#: The same without lookahead, for engines that lack it; equal but for `&#;` and a final `ftp://`.
TOKEN_PLAIN = (
    r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!\[CDATA\[[\s\S]*?\]\]>|</?[A-Za-z:_][^>\n<]*>"
    r"|&[A-Za-z0-9#]{1,33};|(?:https?|ftps?)://[^ \t\n\f\r<>\"\]|]*"
    r"|[A-Za-z]+|[0-9]+|[ \t]+|[\r\n]+|\{\{|\[\[|\{\|"
    r"|[!-~][!-%\x27-/:;=-@\\-`|-~]*|[\s\S][^\x00-\x7F]*"
)
#: Suffixes of the stem transform, longest match wins.
SUFFIXES = ["ation", "ition", "sion", "tion", "ness", "ment", "able", "ible", "less", "ing", "est", "ity", "ive", "ous", "ful", "ly", "es", "ed", "er", "s"]
#: The strings that the structural hoist replaces by the codes 1 to 31.
HOISTED = [
    "<page>", "</page>", "<title>", "</title>", "<text", "</text>", "<revision>", "</revision>", "<id>", "</id>", "<timestamp>", "</timestamp>", "<contributor>", "</contributor>", "<username>", "</username>",
    "<comment>", "</comment>", "<minor />", "&amp;", "&quot;", "&lt;", "&gt;", "&#", "{{", "}}", "[[", "]]", "http://", "https://", "</mediawiki>",
]
#: Closed-class words; 1 determiners, 2 conjunctions and prepositions, 3 pronouns, 4
#: auxiliaries.
FUNCTION_WORDS = {
    1: ["the", "a", "an", "this", "that", "these", "those", "its", "their", "his", "her", "our", "your", "my", "some", "any", "no", "every", "each", "all", "both", "such"],
    2: ["and", "or", "but", "nor", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "into", "over", "under", "about", "after", "before", "between", "during", "through", "against", "among", "up", "down", "out", "off", "than", "if", "because", "while", "when", "where"],
    3: ["i", "he", "she", "it", "we", "they", "you", "me", "him", "us", "them", "who", "which", "whom", "whose"],
    4: ["is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must"],
}
KINDS = ["comment", "pi", "cdata", "close_tag", "empty_tag", "open_tag", "entity", "template", "link", "table", "url", "word", "number", "spaces", "newlines", "punct", "raw"]


def texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")


def words(documents: DataFrame) -> DataFrame:
    """doc_id, pos, word: the maximal runs of ASCII letters, in order."""
    return texts(documents).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "word"))


def word_counts(documents: DataFrame) -> DataFrame:
    return words(documents).groupBy("word").agg(F.count("*").alias("cnt"))


def phrases(documents: DataFrame) -> DataFrame:
    """Words and pairs of neighbours with exactly one space between them (pairs overlap). Works on
    each text's array of runs, so nothing is shuffled before the count."""
    runs = texts(documents).select(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)).alias("r"))
    at = lambda i, k: F.get("r", i + k)
    pair = F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.when(at(i, 0).rlike("^[A-Za-z]") & (at(i, 1) == " ") & at(i, 2).rlike("^[A-Za-z]"), F.concat(at(i, 0), F.lit(" "), at(i, 2))))
    one = F.filter("r", lambda x: x.rlike("^[A-Za-z]"))
    return runs.filter(F.size("r") > 0).select(F.explode(F.concat(one, F.filter(pair, lambda x: x.isNotNull()))).alias("phrase"))


def tokens(documents: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """doc_id, seq, token, start, len (characters), kind: a partition of every text. Balanced
    constructs count by their opening marks here; `markup.segment` gives them whole."""
    t = texts(documents).filter("text != ''").select("doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("t"))
    rows = t.select("doc_id", F.posexplode("t").alias("seq", "token")).withColumn("len", F.length("token"))
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0))).withColumn("kind", kind(F.col("token")))


def kind(t: Column) -> Column:
    """The kind of a token by its first and last marks."""
    return (
        F.when(t.startswith("<!--") & t.endswith("-->") & (F.length(t) >= 7), "comment")
        .when(t.startswith("<?") & t.endswith("?>"), "pi")
        .when(t.startswith("<![CDATA["), "cdata")
        .when(t.rlike(r"^</[A-Za-z:_][^>\n<]*>$"), "close_tag")
        .when(t.rlike(r"^<[A-Za-z:_][^>\n<]*/>$"), "empty_tag")
        .when(t.rlike(r"^<[A-Za-z:_][^>\n<]*>$"), "open_tag")
        .when(t.rlike(r"^&[A-Za-z0-9#]{1,33};$"), "entity")
        .when(t == "{{", "template")
        .when(t == "[[", "link")
        .when(t == "{|", "table")
        .when(t.rlike(r"^(https?|ftps?)://"), "url")
        .when(t.rlike("^[A-Za-z]"), "word")
        .when(t.rlike("^[0-9]"), "number")
        .when(t.rlike("^[ \t]"), "spaces")
        .when(t.rlike("^[\r\n]"), "newlines")
        .when(t.rlike("^[!-~]"), "punct")
        .otherwise("raw")
    )


def kind_counts(toks: DataFrame) -> DataFrame:
    """Tokens and bytes of each kind; kinds that don't occur have zeros."""
    spark = toks.sparkSession
    every = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    got = toks.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("n_bytes"))
    return every.join(got, "kind", "left").na.fill(0)


def case_class(w: Column) -> Column:
    """0 lower, 1 Title (also one capital), 2 UPPER, 3 mixed."""
    return F.when(w.rlike("^[a-z]+$"), 0).when(w.rlike("^[A-Z][a-z]*$"), 1).when(w.rlike("^[A-Z]+$"), 2).otherwise(3)


def word_class(w: Column) -> Column:
    """Class of a function word in any case, 0 for others."""
    out = F.lit(0)
    for k, ws in FUNCTION_WORDS.items():
        out = F.when(F.lower(w).isin(ws), k).otherwise(out)
    return out


def model_stem(w: Column) -> Column:
    """Conservative stem of a lower-case word: the first rule that fits and leaves enough."""
    n, cut = F.length(w), lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    return (
        F.when((n > 5) & w.endswith("ingly"), cut(5))
        .when((n > 4) & (w.endswith("ies") | w.endswith("ing") | w.endswith("ely")), cut(3))
        .when((n > 4) & w.endswith("ly"), cut(2))
        .when((n > 3) & (w.endswith("ed") | w.endswith("es")), cut(2))
        .when((n > 2) & w.endswith("s") & ~w.endswith("ss"), cut(1))
        .otherwise(w)
    )


def longest_suffix(w: Column) -> Column:
    """The longest known suffix that leaves a stem of two letters, or null."""
    by_length = sorted(SUFFIXES, key=lambda s: -len(s))
    return F.coalesce(*[F.when((F.length(w) >= len(s) + 2) & w.endswith(s), s) for s in by_length])


def symbol_counts(documents: DataFrame, unit: str = "char") -> DataFrame:
    """symbol, cnt over all texts: characters, or bytes as two hexadecimal digits."""
    t = texts(documents)
    parts = F.split("text", "") if unit == "char" else F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))
    return t.filter("text != ''").select(F.explode(parts).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("cnt"))


def byte_ranks(documents: DataFrame) -> DataFrame:
    """All 256 bytes with counts and frequency rank (code 0 is the most frequent; ties by byte)."""
    got = symbol_counts(documents, "byte").select(F.conv("symbol", 16, 10).cast("int").alias("byte"), "cnt")
    every = documents.sparkSession.range(256).select(F.col("id").cast("int").alias("byte")).join(got, "byte", "left").na.fill(0)
    return every.withColumn("code", F.row_number().over(Window.orderBy(F.desc("cnt"), "byte")) - 1)  # 256 rows


def line_offsets(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, len, start (characters) of every line; each text is cut in place: no shuffle."""

    def run(data: bytes) -> list[tuple]:
        out, at = [], 0
        for k, line in enumerate(data.decode().split("\n")):
            out.append((k, len(line), at))
            at += len(line) + 1
        return out

    return per_text(texts(documents), run, "line_no int, len int, start bigint")

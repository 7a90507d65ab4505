"""Queries p1 to p5: quality of the receipt tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.numbers import name_key, whole_number
from quernstone.operators import drift, hierarchy, orphans, packed, topn
from quernstone.session import spread, stage
from quernstone.sources.tables import table

RATE_MARKS = ",;|/:"
TEXT_MARKS = ",;|"


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References and targets of both receipt tables under one key: (kind, name, corpus, tune)."""
    trials, gates, methods = (table(spark, sf_dir, t) for t in ("phase9_tune", "tune53", "methods"))
    none = F.lit(None)
    base = lambda name: [F.lit(name).alias("table_name"), "log_pos", F.date_format("logged_at", "yyyy-MM").alias("period"), F.col("arrived_at").alias("at")]

    def key(kind, a, b=none, c=none):
        return F.when(a.isNotNull(), F.struct(F.lit(kind).alias("kind"), a.alias("name"), F.coalesce(b, F.lit("")).cast("string").alias("corpus"), F.coalesce(c, F.lit(-1)).cast("bigint").alias("tune"))).alias("key")

    trial_key = lambda method, tune: F.when(tune.isNotNull(), key("trial", F.coalesce(name_key(method), F.lit("")), name_key(F.col("corpus")), tune)).alias("key")
    refs = trials.select(*base("phase9_tune"), key("method", name_key(F.col("parent")))).unionByName(gates.select(*base("tune53"), trial_key(F.col("parent"), whole_number(F.col("parent_tune")))))
    there = methods.select(key("method", name_key(F.col("method"))), F.col("registered_at").alias("since"), F.col("removed_at").alias("until"))
    there = there.unionByName(trials.select(trial_key(F.col("method"), whole_number(F.col("tune"))), F.col("arrived_at").alias("since"), F.col("withdrawn_at").alias("until")))
    return refs, there


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of phase9_tune.parent and tune53.parent_tune that have no live target."""
    return orphans.find_orphans(*_references(spark, sf_dir)).select("table_name", "log_pos", "period", "reason")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references by table, month and reason."""
    return orphans.count_orphans(*_references(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per corpus the five trials with the fewest archive_bytes; copies count once."""
    t = table(spark, sf_dir, "phase9_tune").select("corpus", "archive_sha256", "log_pos", whole_number(F.col("archive_bytes")).alias("size"), whole_number(F.col("tune")).alias("tune_no"))
    # the copy with the smallest log_pos stands for all; texts without digest are no copies
    digest = F.coalesce(F.nullif("archive_sha256", F.lit("")), F.concat(F.lit("row "), "log_pos"))
    t = t.filter("trim(corpus) != ''").groupBy("corpus", digest.alias("digest")).agg(F.min_by(F.struct("log_pos", "size", "tune_no"), "log_pos").alias("r"))
    t = stage(t.select("corpus", "r.log_pos", "r.size", "r.tune_no").filter("size > 0 AND tune_no IS NOT NULL"))
    return topn.top_n(t, "corpus", ["size", "tune_no", "log_pos"], 5).select("corpus", "place", "log_pos")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each log file's fields against the file before it."""
    return drift.schema_changes(spread(table(spark, sf_dir, "receipt_lines")))


#: Columns of the consistent table of receipts.
_TEXTS = ["id", "hypothesis", "parent", "revision", "compiler", "corpus", "input_sha256", "archive_sha256", "decoded_sha256", "environment", "attribution", "decision", "notes", "method", "mixer_lr", "apm_sel", "apm_rates", "phase", "parent_source"]
_LONGS = ["compressor_bytes", "archive_bytes", "score_total", "peak_rss_bytes", "temp_disk_bytes", "tune", "lr_idx", "parent_tune", "parent_archive_bytes"]
RECEIPT_TYPES = dict.fromkeys(_TEXTS, "string") | dict.fromkeys(_LONGS, "bigint") | dict.fromkeys(["wall_seconds", "cpu_seconds", "bits_per_byte"], "double") | dict.fromkeys(["exact", "parent_exact"], "boolean")


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All receipts of the raw logs in one consistent table with typed columns; what they don't hold
    is in `rest`."""
    lines = spread(table(spark, sf_dir, "receipt_lines"))
    known = drift.profile(lines)
    return drift.unified(lines, stage(drift.migrations(known, drift.schema_changes(known))), RECEIPT_TYPES)


def p3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renames, casts and defaults that bring each file into that table, with their records."""
    known = drift.profile(spread(table(spark, sf_dir, "receipt_lines")))
    return drift.applied_steps(known, drift.migrations(known, drift.schema_changes(known)), RECEIPT_TYPES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values packed in attribution and apm_rates, one per row."""
    t = spread(table(spark, sf_dir, "phase9_tune").select("log_pos", "attribution", "apm_rates"))
    return packed.split_packed(t, "log_pos", {"attribution": TEXT_MARKS, "apm_rates": RATE_MARKS})


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and parent id of phase6_receipts: the row with the largest log_pos decides; a parent
    without slashes is a candidate in the id's own series and size."""
    t = table(spark, sf_dir, "phase6_receipts").select("id", "parent", "log_pos").filter("id IS NOT NULL")
    t = t.groupBy("id").agg(F.max_by(F.struct("parent"), "log_pos").alias("r")).select("id", "r.parent")
    name, seg = name_key(F.col("parent")), F.split("id", "/")
    own = F.concat_ws("/", F.get(seg, F.lit(0)), name, F.get(seg, F.lit(2)))
    t = t.select("id", F.when(name.contains("/"), name).when(name.isNotNull(), F.lower(own)).alias("ref"))
    known = t.groupBy(name_key(F.col("id")).alias("ref")).agg(F.min("id").alias("parent"))
    return t.join(known, "ref", "left").select("id", "parent")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every candidate receipt; depth -1 where the walk never ends."""
    return hierarchy.hierarchy(links(spark, sf_dir)).select("id", "root_id", "depth")


def p5_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every candidate receipt."""
    placed = stage(hierarchy.hierarchy(links(spark, sf_dir)))
    return placed.join(hierarchy.paths(placed), "id").select("id", "root_id", "depth", (F.col("size") - 1).alias("n_descendants"), F.array_join("path", " > ").alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descendant of every root, with its number of steps."""
    placed = stage(hierarchy.hierarchy(links(spark, sf_dir)))
    return hierarchy.descendants(placed, placed.filter("depth = 0"))


def p5_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descendant of every candidate receipt, inner nodes and nodes on or under cycles included."""
    placed = stage(hierarchy.hierarchy(links(spark, sf_dir)))
    return hierarchy.descendants(placed, placed.select("id")).unionByName(hierarchy.descendants_on_cycles(placed))


#: A DuckDB macro-free form of whole_number for the notations of the tables.
def _number(c: str) -> str:
    s = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    bare = f"regexp_replace(regexp_replace({s}, '\\s*([bB][yY][tT][eE][sS]?|[bB])$', ''), '(^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\\.0*)?$)|(^[+-]?[0-9]{{1,3}}( [0-9]{{3}})+$)|(^[+-]?[0-9]+(_[0-9]+)+$)', '\\0')"
    plain = f"CASE WHEN regexp_full_match({bare}, '[+-]?[0-9]{{1,3}}((,[0-9]{{3}})+|( [0-9]{{3}})+|(_[0-9]{{3}})+)') THEN regexp_replace({bare}, '[,_ ]', '', 'g') WHEN regexp_full_match({bare}, '[+-]?[0-9]+(\\.0*)?') THEN split_part({bare}, '.', 1) END"
    return f"CASE WHEN regexp_full_match({s}, '0[xX][0-9a-fA-F]+') THEN TRY_CAST('0x' || {s}[3:] AS BIGINT) ELSE TRY_CAST({plain} AS BIGINT) END"


_NAME = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_P1 = f"""WITH refs AS (SELECT 'phase9_tune' AS table_name, log_pos, strftime(logged_at, '%Y-%m') AS period, arrived_at AS at, 'm:' || {_NAME.format('parent')} AS key FROM phase9_tune
UNION ALL SELECT 'tune53', log_pos, strftime(logged_at, '%Y-%m'), arrived_at, 't:' || coalesce({_NAME.format('parent')}, '') || ':' || coalesce({_NAME.format('corpus')}, '') || ':' || {_number('parent_tune')} FROM tune53),
lives AS (SELECT 'm:' || {_NAME.format('method')} AS key, registered_at AS since, removed_at AS until FROM methods
UNION ALL SELECT 't:' || coalesce({_NAME.format('method')}, '') || ':' || coalesce({_NAME.format('corpus')}, '') || ':' || {_number('tune')}, arrived_at, withdrawn_at FROM phase9_tune),
j AS (SELECT r.table_name, r.log_pos, r.period, count(l.key) AS targets, count(*) FILTER (l.since <= r.at AND (l.until IS NULL OR r.at < l.until)) AS live, count(*) FILTER (l.since <= r.at) AS begun FROM refs r LEFT JOIN lives l ON l.key = r.key WHERE r.key IS NOT NULL GROUP BY r.table_name, r.log_pos, r.period),
o AS (SELECT table_name, log_pos, period, CASE WHEN targets = 0 THEN 'missing' WHEN begun > 0 THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE live = 0)
"""
_P5 = f"""WITH RECURSIVE last AS (SELECT id, arg_max(coalesce(parent, ''), log_pos) AS parent FROM phase6_receipts WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT id, CASE WHEN contains({_NAME.format('parent')}, '/') THEN {_NAME.format('parent')} WHEN {_NAME.format('parent')} IS NOT NULL THEN lower(split_part(id, '/', 1) || '/' || {_NAME.format('parent')} || '/' || split_part(id, '/', 3)) END AS ref FROM last),
e AS (SELECT r.id, p.id AS parent FROM r LEFT JOIN last p ON {_NAME.format('p.id')} = r.ref),
up AS (SELECT id AS root_id, id, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT up.root_id, e.id, up.depth + 1 FROM up JOIN e ON e.parent = up.id),
lost AS (SELECT id, parent FROM e WHERE id NOT IN (SELECT id FROM up)),
walk AS (SELECT id, parent AS here, 1 AS n FROM lost UNION ALL SELECT w.id, l.parent, n + 1 FROM walk w JOIN lost l ON l.id = w.here WHERE n < (SELECT count(*) FROM lost)),
ring AS (SELECT DISTINCT id FROM walk WHERE id = here), smallest AS (SELECT id, min(here) AS low FROM walk WHERE id IN (SELECT id FROM ring) GROUP BY id),
hit AS (SELECT w.id, arg_min(l.low, w.n) AS root_id FROM walk w JOIN smallest l ON l.id = w.here GROUP BY w.id)
SELECT id, root_id, depth::INT AS depth FROM up UNION ALL SELECT id, root_id, -1 FROM hit"""


_P3 = """WITH r AS MATERIALIZED (SELECT run_dir, log_name, log_file, file_seq, line_no, line FROM receipt_lines WHERE CASE WHEN json_valid(line) THEN json_type(line) END = 'OBJECT'),
f AS (SELECT log_file, lag(log_file) OVER (PARTITION BY run_dir, log_name ORDER BY file_seq, log_file) AS before FROM (SELECT run_dir, log_name, log_file, min(file_seq) AS file_seq FROM receipt_lines GROUP BY ALL)),
v AS MATERIALIZED (SELECT log_file, line_no, k, json_extract(line, '$."' || k || '"')::VARCHAR AS val, CASE json_type(line, '$."' || k || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t,
json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.archive_sha256') AS sha FROM (SELECT log_file, line_no, line, unnest(json_keys(line)) AS k FROM r)),
n AS (SELECT log_file, count(*) AS n FROM r GROUP BY log_file), g AS (SELECT log_file, k, count(*) AS c, count(t) AS valued FROM v GROUP BY ALL),
ty AS (SELECT log_file, k, t FROM v JOIN g USING (log_file, k) WHERE t IS NOT NULL GROUP BY log_file, k, t HAVING 2 * count(*) > any_value(valued)),
s AS (SELECT g.log_file, g.k, ty.t FROM g JOIN n USING (log_file) LEFT JOIN ty USING (log_file, k) WHERE 2 * c > n),
o AS (SELECT f.log_file, s.k, s.t FROM f JOIN s ON s.log_file = f.before), w AS (SELECT f.log_file, s.k, s.t FROM f JOIN s USING (log_file) WHERE f.before IS NOT NULL),
gone AS (SELECT log_file, k FROM o ANTI JOIN w USING (log_file, k)), come AS (SELECT log_file, k FROM w ANTI JOIN o USING (log_file, k)),
sh AS (SELECT DISTINCT f.log_file, f.before, a.id, a.sha FROM f JOIN v a ON a.log_file = f.log_file JOIN v b ON b.log_file = f.before AND b.id = a.id AND b.sha = a.sha),
gv AS (SELECT g.log_file, g.k, list_sort(list(DISTINCT sh.id || ' ' || sh.sha || ' ' || v.val)) AS l FROM gone g JOIN sh USING (log_file) JOIN v ON v.log_file = sh.before AND v.id = sh.id AND v.sha = sh.sha AND v.k = g.k GROUP BY ALL),
cv AS (SELECT c.log_file, c.k, list_sort(list(DISTINCT sh.id || ' ' || sh.sha || ' ' || v.val)) AS l FROM come c JOIN sh USING (log_file) JOIN v ON v.log_file = sh.log_file AND v.id = sh.id AND v.sha = sh.sha AND v.k = c.k GROUP BY ALL),
ren AS (SELECT x.log_file, x.k AS field, y.k AS new_field FROM (SELECT *, row_number() OVER (PARTITION BY log_file, l ORDER BY k) AS i FROM gv) x JOIN (SELECT *, row_number() OVER (PARTITION BY log_file, l ORDER BY k) AS i FROM cv) y USING (log_file, l, i))
SELECT log_file, 'type_changed' AS change_kind, k AS field, k AS new_field FROM o JOIN w USING (log_file, k) WHERE o.t != w.t UNION ALL SELECT log_file, 'renamed', field, new_field FROM ren
UNION ALL SELECT log_file, 'removed', k, '' FROM gone ANTI JOIN (SELECT log_file, field AS k FROM ren) USING (log_file, k) UNION ALL SELECT log_file, 'added', '', k FROM come ANTI JOIN (SELECT log_file, new_field AS k FROM ren) USING (log_file, k)"""

#: Every field is followed under the name that its series first gave it, from file to file.
_P3N = (
    _P3.replace("WITH r AS", "WITH RECURSIVE r AS", 1).replace("\nSELECT log_file, 'type_changed' AS change_kind", ",\nc AS MATERIALIZED (SELECT log_file, 'type_changed' AS change_kind", 1).replace("ren AS (SELECT x.log_file", "ren AS MATERIALIZED (SELECT x.log_file", 1)
    + """),
born AS (SELECT f.log_file, s.k AS name, s.k AS canon FROM f JOIN s USING (log_file) WHERE f.before IS NULL UNION ALL SELECT log_file, new_field, new_field FROM c WHERE change_kind = 'added'),
named AS (SELECT * FROM born UNION ALL SELECT f.log_file, CASE WHEN c.change_kind = 'renamed' THEN c.new_field ELSE m.name END, m.canon FROM named m JOIN f ON f.before = m.log_file LEFT JOIN c ON c.log_file = f.log_file AND c.field = m.name AND c.change_kind IN ('renamed', 'removed') WHERE c.change_kind IS DISTINCT FROM 'removed'),
moved AS (SELECT log_file, name, canon FROM named WHERE name != canon),
ver AS (SELECT run_dir, log_name, log_file, row_number() OVER w AS place, (1 + sum(log_file IN (SELECT log_file FROM c)) OVER w)::INT AS version FROM (SELECT run_dir, log_name, log_file, min(file_seq) AS file_seq FROM receipt_lines GROUP BY ALL) WINDOW w AS (PARTITION BY run_dir, log_name ORDER BY file_seq, log_file)),
cell AS MATERIALIZED (SELECT v.log_file, v.line_no, v.k, v.t, coalesce(m.canon, CASE WHEN v.k IN (SELECT canon FROM moved x WHERE x.log_file = v.log_file) THEN '?' || v.k ELSE v.k END) AS name, CASE WHEN t IS NULL THEN NULL WHEN t = 'string' THEN json_extract_string(val, '$') ELSE val END AS raw, CASE WHEN t = 'array' AND json_array_length(val) = 1 THEN json_extract_string(val, '$[0]')
WHEN t = 'object' THEN coalesce(json_extract_string(val, '$.value'), val) WHEN t = 'string' THEN json_extract_string(val, '$') WHEN t IS NOT NULL THEN val END AS value FROM v LEFT JOIN moved m ON m.log_file = v.log_file AND m.name = v.k)
"""
)
_OWN = ", ".join(f"'{k}'" for k in RECEIPT_TYPES)
_CAN = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(k) for k, u in RECEIPT_TYPES.items() if u == t)}) THEN TRY_CAST(trim(value) AS {t.upper()}) IS NULL AND value IS NOT NULL" for t in ("bigint", "double", "boolean")) + " ELSE false END"
_P3U = (
    _P3N
    + f", x AS (SELECT *, name NOT IN ({_OWN}) OR {_CAN} OR raw LIKE '{{%' AS kept FROM cell) SELECT log_file, line_no, any_value(version) AS version, "
    + ", ".join(f"max(value) FILTER (name = '{k}') AS {k}" if t == "string" else f"TRY_CAST(trim(max(value) FILTER (name = '{k}')) AS {t.upper()}) AS {k}" for k, t in RECEIPT_TYPES.items())
    + ", coalesce(string_agg(name || '=' || coalesce(raw, ''), chr(10) ORDER BY name || '=' || coalesce(raw, '')) FILTER (coalesce(kept, false)), '') AS rest FROM x JOIN ver USING (log_file) GROUP BY log_file, line_no"
)
_NATURAL = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(k) for k, u in RECEIPT_TYPES.items() if drift._NATURAL[u] == t)}) THEN '{t}'" for t in ("number", "boolean")) + " ELSE 'string' END"
_P3S = (
    _P3N
    + f""", known AS (SELECT DISTINCT g.log_file, g.version, b.canon AS name FROM born b JOIN ver h ON h.log_file = b.log_file JOIN ver g ON g.run_dir = h.run_dir AND g.log_name = h.log_name AND g.place >= h.place),
have AS (SELECT log_file, name, count(*) AS c FROM cell GROUP BY ALL)
SELECT log_file, version, 'rename' AS step, k AS field, name, NULL::VARCHAR AS from_type, count(*) AS n FROM cell JOIN ver USING (log_file) WHERE k != name GROUP BY ALL
UNION ALL SELECT log_file, version, 'cast', k, name, t, count(*) FROM cell JOIN ver USING (log_file) WHERE t != {_NATURAL} GROUP BY ALL
UNION ALL SELECT log_file, version, 'default', NULL, name, NULL, n.n - coalesce(c, 0) FROM known JOIN n USING (log_file) LEFT JOIN have USING (log_file, name) WHERE n.n > coalesce(c, 0)"""
)

#: The same splitting by matching quoted runs, delimiters and plain runs in turn.
_QUOTED = "\"(?:[^\"]|\"\")*\"|''(?:[^'']|'''')*''"
_CUT = {"attribution": r"\s*[,;|]\s*|\s+", "apm_rates": r"\s*[,;|/:]\s*|\s+"}
_RUN = {"attribution": r"[^\s,;|\"'']+", "apm_rates": r"[^\s,;|/:\"'']+"}
_WS = "' ' || chr(9) || chr(10) || chr(13)"
_PIECES = " ".join(f"WHEN '{f}' THEN regexp_extract_all(s, '{_QUOTED}|{_CUT[f]}|{_RUN[f]}')" for f in _CUT)
_CUTS = " ".join(f"WHEN '{f}' THEN regexp_full_match(x, '{_CUT[f]}')" for f in _CUT)
_P4 = f"""WITH t AS (SELECT log_pos, 'attribution' AS field, trim(attribution, {_WS}) AS s FROM phase9_tune UNION ALL SELECT log_pos, 'apm_rates', trim(apm_rates, {_WS}) FROM phase9_tune),
b AS (SELECT log_pos, field, CASE WHEN s LIKE '[%]' OR s LIKE '(%)' THEN trim(substring(s, 2, length(s) - 2), {_WS}) ELSE s END AS s FROM t WHERE s IS NOT NULL),
p AS (SELECT log_pos, field, CASE field {_PIECES} END AS l FROM b), e AS (SELECT log_pos, field, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM p),
d AS (SELECT *, CASE field {_CUTS} END AS cut, CASE WHEN length(x) > 1 AND x[1] = chr(34) THEN replace(substring(x, 2, length(x) - 2), chr(34) || chr(34), chr(34))
WHEN length(x) > 1 AND x[1] = chr(39) THEN replace(substring(x, 2, length(x) - 2), chr(39) || chr(39), chr(39)) ELSE x END AS y FROM e),
q AS (SELECT *, sum(cut::INT) OVER (PARTITION BY log_pos, field ORDER BY i) AS place FROM d),
v AS (SELECT log_pos, field, place, string_agg(y, '' ORDER BY i) FILTER (NOT cut) AS value FROM q GROUP BY ALL), m AS (SELECT log_pos, field FROM v WHERE value != '' GROUP BY ALL HAVING count(*) > 1)
SELECT log_pos, field, place::INT AS place, value FROM v JOIN m USING (log_pos, field) WHERE value != ''"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT * FROM o",
        "p1_counts": _P1 + "SELECT table_name, period, reason, count(*) AS n FROM o GROUP BY ALL",
        "p2_found": f"""WITH t AS (SELECT corpus, log_pos, {_number('archive_bytes')} AS size, {_number('tune')} AS tune, row_number() OVER (PARTITION BY corpus, archive_sha256 ORDER BY log_pos) AS copy FROM phase9_tune WHERE trim(corpus) != '')
SELECT corpus, (row_number() OVER (PARTITION BY corpus ORDER BY size, tune, log_pos))::INT AS place, log_pos FROM t WHERE copy = 1 AND size > 0 AND tune IS NOT NULL QUALIFY place <= 5""",
        "p3_found": _P3,
        "p3_unified": _P3U,
        "p3_steps": _P3S,
        "p4_found": _P4,
        "p5_found": _P5,
        "p5_tree": _P5.replace("SELECT id AS root_id, id, 0 AS depth FROM", "SELECT id AS root_id, id, 0 AS depth, id AS path FROM").replace("up.depth + 1 FROM", "up.depth + 1, up.path || ' > ' || e.id FROM").split("SELECT id, root_id, depth::INT")[0]
        + "SELECT id, root_id, depth::INT AS depth, (SELECT count(*) FROM up u WHERE starts_with(u.path, up.path || ' > ')) AS n_descendants, path FROM up UNION ALL SELECT id, root_id, -1, NULL, NULL FROM hit",
        "p5_descendants": _P5.split("lost AS")[0].rstrip().rstrip(",") + " SELECT root_id AS ancestor_id, id, depth::INT AS steps FROM up WHERE depth > 0",
        "p5_all_descendants": _P5.split("ring AS")[0].rstrip().rstrip(",") + """, pairs AS (SELECT parent AS ancestor_id, id, 1 AS steps FROM e WHERE parent IS NOT NULL AND id IN (SELECT id FROM up)
UNION ALL SELECT e.parent, p.id, p.steps + 1 FROM pairs p JOIN e ON e.id = p.ancestor_id WHERE e.parent IS NOT NULL)
SELECT ancestor_id, id, steps::INT AS steps FROM pairs UNION ALL SELECT here, id, min(n)::INT FROM walk WHERE here != id GROUP BY ALL""",
    }


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p3_found, p3_unified, p3_steps, p4_found, p5_found, p5_tree, p5_descendants, p5_all_descendants)}

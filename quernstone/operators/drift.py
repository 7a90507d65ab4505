"""Schemas that drift between the files of a series: every change, and one consistent table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import BROADCAST_ROWS, maybe_broadcast, stage

_TYPES = {"string": "STRING", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def records(lines: DataFrame) -> DataFrame:
    """The lines that hold a JSON object, with it as VARIANT `v`; broken lines, other JSON values,
    nulls and objects that repeat a key are no records."""
    text = F.trim("line", F.lit(" \t\r\n"))
    whole = text.startswith("{") & text.endswith("}")
    return lines.withColumn("v", F.when(whole, F.try_parse_json("line"))).filter("v IS NOT NULL")


def _type(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(_TYPES.items()):
        out = F.when(kind.rlike(f"^({pattern})"), name).otherwise(out)
    return out


def _explode(recs: DataFrame, *keep: str) -> DataFrame:
    """Rows (keep..., pos, key, value) of the records' fields; nulls for an empty object."""
    return recs.sparkSession.sql(f"SELECT {', '.join('r.' + c for c in keep)}, f.pos AS pos, f.key AS key, f.value AS value FROM {{r}} r, LATERAL variant_explode_outer(r.v) f", r=recs)


def chain(lines: DataFrame) -> DataFrame:
    """One row per file: run_dir, log_name, log_file, file_seq, and the file after it."""
    files = lines.groupBy("run_dir", "log_name", "log_file").agg(F.min("file_seq").alias("file_seq"))
    w = Window.partitionBy("run_dir", "log_name").orderBy("file_seq", "log_file")
    return files.withColumn("next_file", F.lead("log_file").over(w)).withColumn("first", F.row_number().over(w) == 1)


def cells(recs: DataFrame, id_field: str, sha_field: str) -> DataFrame:
    """One narrow row per field of every record: log_file, field, type (null for null), a hash of
    the value, two hashes of the record's id and digest (null where one of them is missing), and
    whether it is the record's first; an empty object has one row without field."""
    key = [F.try_variant_get("v", f"$.{x}", "string") for x in (id_field, sha_field)]
    known = key[0].isNotNull() & key[1].isNotNull()
    keyed = recs.select("log_file", "v", F.when(known, F.xxhash64(*key)).alias("k1"), F.when(known, F.xxhash64(key[1], F.lit(1), key[0])).alias("k2"))
    parts = _explode(keyed, "log_file", "k1", "k2")
    return parts.select("log_file", "k1", "k2", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), F.col("key").alias("field"), _type(F.col("value")).alias("type"), F.xxhash64(F.to_json("value")).alias("h"))


def file_fields(parts: DataFrame) -> DataFrame:
    """log_file, field, type: the fields that more than half of a file's records have, and the JSON
    type of more than half of their non-null values (null if none is)."""
    seen = parts.filter("field IS NOT NULL").groupBy("log_file", "field").agg(F.count("*").alias("n"), F.count("type").alias("valued"), *[F.count_if(F.col("type") == t).alias(f"_{t}") for t in _TYPES])
    total = parts.filter("first").groupBy("log_file").agg(F.count("*").alias("records"))
    kind = F.coalesce(*[F.when(2 * F.col(f"_{t}") > F.col("valued"), t) for t in _TYPES])
    return seen.join(total.hint("merge"), "log_file").filter("2 * n > records").select("log_file", "field", kind.alias("type"))


def fingerprints(fields: DataFrame) -> DataFrame:
    """log_file and the fingerprint of its schema (fields with types, order-free)."""
    f = F.concat_ws(":", F.to_json(F.struct("field")), F.coalesce("type", F.lit("")))
    return fields.groupBy("log_file").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(f)), ","), 256).alias("fingerprint"))


@dataclass
class Profile:
    """Staged: the chained files, one narrow row per field of every record, and the files' fields."""

    files: DataFrame
    parts: DataFrame
    fields: DataFrame


def profile(lines: DataFrame, *, id_field: str = "id", sha_field: str = "archive_sha256") -> Profile:
    lines = lines.select("run_dir", "log_name", "log_file", "file_seq", "line")
    parts = stage(cells(records(lines), id_field, sha_field))
    return Profile(stage(chain(lines)), parts, stage(file_fields(parts)))


def schema_changes(lines: DataFrame | Profile, *, id_field: str = "id", sha_field: str = "archive_sha256") -> DataFrame:
    """Changes of each file against the file before it in its series: log_file, change_kind, field,
    new_field.

    lines: run_dir, log_name, log_file, file_seq, line. The files of a series are chained by
    file_seq; fingerprints of neighbours that agree end the comparison. `renamed`: a field goes,
    another comes and has the same value in every record that both files hold (same id and
    archive_sha256, both text); compared by a count and two sums of 64-bit hashes over all those records, so
    no pairs of fields are formed. Fields alike in this way pair up by name order. Else `removed`
    and `added`; `type_changed`: a field stays, and its type is known in both and differs.

    A field that no shared record holds cannot be renamed. Files without records have no fields.
    Repeated lines count as often as they occur; a first file has no changes. An empty table gives
    no rows.
    """
    known = lines if isinstance(lines, Profile) else profile(lines, id_field=id_field, sha_field=sha_field)
    files, parts, fields = known.files, known.parts, known.fields
    # what there is by file is broadcast once counted; only the cells of records are shuffled
    side = F.broadcast if files.count() <= BROADCAST_ROWS else lambda df: df  # for one row per file
    prints = fingerprints(fields)
    link = files.filter("next_file IS NOT NULL").select("log_file", "next_file")
    before = prints.select(F.col("log_file"), F.col("fingerprint").alias("_old"))
    after = prints.select(F.col("log_file").alias("next_file"), F.col("fingerprint").alias("_new"))
    moved = link.join(side(before), "log_file", "left").join(side(after), "next_file", "left").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("log_file", "next_file")
    old = fields.join(side(moved), "log_file").select(F.col("next_file").alias("log_file"), F.col("field"), F.col("type").alias("_old"), F.lit(True).alias("_had"))
    new = fields.join(side(moved.select(F.col("next_file").alias("log_file"))), "log_file").select("log_file", "field", F.col("type").alias("_new"), F.lit(True).alias("_has"))
    both = stage(old.join(new, ["log_file", "field"], "full").filter("_had IS NULL OR _has IS NULL OR _old != _new"))

    kept = both.filter("_had AND _has").select("log_file", F.lit("type_changed").alias("change_kind"), "field", F.col("field").alias("new_field"))
    gone = both.filter("_has IS NULL").select("log_file", "field")
    come = both.filter("_had IS NULL").select("log_file", "field")
    wanted = both.filter("_had IS NULL OR _has IS NULL").groupBy("log_file").agg(F.collect_set(F.when(F.col("_has"), F.col("field"))).alias("_come"), F.collect_set(F.when(F.col("_had"), F.col("field"))).alias("_gone"))
    wanted = wanted.filter((F.size("_come") > 0) & (F.size("_gone") > 0))

    renames = maybe_broadcast(stage(_renames(parts, link, wanted, id_field, side)))
    out = [
        kept,
        renames.select("log_file", F.lit("renamed").alias("change_kind"), "field", "new_field"),
        gone.join(renames.select("log_file", "field"), ["log_file", "field"], "left_anti").select("log_file", F.lit("removed").alias("change_kind"), "field", F.lit("").alias("new_field")),
        come.join(renames.select("log_file", F.col("new_field").alias("field")), ["log_file", "field"], "left_anti").select("log_file", F.lit("added").alias("change_kind"), F.lit("").alias("field"), F.col("field").alias("new_field")),
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _renames(parts: DataFrame, link: DataFrame, wanted: DataFrame, id_field: str, side) -> DataFrame:
    wanted = stage(wanted)
    old = wanted.join(side(link.withColumnRenamed("log_file", "_file")), F.col("log_file") == F.col("next_file")).select("_file", F.col("log_file").alias("target"), F.lit(0).alias("side"), F.col("_gone").alias("fields"))
    new = wanted.select(F.col("log_file").alias("_file"), F.col("log_file").alias("target"), F.lit(1).alias("side"), F.col("_come").alias("fields"))
    need = maybe_broadcast(stage(old.unionByName(new)))
    # a record's id stands for the record, so that one without wanted fields is seen too
    is_wanted = F.array_contains("fields", F.col("field"))
    rows = parts.filter("k1 IS NOT NULL").join(need, F.col("log_file") == F.col("_file")).filter(is_wanted | (F.col("field") == id_field))
    cell = F.when(is_wanted, F.struct("field", F.xxhash64("k1", "h").alias("h1"), F.xxhash64("h", "k2").alias("h2")))
    shared = rows.groupBy(F.col("target").alias("log_file"), "k1", "k2").agg(F.max("side").alias("_b"), F.min("side").alias("_a"), F.collect_set(F.when(F.col("side") == 0, cell)).alias("old"), F.collect_set(F.when(F.col("side") == 1, cell)).alias("new"))
    shared = stage(shared.filter("_a = 0 AND _b = 1").select("log_file", "old", "new"))

    def signed(side: str, name: str) -> DataFrame:
        c = shared.select("log_file", F.explode(side).alias("c")).select("log_file", "c.*")
        s = c.groupBy("log_file", "field").agg(F.count("*").alias("_n"), F.sum(F.col("h1").cast("decimal(20,0)")).alias("_s1"), F.sum(F.col("h2").cast("decimal(20,0)")).alias("_s2"))
        w = Window.partitionBy("log_file", "_n", "_s1", "_s2").orderBy("field")
        return s.withColumn("_rank", F.row_number().over(w)).withColumnRenamed("field", name)

    return signed("old", "field").join(signed("new", "new_field"), ["log_file", "_n", "_s1", "_s2", "_rank"]).select("log_file", "field", "new_field")


#: The JSON type that a column type takes without a cast.
_NATURAL = {"string": "string", "boolean": "boolean", "bigint": "number", "double": "number"}


def migrations(known: Profile, changes: DataFrame) -> DataFrame:
    """One row per file with the rules that its records go through: log_file, version, fingerprint,
    names (a map from the file's fields to canonical names, where they differ), known (the
    canonical names that the series has had so far).

    A renamed field keeps the name under which the series first had it, an added one has its own
    (with `?` before it if that is taken). version counts the schemas of a series. The rules are
    folded over the files of each series, which are few against its records.
    """
    steps = changes.groupBy("log_file").agg(F.collect_list(F.struct("change_kind", "field", "new_field")).alias("steps"))
    first = known.files.filter("first").select("log_file").join(known.fields, "log_file").groupBy("log_file").agg(F.collect_set("field").alias("born"))
    events = known.files.join(steps, "log_file", "left").join(first, "log_file", "left").join(fingerprints(known.fields), "log_file", "left")
    events = events.select("run_dir", "log_name", "log_file", "file_seq", "steps", "born", "fingerprint").repartition("run_dir", "log_name").sortWithinPartitions("run_dir", "log_name", "file_seq", "log_file")
    return events.mapInPandas(_fold, "log_file string, version int, fingerprint string, names map<string,string>, known array<string>")


def _name(key: Column, names: Column, mark: Column) -> Column:
    taken = F.array_contains(F.map_values(names), key) & ~F.map_contains_key(names, key)
    return F.coalesce(F.element_at(names, key), F.when(taken, F.concat(mark, key)).otherwise(key))


def unified(lines: DataFrame, rules: DataFrame, types: dict[str, str]) -> DataFrame:
    """One consistent table: log_file, line_no, version, a column for each field of `types`
    (canonical name -> string, bigint, double or boolean), and `rest`.

    Every record is routed through the rules of its file (see migrations), within its row: fields
    are renamed, a field that it lacks or that is null defaults to null, values are cast to the column's
    type. A cast unwraps an array of one element and an object's member `value`; other arrays and objects stay
    JSON text. `rest` holds as lines `name=text`, by name, what the columns don't: fields without a
    column, values that can't be read as the column's type, and objects. Fields of single records
    that the file as a whole lacks keep their own names, with a `?` before them if that name is
    taken. Broken lines are left out; repeated ones come out repeated.
    """
    recs = records(lines.select("log_file", "line_no", "line")).join(maybe_broadcast(rules.select("log_file", "version", "names")), "log_file")
    recs = recs.withColumn("_m", F.try_variant_get("v", "$", "map<string,variant>"))
    mark = F.repeat(F.lit("?"), F.coalesce(F.array_max(F.transform(F.map_keys("_m"), lambda k: F.length(F.regexp_extract(k, r"^\?*", 0)))), F.lit(0)) + 1)
    named = F.when(F.size("names") == 0, F.col("_m")).otherwise(F.transform_keys("_m", lambda k, _: _name(k, F.col("names"), mark)))
    # what stands in a lambda is evaluated for every field, so nothing else does
    cells = recs.select("log_file", "line_no", "version", named.alias("_m")).withColumn("_value", F.transform_values("_m", lambda _, x: _inner(x)))
    value = lambda k: F.element_at("_value", k)
    raw = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))
    typed = {k: value(k) if t == "string" else F.trim(value(k)).try_cast(t) for k, t in types.items()}
    left = F.map_entries(F.map_filter("_m", lambda k, x: ~k.isin(list(types)) | raw(x).startswith("{")))
    left = F.transform(left, lambda e: F.concat(e["key"], F.lit("="), raw(e["value"])))
    unread = [F.when(value(k).isNotNull() & typed[k].isNull() & ~raw(F.element_at("_m", k)).startswith("{"), F.concat(F.lit(f"{k}="), raw(F.element_at("_m", k)))) for k, t in types.items() if t != "string"]
    rest = F.array_join(F.array_sort(F.concat(left, F.array_compact(F.array(*unread).cast("array<string>")))), "\n")
    return cells.select("log_file", "line_no", "version", *[c.alias(k) for k, c in typed.items()], rest.alias("rest"))


def _inner(x: Column) -> Column:
    """The text of a value: of an array's only element, of an object's member `value`, else as it is."""
    kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
    one = kind.startswith("ARRAY") & F.try_variant_get(x, "$[1]", "variant").isNull()
    member = F.try_variant_get(x, "$.value", "variant")
    nested = F.when(one, F.try_variant_get(x, "$[0]", "string")).when(kind.startswith("OBJECT") & member.isNotNull(), F.try_variant_get(member, "$", "string")).otherwise(text)
    return F.when(F.substring(text, 1, 1).isin("[", "{"), nested).otherwise(text)


def applied_steps(known: Profile, rules: DataFrame, types: dict[str, str]) -> DataFrame:
    """Every step that the rules take, by file: log_file, version, step, field, name, from_type, n.

    step: `rename` (the file's field has another name in the table), `cast` (values of the JSON
    type from_type become the column's type; one row per type met), `default` (records without a
    field that the series has had, set to null). n counts the records. Fields without a column stay text.
    """
    seen = known.parts.filter("field IS NOT NULL").groupBy("log_file", "field", "type").agg(F.count("*").alias("n"))
    total = known.parts.filter("first").groupBy("log_file").agg(F.count("*").alias("records"))
    rules = maybe_broadcast(stage(rules))
    named = stage(seen.join(rules, "log_file").select("log_file", "version", "field", _name(F.col("field"), F.col("names"), F.lit("?")).alias("name"), "type", "n"))
    natural = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, t in types.items() for x in (k, _NATURAL[t])]), F.col("name")), F.lit("string"))
    no = F.lit(None).cast("string")
    renames = named.filter("field != name").groupBy("log_file", "version", F.lit("rename").alias("step"), "field", "name").agg(F.sum("n").alias("n")).withColumn("from_type", no)
    casts = named.filter(F.col("type") != natural).select("log_file", "version", F.lit("cast").alias("step"), "field", "name", "n", F.col("type").alias("from_type"))
    have = named.groupBy("log_file", "name").agg(F.sum("n").alias("_have"))
    want = rules.join(total, "log_file").select("log_file", "version", "records", F.explode("known").alias("name"))
    lacks = want.join(have, ["log_file", "name"], "left").withColumn("n", F.col("records") - F.coalesce("_have", F.lit(0))).filter("n > 0")
    lacks = lacks.select("log_file", "version", F.lit("default").alias("step"), no.alias("field"), "name", "n", no.alias("from_type"))
    return renames.unionByName(casts).unionByName(lacks).select("log_file", "version", "step", "field", "name", "from_type", "n")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rules of all files; rows come series by series, in the order of their files."""
    series, names, seen, version = None, {}, set(), 1
    for batch in batches:
        out = []
        for row in batch.itertuples():
            if series != (row.run_dir, row.log_name):
                series, names, seen, version = (row.run_dir, row.log_name), {}, set(), 1
            steps = [] if row.steps is None else list(row.steps)
            version += bool(steps)
            seen.update(row.born if row.born is not None else ())
            renamed = {s["new_field"]: names.get(s["field"], s["field"]) for s in steps if s["change_kind"] == "renamed"}
            for s in steps:
                if s["change_kind"] in ("renamed", "removed"):
                    names.pop(s["field"], None)
            names |= renamed
            for s in steps:
                if s["change_kind"] == "added":
                    name = s["new_field"]
                    while name in names.values():
                        name = "?" + name
                    if name != s["new_field"]:
                        names[s["new_field"]] = name
                    seen.add(name)
            out.append((row.log_file, version, row.fingerprint, {k: v for k, v in names.items() if k != v}, sorted(seen)))
        yield pd.DataFrame(out, columns=["log_file", "version", "fingerprint", "names", "known"])

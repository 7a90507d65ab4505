"""References to records that do not exist: orphan references by table, period and reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import BROADCAST_ROWS, HEAVY_SHARE, TASK_ROWS, fits_broadcast, maybe_broadcast, stage, stage_counted

_FOREVER = "9999-12-31 00:00:00"


def lifetimes(targets: DataFrame) -> DataFrame:
    """Disjoint spans (key, since, until) in which a key has a live target; until null means still
    there. `targets` has one row per target with these columns. Rows without key or since, and
    spans that end before they begin, are none. Targets that never end shrink to one row per key
    by a map-side aggregate; ended ones are merged by key and day first, then by key."""
    t = targets.select("key", "since", "until").filter("key IS NOT NULL AND since IS NOT NULL AND (until IS NULL OR until > since)")
    opened = t.filter("until IS NULL").groupBy("key").agg(F.min("since").alias("since")).withColumn("until", F.lit(_FOREVER).cast("timestamp_ntz"))
    ended = t.filter("until IS NOT NULL").groupBy("key", "since").agg(F.max("until").alias("until"))
    ended = _merge(ended.withColumn("bucket", F.date_trunc("day", "since")), ["key", "bucket"])
    spans = _merge(ended.select("key", "since", "until").unionByName(opened), ["key"])
    return spans.withColumn("until", F.nullif("until", F.lit(_FOREVER).cast("timestamp_ntz")))


def _merge(spans: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("since")
    before = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", F.when(before >= F.col("since"), 0).otherwise(1))
    isle = starts.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*by, "_isle").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_isle")


def find_orphans(refs: DataFrame, targets: DataFrame, *, heavy_share: float = HEAVY_SHARE, heavy_rows: int = 10_000, task_rows: int = TASK_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of `refs` whose key has no live target at the row's time, with the reason.

    refs: `table_name`, `log_pos` (or any further columns), `period`, `key`, `at`; targets: `key`,
    `since`, `until` (null: not ended). A key may be a struct. Reason `missing`: the key never has
    a target; `deleted`: one was there before; `late`: one comes only afterwards.

    References are counted by key and period first. Keys above `heavy_share` of all references, and
    all keys above `task_rows` of them, are held against a broadcast of their own spans; if those
    exceed `broadcast_rows`, the references of a key are salted into parts of `task_rows` and the
    spans repeated per part. All other keys go through a shuffled anti-join; the two parts are united.

    A null key is no reference. A null `at` finds nothing live: `missing` without any target, else
    `late`. Repeated rows come out repeated; empty tables give no rows or `missing` ones.
    """
    refs, n = stage_counted(refs.filter("key IS NOT NULL"))
    spans = stage(lifetimes(targets))
    return _split(refs, n["rows"], spans, refs.groupBy("key", "period").agg(F.count("*").alias("n")), heavy_share, heavy_rows, task_rows, broadcast_rows)


def _split(refs: DataFrame, n: int, spans: DataFrame, counts: DataFrame, heavy_share: float, heavy_rows: int, task_rows: int, broadcast_rows: int) -> DataFrame:
    # at most n / limit keys are heavy, so their list is bounded by 1 / heavy_share or BROADCAST_ROWS
    limit = max(heavy_rows, min(n * heavy_share, max(task_rows, n / BROADCAST_ROWS)))
    heavy, found = stage_counted(counts.groupBy("key").agg(F.sum("n").alias("_n")).filter(F.col("_n") > limit))
    if not found["rows"]:
        return _unmatched(refs, spans, ["key"])
    heavy = F.broadcast(heavy)
    light = _unmatched(refs.join(heavy, "key", "left_anti"), spans, ["key"])
    hot_spans = spans.join(heavy, "key")
    if fits_broadcast(hot_spans, broadcast_rows):
        hot = _unmatched(refs.join(heavy, "key", "left_semi"), hot_spans, ["key"], F.broadcast)
    else:
        hot, parts = refs.join(heavy, "key"), F.ceil(F.col("_n") / task_rows).cast("int")
        hot = hot.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in refs.columns if c != "key"]), parts).cast("int"))
        hot_spans = hot_spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        hot = _unmatched(hot, hot_spans, ["key", "_salt"])
    return light.unionByName(hot.select(light.columns))


def _unmatched(refs: DataFrame, spans: DataFrame, on: list[str], hint=lambda df: df) -> DataFrame:
    s = spans.select(*[F.col(c).alias(f"_s_{c}") for c in (*on, "since", "until")])
    match = [F.col(c) == F.col(f"_s_{c}") for c in on]
    live = (F.col("_s_since") <= F.col("at")) & (F.col("_s_until").isNull() | (F.col("at") < F.col("_s_until")))
    dead = refs.join(hint(s), [*match, live], "left_anti")
    first = s.groupBy(*[f"_s_{c}" for c in on]).agg(F.min("_s_since").alias("_first"))
    reason = F.when(F.col("_first").isNull(), "missing").when(F.col("_first") <= F.col("at"), "deleted").otherwise("late")
    return dead.join(hint(first), match, "left").select(*[c for c in refs.columns if c not in ("_salt", "_n")], reason.alias("reason"))


def count_orphans(refs: DataFrame, targets: DataFrame, *, heavy_share: float = HEAVY_SHARE, heavy_rows: int = 10_000, task_rows: int = TASK_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """table_name, period, reason, n: the number of orphan references, as find_orphans finds them.

    References are aggregated by table, key and period, with their earliest and latest time. Most
    such groups are settled whole against the spans of their key: no target at all, none yet, all
    ended before, or one span over all of it. Only the references of the other groups are looked
    at one by one. Both counts are united and summed.
    """
    refs, n = stage_counted(refs.filter("key IS NOT NULL").select("table_name", "period", "key", "at"))
    spans = stage(lifetimes(targets))
    groups = stage(refs.groupBy("table_name", "key", "period").agg(F.count("*").alias("n"), F.min("at").alias("_a"), F.max("at").alias("_b"), F.count_if(F.col("at").isNull()).alias("_none")))
    s = spans.select(F.col("key").alias("_key"), "since", "until")
    covers = (F.col("since") <= F.col("_a")) & (F.col("until").isNull() | (F.col("_b") < F.col("until"))) & (F.col("_none") == 0)
    open_ = groups.join(s, (F.col("key") == F.col("_key")) & covers, "left_anti")
    ends = s.groupBy("_key").agg(F.min("since").alias("_first"), F.max(F.coalesce("until", F.lit(_FOREVER).cast("timestamp_ntz"))).alias("_last"))
    known = open_.join(ends, F.col("key") == F.col("_key"), "left")
    whole = F.when(F.col("_key").isNull(), "missing").when(F.col("_a").isNull() | (F.col("_b") < F.col("_first")), "late").when((F.col("_none") == 0) & (F.col("_a") >= F.col("_last")), "deleted")
    known = stage(known.select("table_name", "period", "key", "n", whole.alias("reason")))
    mixed = known.filter("reason IS NULL")
    key = ["table_name", "key", "period"]
    groups_of = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in key]
    rows = refs.join(maybe_broadcast(mixed.select(*[F.col(c).alias(f"_m_{c}") for c in key]), broadcast_rows), groups_of, "left_semi")
    single = _split(rows, n["rows"], spans, mixed.select("key", "n"), heavy_share, heavy_rows, task_rows, broadcast_rows)
    single = single.groupBy("table_name", "period", "reason").agg(F.count("*").alias("n"))
    both = known.filter("reason IS NOT NULL").select("table_name", "period", "reason", "n").unionByName(single)
    return both.groupBy("table_name", "period", "reason").agg(F.sum("n").alias("n"))

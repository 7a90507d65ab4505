"""Parent-child rows as full hierarchies: nested-set ranges, and from them root, depth, paths and
descendants; cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.prefix import WIDTH, running
from quernstone.session import BROADCAST_ROWS, TASK_ROWS, heavy_keys, stage, stage_counted


def hierarchy(edges: DataFrame, *, task_rows: int = TASK_ROWS, broadcast_rows: int = BROADCAST_ROWS, width: int = WIDTH) -> DataFrame:
    """Place every node of `edges` (id, parent; one row per id, parent null or unknown: a root).

    Result: id, parent, root_id, depth, size (descendants and itself), lo, hi (the node's
    nested-set range in the preorder of all trees, numbered from 0 without gaps: its descendants
    are the nodes with lo in (lo, hi]). Nodes whose walk never ends have depth -1, null ranges, and
    as root_id the smallest id on the cycle they reach.

    Subtree sizes rise: in each round every node hands the size that it has to ancestors some steps
    above, and the steps grow by a factor per round, so a tree of depth d takes log(d) rounds. Nodes
    that no round settles hang on cycles; a round that settles none ends the search, as nodes
    further down would need one there. Siblings (roots among themselves too) then get ranges by
    prefix sums of sizes, within salts of at most `task_rows` rows and over the salts, and the
    starts go down by the same steps. Root and depth are read off the ranges, in one pass along the
    preorder: the root is the last one begun, the depth the number of ranges begun and not ended.

    Every round is one staged job over narrow rows. Up to `broadcast_rows` nodes, by count, its
    joins broadcast one side and it takes eight steps; beyond, two steps and shuffled joins, from
    which parents with many rows are taken out by exact counts (see _lookup).

    Null ids are no nodes; of repeated ids the one with the smallest parent counts. Self-parents
    are cycles. An empty table gives no rows.
    """
    nodes, n = stage_counted(edges.filter("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent")))
    small = n["rows"] <= broadcast_rows
    factor, side = (8, F.broadcast) if small else (2, _plain)
    named = nodes.filter("parent IS NOT NULL").select("id", F.col("parent").alias("hop"))
    live = _lookup(named, nodes.select(F.col("id").alias("_id")), small).select("id", "hop", F.lit(1).cast("bigint").alias("size"))
    rounds: list[DataFrame] = []
    while True:
        state, left = stage_counted(_climb(live, factor, small), on=F.count("next"))
        if left["on"] == left["rows"]:
            break
        rounds.append(state)
        gains = _handed(state).groupBy("_to").agg(F.sum("size").alias("_more"))
        ahead = state.filter("next IS NOT NULL").select("id", F.col("next").alias("hop"), "size")
        live = ahead.join(side(gains), F.col("id") == F.col("_to"), "left").select("id", "hop", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))
    lost = state.select("id") if left["rows"] else None
    placed = _place(nodes, rounds, lost, n["rows"] - left["rows"], task_rows, side, width)
    if left["rows"]:
        placed = placed.unionByName(_cycles(nodes.join(side(lost), "id", "left_semi"), left["rows"], small), allowMissingColumns=True)
    return placed


def _plain(df: DataFrame) -> DataFrame:
    return df


def _lookup(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows joined with table on hop = _id (unique). Small tables are broadcast. Else keys with very
    many rows are found by count, and their table rows, as few, are broadcast; the others shuffle."""
    on = F.col("hop") == F.col("_id")
    if small:
        return rows.join(F.broadcast(table), on)
    heavy = heavy_keys(rows.groupBy("hop").agg(F.count("*").alias("n")))
    if heavy.isEmpty():
        return rows.join(table, on)
    hot = F.broadcast(heavy.select(F.col("hop").alias("_hot")))
    few = F.broadcast(table.join(hot, F.col("_id") == F.col("_hot"), "left_semi"))
    return rows.join(few, on).unionByName(rows.join(hot, F.col("hop") == F.col("_hot"), "left_anti").join(table, on))


def _climb(live: DataFrame, factor: int, small: bool) -> DataFrame:
    """id, size, hops (the next factor - 1 stations above, null past the top), next (the one after
    those) of live rows (id, hop, size)."""
    table = live.select(F.col("id").alias("_id"), F.col("hop").alias("_next"))
    if not small:  # two steps: hop is never null, but the station above may have none itself
        table = stage(table)
        met = _lookup(live, table, small).select("id", "size", F.array("hop").alias("hops"), F.col("_next").alias("next"))
        ended = live.join(_lookup(live, table, small).select("id"), "id", "left_anti")
        return met.unionByName(ended.select("id", "size", F.array("hop").alias("hops"), F.lit(None).cast(live.schema["id"].dataType).alias("next")))
    now = live.withColumn("_h1", F.col("hop"))
    for k in range(2, factor + 1):
        above = F.broadcast(table.select(F.col("_id").alias(f"_i{k}"), F.col("_next").alias(f"_h{k}")))
        now = now.join(above, F.col(f"_h{k - 1}") == F.col(f"_i{k}"), "left")
    return now.select("id", "size", F.array(*[f"_h{k}" for k in range(1, factor)]).alias("hops"), F.col(f"_h{factor}").alias("next"))


def _handed(state: DataFrame) -> DataFrame:
    return state.select(F.explode("hops").alias("_to"), "size").filter("_to IS NOT NULL")


def _place(nodes: DataFrame, rounds: list[DataFrame], lost: DataFrame | None, n: int, task_rows: int, side, width: int) -> DataFrame:
    """The settled nodes with their ranges, roots and depths."""
    kin = nodes if lost is None else nodes.join(side(lost), "id", "left_anti")
    if rounds:
        first = rounds[0].select(F.col("id").alias("_id"), F.col("hops")[0].alias("_up"))
        handed = _handed(rounds[0])
        for state in rounds[1:]:
            handed = handed.unionByName(_handed(state))
        gains = handed.groupBy("_to").agg(F.sum("size").alias("_more"))
        kin = kin.join(side(first), F.col("id") == F.col("_id"), "left").join(side(gains), F.col("id") == F.col("_to"), "left")
        kin = kin.select("id", F.col("_up").alias("parent"), (F.coalesce("_more", F.lit(0)) + 1).alias("size"))
    else:
        kin = kin.select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("parent"), F.lit(1).cast("bigint").alias("size"))
    # siblings side by side, the roots as siblings too
    salts = max(1, -(-n // task_rows))
    kin = kin.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    within = Window.partitionBy("parent", "_salt").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    kin = kin.withColumn("lo", F.coalesce(F.sum("size").over(within), F.lit(0)) + F.when(F.col("parent").isNull(), 0).otherwise(1))
    if salts > 1:
        kin = stage(kin)
        sums = kin.groupBy("parent", "_salt").agg(F.sum("size").alias("_sum"))
        over = Window.partitionBy("parent").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("parent").alias("_p"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
        kin = kin.join(sums, F.col("parent").eqNullSafe(F.col("_p")) & (F.col("_salt") == F.col("_s"))).withColumn("lo", F.col("lo") + F.col("_before"))
    now = stage(kin.select("id", "parent", "size", "lo"))
    for state in rounds:  # starts go down by the steps that sizes came up
        steps = state.select(F.col("id").alias("_of"), F.explode("hops").alias("hop")).filter("hop IS NOT NULL")
        starts = now.select(F.col("id").alias("_id"), F.col("lo").alias("_lo"))
        add = _lookup(steps, starts, side is F.broadcast).groupBy("_of").agg(F.sum("_lo").alias("_add"))
        now = stage(now.join(side(add), F.col("id") == F.col("_of"), "left").select("id", "parent", "size", (F.col("lo") + F.coalesce("_add", F.lit(0))).alias("lo")))
    # along the preorder: what ends before a place, and the root last begun
    root = F.when(F.col("parent").isNull(), F.col("id"))
    begun = now.select("id", "parent", "size", "lo", F.lit(0).cast("bigint").alias("_ended"))
    ended = now.groupBy((F.col("lo") + F.col("size")).alias("lo")).agg(F.count("*").alias("_ended")).filter(F.col("lo") < n)
    marks = begun.unionByName(ended, allowMissingColumns=True)
    marks = running(marks, "lo", max(n - 1, 0), total=F.col("_ended"), last=root, width=width).filter("id IS NOT NULL")
    return marks.select("id", "parent", F.col("last_").alias("root_id"), (F.col("lo") - F.col("total_")).cast("int").alias("depth"), "size", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))


def _cycles(lost: DataFrame, n: int, small: bool) -> DataFrame:
    """Nodes whose walk never ends: the smallest id of the cycle that each reaches. Every round
    doubles the stretch of the walk that a node has seen; once it is as long as the nodes are many, the
    far end lies on the cycle and has seen all of it. It ends sooner where no stretch found a
    smaller id and the far ends map onto each other."""
    factor = 8 if small else 2
    now, seen = stage(lost.select("id", "parent", F.col("parent").alias("hop"), F.col("id").alias("least"))), 1
    while True:
        ahead = now.select(F.col("id").alias("_id"), F.col("hop").alias("_far"), F.col("least").alias("_least"))
        step = now.withColumn("_was", F.col("least"))
        for _ in range(factor - 1):
            step = _lookup(step, ahead, small).select("id", "parent", F.col("_far").alias("hop"), F.least("least", "_least").alias("least"), "_was")
        now, got = stage_counted(step, moved=F.count_if(F.col("least") != F.col("_was")))
        now, seen = now.drop("_was"), seen * factor
        if seen >= n or not got["moved"] and _onto(now, small):
            break
    ends = now.select(F.col("id").alias("_id"), F.col("least").alias("root_id"))
    return _lookup(now, ends, small).select("id", "parent", "root_id", F.lit(-1).alias("depth"))


def _onto(now: DataFrame, small: bool) -> bool:
    """Whether the far ends are as many as their own far ends: then all lie on cycles."""
    ends = now.select("hop").distinct()
    again = _lookup(ends, now.select(F.col("id").alias("_id"), F.col("hop").alias("_far")), small)
    n = again.agg(F.count("*").alias("a"), F.countDistinct("_far").alias("b")).first()
    return n.a == n.b


#: Bits of the block sizes that the range join uses, from small to large ranges.
_BITS = (2, 4, 6, 8, 10, 12, 14, 16)


def descendants(placed: DataFrame, of: DataFrame, *, bits: tuple[int, ...] = _BITS) -> DataFrame:
    """ancestor_id, id, steps for every descendant of the nodes `of` (id), by nested-set ranges.

    The range join is an equality on blocks of the preorder: each ancestor takes the smallest block
    size (2^b numbers, b of `bits`) that its range fits in, the largest if it fits in none, and the blocks
    that its range meets; each node its own block of every size. So a task never holds more than a
    block's nodes, and at most a few times as many pairs are looked at as there are.
    """
    up = placed.join(of.select("id").distinct(), "id", "left_semi").filter("depth >= 0 AND size > 1")
    level = F.lit(bits[-1])
    for b in reversed(bits[:-1]):
        level = F.when(F.col("size") <= 1 << b, b).otherwise(level)
    up = up.withColumn("_level", level)
    block = lambda c, b: F.expr(f"shiftright({c}, {b})")
    up = up.select(F.col("id").alias("ancestor_id"), F.col("depth").alias("_d"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_level", F.explode(F.sequence(block("lo + 1", "_level"), block("hi", "_level"))).alias("_block"))
    down = placed.filter("depth > 0").select("id", "depth", "lo", F.explode(F.array(*[F.lit(b) for b in bits])).alias("_level")).withColumn("_block", block("lo", "_level"))
    hit = up.join(down, ["_level", "_block"]).filter("lo > _lo AND lo <= _hi")
    return hit.select("ancestor_id", "id", (F.col("depth") - F.col("_d")).alias("steps"))


def paths(placed: DataFrame) -> DataFrame:
    """id and path: the ids from the root to the node, from the ranges that enclose it; nodes on or
    below cycles have a null path. The result is as large as all paths together."""
    above = descendants(placed, placed.select("id")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("steps", "ancestor_id")), asc=False).alias("_up"))
    whole = F.concat(F.coalesce(F.col("_up.ancestor_id"), F.array().cast("array<string>")), F.array("id"))
    return placed.select("id", "depth").join(above, "id", "left").select("id", F.when(F.col("depth") >= 0, whole).alias("path"))


def descendants_on_cycles(placed: DataFrame) -> DataFrame:
    """ancestor_id, id, steps for the nodes whose walk never ends: the other nodes on the walk of each, by
    doubling. On a cycle every node descends from all others; steps is the shortest way."""
    lost = placed.filter("depth < 0")
    now, size = stage(lost.select("id", F.array("parent").alias("walk"))), 0
    while True:  # a walk is whole once what follows repeats it
        n = now.agg(F.sum(F.size("walk"))).first()[0] or 0
        if n == size:
            break
        size = n
        above = now.select(F.col("id").alias("_id"), F.col("walk").alias("_walk"))
        step = now.join(above, F.element_at("walk", -1) == F.col("_id"))
        now = stage(step.select("id", F.array_distinct(F.concat("walk", "_walk")).alias("walk")))
    hit = now.select("id", F.posexplode("walk").alias("_place", "ancestor_id")).filter("ancestor_id != id")
    return hit.select("ancestor_id", "id", (F.col("_place") + 1).alias("steps"))

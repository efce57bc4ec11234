"""Trees as intervals: the child and descendant axes as joins, whatever the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators.ranks import ranked
from terralith.operators.scratch import release, settle


#: Steps of a list up to which it is summed up by doubled pointers.
ENOUGH = 1 << 18


def _shorter(walk: DataFrame, k: int) -> DataFrame:
    """Round k: a step that draws 0 takes in the next one where that draws 1; `gone` are the steps taken in, about a quarter."""
    coin = lambda c: F.xxhash64(F.col(c), F.lit(k)).bitwiseAND(F.lit(1).cast("bigint"))
    takes, may = (coin("step") == 0) & (coin("to") == 1) & F.col("to").isNotNull(), (coin("step") == 1) & ~F.col("to").eqNullSafe(F.col("step"))
    left = walk.filter(takes).select(F.col("to").alias("_k"), F.col("step").alias("_s"), F.col("far").alias("_f"), F.col("up").alias("_u"))
    both = left.join(walk.filter(may).select(F.col("step").alias("_k"), "to", "far", "up", F.lit(True).alias("_may")), "_k", "full_outer")
    row = lambda step, to, far, up, gone: F.struct(F.col(step).alias("step"), F.col(to).alias("to"), far.alias("far"), up.alias("up"), F.lit(gone).alias("gone"))
    next_ = row("_k", "to", F.col("far"), F.col("up"), True)
    taken = F.array(row("_s", "to", F.col("_f") + F.col("far"), F.col("_u") + F.col("up"), False), next_)
    alone = F.when(F.col("_s").isNull(), F.array(row("_k", "to", F.col("far"), F.col("up"), False))).otherwise(F.array(row("_s", "_k", F.col("_f"), F.col("_u"), False)))
    rest = walk.filter(~takes & ~may).select("step", "to", "far", "up", F.lit(False).alias("gone"))
    return settle(both.select(F.inline(F.when(F.col("_s").isNotNull() & F.col("_may").isNotNull(), taken).otherwise(alone))).union(rest))


def list_sums(walk: DataFrame) -> DataFrame:
    """(step, far, up): the sums of far and up from each step (step, to, far, up) to the end of its list, where to is null; steps that come to no end are left out.

    The list is shortened by a quarter a round until it has `ENOUGH` steps, these are summed up by doubled pointers, and the
    steps taken out get their sums in the opposite order: all rounds together move a few times the list, not once a round.
    """
    tables, now, n, last = [], walk, walk.count(), None
    while n > ENOUGH and (last is None or n < last * 15 // 16):  # rings and steps that lead to themselves don't get fewer
        tables.append(_shorter(now, len(tables)))
        now = tables[-1].filter("not gone").drop("gone")
        last, n = n, now.count()
    for _ in range(n.bit_length()):  # far: steps from here on, up: nodes entered less nodes left from here on
        ahead = now.select(F.col("step").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("up").alias("_up"))
        new = now.join(ahead, "to", "left").select("step", F.col("_to").alias("to"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), (F.col("up") + F.coalesce("_up", F.lit(0))).alias("up"))
        old, now = now, settle(new)
        release(old)
    sums = now.filter("to is null").select("step", "far", "up")
    for table in reversed(tables):
        behind = sums.select(F.col("step").alias("to"), F.col("far").alias("_far"), F.col("up").alias("_up"))
        gone = table.filter("gone").join(behind, "to", "left").filter("to is null or _far is not null")
        sums = sums.union(settle(gone.select("step", (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), (F.col("up") + F.coalesce("_up", F.lit(0))).alias("up"))))
    out = settle(sums)
    release(*tables)
    return out


def labels(nodes: DataFrame) -> DataFrame:
    """(id, start, end, depth) of every node (id, parent, ordinal) that hangs from a root (parent null).

    A walk enters each node, its children by ordinal, and leaves it; start and end are the two places in the walk, from 0,
    over all roots in order. The walk is a list of steps, each of which names the next (entering and leaving a node without
    children are one); places are sums over that list, in rounds that don't follow the depth. Ids are whole numbers of 0 and
    more; nodes in a cycle, or below one that isn't given, have no label.
    """
    placed = settle(ranked(nodes.select("id", "parent", "ordinal"), F.col("parent").asc_nulls_first(), "ordinal", "id"))
    following = placed.select((F.col("rank") - 1).alias("rank"), F.col("id").alias("next"), F.col("parent").alias("_p"))
    after = placed.join(following, "rank", "left").withColumn("next", F.when(F.col("parent").eqNullSafe(F.col("_p")), F.col("next")))
    first = placed.filter("parent is not null").groupBy("parent").agg(F.min_by("id", "rank").alias("child")).select(F.col("parent").alias("id"), "child")
    both = after.join(first, "id", "left")
    out, leaf = F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1), F.col("child").isNull()
    step = lambda at, to, far, up: F.struct(at.alias("step"), to.alias("to"), F.lit(far).cast("bigint").alias("far"), F.lit(up).cast("bigint").alias("up"))
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    steps = settle(both.select(F.inline(F.when(leaf, F.array(step(enter, out, 2, 0))).otherwise(F.array(step(enter, F.col("child") * 2, 1, 1), step(leave, out, 1, -1))))))
    given = steps.select(F.col("step").alias("to"), (F.col("far") == 2).alias("_leaf"))
    lost = F.col("to").isNotNull() & F.col("_leaf").isNull()  # leads to a node that isn't given: goes round for ever
    walk = settle(steps.join(given, "to", "left").withColumn("to", F.when(lost, F.col("step")).otherwise(F.col("to"))).select("step", "to", "far", "up"))
    sums = list_sums(walk)
    leaves = given.filter("_leaf").select(F.col("to").alias("step")).join(sums, "step").select(F.col("step") + 1, F.col("far") - 1, F.col("up") - 1)
    ended = sums.union(leaves)
    total = ended.agg(F.max("far")).first()[0] or 0
    place = F.lit(total) - F.col("far")
    whole = ended.select(F.floor(F.col("step") / 2).alias("id"), (F.col("step") % 2 == 0).alias("_in"), place.alias("_at"), (-F.col("up")).alias("_depth"))
    out = whole.groupBy("id").agg(F.max(F.when(F.col("_in"), F.col("_at"))).alias("start"), F.max(F.when(~F.col("_in"), F.col("_at"))).alias("end"), F.max(F.when(F.col("_in"), F.col("_depth"))).alias("depth"))
    return settle(out.filter("start is not null and end is not null"))


#: Levels of halving: places up to 2**LEVELS.
LEVELS = 40


def _blocks(first: Column, past: Column) -> Column:
    """The (level, block) that make up the places from first to past: at most two a level."""
    start = F.struct(first.cast("bigint").alias("a"), past.cast("bigint").alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        odd_a = (s["a"] < s["b"]) & (s["a"] % 2 == 1)
        a = F.when(odd_a, s["a"] + 1).otherwise(s["a"])
        odd_b = (a < s["b"]) & (s["b"] % 2 == 1)
        b = F.when(odd_b, s["b"] - 1).otherwise(s["b"])
        one = lambda block: F.array(F.struct(level.cast("int").alias("level"), block.cast("bigint").alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        out = F.concat(s["out"], F.when(odd_a, one(s["a"])).otherwise(none), F.when(odd_b, one(b)).otherwise(none))
        return F.struct(F.floor(a / 2).alias("a"), F.floor(b / 2).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["out"])


def descendants(above: DataFrame, below: DataFrame) -> DataFrame:
    """(top, id): each node of above (id, start, end) with each node of below (id, start) under it.

    Intervals and places meet on blocks of halved places, each pair on exactly one: an equal join, with no rounds and no
    nested loop.
    """
    cut = above.select(F.col("id").alias("top"), F.inline(_blocks(F.col("start") + 1, F.col("end"))))
    longest = above.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    levels = range(min(LEVELS, longest.bit_length()) + 1)
    spots = below.select("id", F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("start", k).alias("block")) for k in levels])))
    return cut.join(spots, ["level", "block"]).select("top", "id")


def children(above: DataFrame, nodes: DataFrame) -> DataFrame:
    """(top, id): each node of above (id) with its children among nodes (id, parent)."""
    return nodes.select("id", F.col("parent").alias("top")).join(above.select(F.col("id").alias("top")), "top").select("top", "id")

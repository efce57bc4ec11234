"""Three-way merges, diffs, parity and section comparison. Presence flags tell a missing row from a row of nulls."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sided(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(side), F.lit(True).alias(f"in_{side}"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Row merge with action, conflict and row.

    A change on one side wins; columns changed on both sides merge one by one, ours winning a conflict; an edit against a
    deletion is a conflict that keeps the edit of ours, or the deletion by ours.
    """
    both = reduce(lambda a, b: a.join(b, keys, "full_outer"), [_sided(d, keys, s) for d, s in ((base, "b"), (ours, "o"), (theirs, "t"))])
    flag = {s: F.coalesce(f"in_{s}", F.lit(False)) for s in "bot"}
    same = lambda p, q: (flag[p] == flag[q]) & F.col(p).eqNullSafe(F.col(q))
    columns = [c for c in ours.columns if c not in keys]
    clash = reduce(lambda a, b: a | b, [~F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) & ~F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) & ~F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in columns])
    mixed = F.struct(*[F.when(F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")), F.col(f"t.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])
    action = F.when(same("o", "t"), "same").when(same("b", "o"), "theirs").when(same("b", "t"), "ours").when(flag["o"] & flag["t"], "merged").otherwise("edit_delete")
    full = both.withColumn("action", action)
    conflict = F.when(F.col("action") == "merged", clash).otherwise(F.col("action") == "edit_delete")
    row = F.when(F.col("action") == "theirs", F.col("t")).when(F.col("action") == "merged", mixed).otherwise(F.col("o"))
    kept = F.when(F.col("action") == "theirs", flag["t"]).otherwise(flag["o"])
    return full.select(*keys, "action", conflict.alias("conflict"), kept.alias("kept"), row.alias("row"))


def merge_links(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Links as sets: ours without what theirs removed, with what theirs added."""
    removed = base.join(theirs, base.columns, "left_anti")
    added = theirs.join(base, base.columns, "left_anti")
    return ours.join(removed, base.columns, "left_anti").unionByName(added).distinct()


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with change (added, removed, changed) and the names of changed columns."""
    both = _sided(before, keys, "b").join(_sided(after, keys, "a"), keys, "full_outer")
    columns = [c for c in after.columns if c not in keys]
    fields = F.filter(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), c) for c in columns]), lambda c: c.isNotNull())
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(F.size(fields) > 0, "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", fields).otherwise(F.array().cast("array<string>")).alias("fields")).filter("change is not null")


def raster_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, cell: int = 64) -> tuple[DataFrame, DataFrame]:
    """The merged raster, ours where both changed a pixel differently, and the conflicts of each cell with their bounds."""
    named = lambda d, n: d.select("x", "y", F.col("v").alias(n))
    all3 = named(base, "b").join(named(ours, "o"), ["x", "y"], "full_outer").join(named(theirs, "t"), ["x", "y"], "full_outer")
    clash = ~F.col("o").eqNullSafe(F.col("b")) & ~F.col("t").eqNullSafe(F.col("b")) & ~F.col("o").eqNullSafe(F.col("t"))
    merged = all3.select("x", "y", F.when(F.col("o").eqNullSafe(F.col("b")), F.col("t")).otherwise(F.col("o")).alias("v"))
    conflicts = all3.filter(clash).groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("pixels"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return merged, conflicts


def raster_diff(before: DataFrame, after: DataFrame, cell: int = 64) -> DataFrame:
    """One row: changed pixels, their bounds, and the number of cells that hold some."""
    both = before.select("x", "y", F.col("v").alias("b")).join(after.select("x", "y", F.col("v").alias("a")), ["x", "y"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    cells = both.groupBy(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("changed"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("cells"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: pixels, equal ones, linear fit of right on left, and correlation."""
    both = left.select("x", "y", F.col("v").cast("double").alias("l")).join(right.select("x", "y", F.col("v").cast("double").alias("r")), ["x", "y"])
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("l") == F.col("r")).alias("equal"), F.regr_slope("r", "l").alias("slope"), F.regr_intercept("r", "l").alias("intercept"), F.corr("l", "r").alias("correlation"))


def file_status(left: DataFrame, right: DataFrame) -> DataFrame:
    """path with identical, differs, only_left or only_right, by hash."""
    both = left.select("path", F.col("hash").alias("l")).join(right.select("path", F.col("hash").alias("r")), "path", "full_outer")
    return both.select("path", F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.col("l") == F.col("r"), "identical").otherwise("differs").alias("status"))


def package_decision(rows: DataFrame) -> DataFrame:
    """What importing a change does, from the hashes base, after and current (null: no file)."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return rows.withColumn("decision", F.when(same("current", "after"), "already").when(same("current", "base") & F.col("after").isNull(), "delete").when(same("current", "base"), "apply").when(F.col("after").isNull() | F.col("current").isNull(), "conflict").otherwise("merge"))


def resolve(conflicts: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """Conflicts with the row of the chosen side; without a choice ours stays."""
    return conflicts.join(choices, keys, "left").withColumn("row", F.when(F.col("side") == "theirs", F.col("t")).otherwise(F.col("o")))


def compare_sections(left: DataFrame, right: DataFrame, section: str, value: str, order: str) -> DataFrame:
    """Sections in both with equal, reordered, count differs or differs.

    Order is compared by position and content by counts of values, so no section is gathered in a row.
    """

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(section, F.col(value).alias(name), F.row_number().over(Window.partitionBy(section).orderBy(order)).alias("_k"))

    both = ranked(left, "l").join(ranked(right, "r"), [section, "_k"], "full_outer")
    place = both.groupBy(section).agg(F.count("l").alias("nl"), F.count("r").alias("nr"), F.bool_and(F.col("l").eqNullSafe(F.col("r"))).alias("ordered"))
    counts = left.select(section, F.col(value).alias("_v"), F.lit(1).alias("_d")).union(right.select(section, value, F.lit(-1))).groupBy(section, "_v").agg(F.sum("_d").alias("_d")).groupBy(section).agg((F.max(F.abs("_d")) == 0).alias("balanced"))
    out = place.filter("nl > 0 and nr > 0").join(counts, section)
    return out.select(section, F.when(F.col("ordered"), "equal").when(F.col("balanced"), "reordered").when(F.col("nl") != F.col("nr"), "count differs").otherwise("differs").alias("verdict"))


def change_summary(changes: DataFrame) -> Column | DataFrame:
    """One text: each kind of change with its count, by name."""
    n = changes.groupBy("change").agg(F.count("*").alias("n"))
    return n.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("change", "n"))), lambda c: F.concat(c["n"].cast("string"), F.lit(" "), c["change"])), ", ").alias("summary"))


def merge_order(ours: DataFrame, theirs: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Keys of both sides with their place: ours in order, each key of theirs alone after the one that precedes it there.

    A run of keys of theirs alone shares the last common key before it (none: the front), so places are one sort by that
    key's place and the place in theirs; no side is folded row by row. Keys are distinct within a group.
    """
    at = Window.partitionBy(group).orderBy(order)
    mine = ours.select(group, key, F.row_number().over(at).alias("_a"))
    both = theirs.select(group, key, F.row_number().over(at).alias("_t")).join(mine, [group, key], "left")
    after = F.last("_a", ignorenulls=True).over(Window.partitionBy(group).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    alone = both.withColumn("_p", F.coalesce(after, F.lit(0))).filter("_a is null").select(group, key, "_p", "_t")
    rows = mine.select(group, key, F.col("_a").alias("_p"), F.lit(0).alias("_t")).unionByName(alone)
    return rows.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy("_p", "_t")).alias("place"))


def bulk_update(rows: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows with changes where the condition holds, and edited: whether a value became another. A null condition changes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}
    differs = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(c)) for c, v in new.items()])
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns], differs.alias("edited"))


def byte_parity(pairs: DataFrame, masks: Column) -> DataFrame:
    """Built files (path, built, reference: binary) with status, first differing byte and how many differ; -1 without a reference.

    masks: array of structs (lo, hi) per row; bytes from lo below hi count as equal. A longer tail counts whole.
    """
    @F.pandas_udf("first bigint, bytes bigint")
    def compare(built: pd.Series, reference: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, los, his in zip(built, reference, lo, hi, strict=True):
            if b is None:
                out.append((-1, -1))
                continue
            a = a or b""
            n = min(len(a), len(b))
            differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
            for start, end in zip(los, his, strict=True):
                differ[start:end] = False
            at = np.flatnonzero(differ)
            out.append((int(at[0]) if len(at) else n if len(a) != len(b) else -1, len(at) + abs(len(a) - len(b))))
        return pd.DataFrame(out, columns=["first", "bytes"])

    got = pairs.withColumn("_m", masks).withColumn("_d", compare("built", "reference", F.col("_m.lo"), F.col("_m.hi")))
    status = F.when(F.col("reference").isNull(), "no-reference").when(F.col("_d.bytes") == 0, "identical").otherwise("differs")
    return got.select("path", status.alias("status"), "_d.first", "_d.bytes")

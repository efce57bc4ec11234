"""Batch edits as tables of operations, and an append-only journal of versions.

Edits are folded by key in one pass: all operations of a row meet once, in order, and the result is a new version. A batch
with an operation that can't apply leaves everything as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bad_operations(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations on rows that don't exist, unless an earlier one of the batch creates them."""
    born = ops.filter("op = 'create'").groupBy("id").agg(F.min("seq").alias("born"))
    known = rows.select("id", F.lit(True).alias("known"))
    both = ops.join(known, "id", "left").join(born, "id", "left")
    return both.filter((F.col("op") != "create") & F.col("known").isNull() & (F.col("born").isNull() | (F.col("born") > F.col("seq")))).select("seq", "id", "op")


def apply_edits(rows: DataFrame, ops: DataFrame, column: str) -> DataFrame:
    """rows (id, column) after ops (seq, id, op, value): set, create and delete; the last one counts."""
    last = ops.groupBy("id").agg(F.max_by(F.struct("op", "value"), "seq").alias("o"))
    both = rows.join(last, "id", "full_outer")
    return both.filter(F.coalesce(F.col("o.op") != "delete", F.lit(True))).select("id", F.when(F.col("o").isNotNull(), F.col("o.value")).otherwise(F.col(column)).alias(column))


def apply_all_or_nothing(rows: DataFrame, ops: DataFrame, column: str) -> DataFrame:
    """apply_edits, or rows as they were if any operation is bad."""
    return rows.select("id", column) if not bad_operations(rows, ops).isEmpty() else apply_edits(rows, ops, column)


def move_props(props: DataFrame, moves: DataFrame) -> DataFrame:
    """Props after moves (seq, id, dx, dz, dy, factor): shifts add up and scales multiply."""
    total = moves.groupBy("id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.sum("dz").alias("dz"), F.product("factor").alias("factor"))
    both = props.join(total, "id", "left")
    add = lambda c: F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))
    return both.withColumns({"x": add("x"), "y": add("y"), "z": add("z"), "scale": F.col("scale") * F.coalesce("factor", F.lit(1.0))}).select(*props.columns)


def edit_tags(props: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    """Comma lists without and with tags, sorted, once each."""
    old = F.filter(F.split("tags", ","), lambda t: t != "")
    new = F.array_sort(F.array_distinct(F.concat(F.array_except(old, F.array(*map(F.lit, remove)).cast("array<string>")), F.array(*map(F.lit, add)).cast("array<string>"))))
    return props.withColumn("tags", F.array_join(new, ","))


def state_at(journal: DataFrame, seq: int | None = None) -> DataFrame:
    """path and hash after all entries up to seq: the last entry of each path; deleted ones (null after) are gone."""
    upto = journal if seq is None else journal.filter(F.col("seq") <= seq)
    return upto.groupBy("path").agg(F.max_by("after", "seq").alias("hash")).filter("hash is not null")


def undo(journal: DataFrame, seq: int) -> DataFrame:
    """What undoing one batch does: its paths, the hash to restore, and whether a later change refuses it."""
    later = journal.filter(F.col("seq") > seq).select("path").distinct().withColumn("refused", F.lit(True))
    return journal.filter(F.col("seq") == seq).join(later, "path", "left").select("path", F.col("before").alias("restore"), F.coalesce("refused", F.lit(False)).alias("refused"))


def broken_links(journal: DataFrame) -> DataFrame:
    """Entries whose before is not the after of the path's previous entry."""
    w = Window.partitionBy("path").orderBy("seq")
    return journal.withColumn("previous", F.lag("after").over(w)).withColumn("k", F.row_number().over(w)).filter((F.col("k") > 1) & ~F.col("previous").eqNullSafe(F.col("before"))).drop("previous", "k")


def replay(base: DataFrame, journal: DataFrame, first: int, last: int) -> DataFrame:
    """base (path, hash) with the entries from first to last put on it, and whether each still fits (moved: base had changed)."""
    part = journal.filter(F.col("seq").between(first, last))
    ends = part.groupBy("path").agg(F.max_by("after", "seq").alias("to"), F.min_by("before", "seq").alias("from"))
    both = base.join(ends.withColumn("touched", F.lit(True)), "path", "full_outer")
    out = both.withColumn("moved", F.coalesce("touched", F.lit(False)) & ~F.col("hash").eqNullSafe(F.col("from")))
    return out.select("path", F.when(F.col("touched"), F.col("to")).otherwise(F.col("hash")).alias("hash"), "moved").filter("hash is not null")


def paint_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """One operation a colour: how many hexes turn to it, and the least id."""
    changed = after.join(before.select("id", F.col("rgb").alias("old")), "id").filter(~F.col("rgb").eqNullSafe(F.col("old")))
    return changed.groupBy("rgb").agg(F.count("*").alias("hexes"), F.min("id").alias("first"), F.sort_array(F.collect_list("id")).alias("ids"))


def check_values(fields: DataFrame, schema: DataFrame) -> DataFrame:
    """Values that don't look like their field's type."""
    number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    vec = lambda n: f"^{number}( {number}){{{n - 1}}}$"
    kinds = {"Bool": "^(true|false)$", "Int": r"^[+-]?\d+$", "Float": f"^{number}$", "Vec2": vec(2), "Vec3": vec(3), "Vec4": vec(4), "Colour": r"^\d{1,3}( \d{1,3}){3}$", "Id": "^[0-9a-f]{15}$"}
    fits = None
    for kind, pattern in kinds.items():
        test = F.col("val").rlike(pattern)
        fits = F.when(F.col("type") == kind, test) if fits is None else fits.when(F.col("type") == kind, test)
    return fields.join(schema.select("comp", "field", "type"), ["comp", "field"]).filter((F.col("val") != "") & ~fits.otherwise(F.lit(True)))

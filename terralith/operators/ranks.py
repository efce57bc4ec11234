"""Global ranks and codes without a window over all rows: sort by ranges, count each range, add offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralith.operators.scratch import settle


def ranked(df: DataFrame, *by: Column | str, name: str = "rank") -> DataFrame:
    """df with the rank of each row, from 0, in an order that should be total.

    The rows are sorted by ranges and written with their place in their range; the number of rows before a range comes from
    one count a range, a table as long as there are partitions.
    """
    placed = settle(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted(tuple(r) for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for k, n in sizes:
        rows.append((k, before))
        before += n
    offsets = placed.sparkSession.createDataFrame(rows, "_part bigint, _before bigint")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_at")


def first_use_codes(df: DataFrame, value: str, order: str, name: str = "code") -> DataFrame:
    """(value, code, first): a dictionary of the values in order of their first use, codes from 0; null is a value like others.

    A value's least order combines before the shuffle; only the dictionary, one row a value, is ranked.
    """
    firsts = df.groupBy(value).agg(F.min(order).alias("first"))
    return ranked(firsts, "first", F.col(value).asc_nulls_first(), name=name)


def coded(df: DataFrame, value: str, order: str, name: str = "code") -> DataFrame:
    """df with each value's first-use code; the dictionary is broadcast where the optimiser knows it to be small."""
    codes = first_use_codes(df, value, order, name).select(F.col(value).alias("_value"), name)
    return df.join(codes, df[value].eqNullSafe(F.col("_value"))).drop("_value")

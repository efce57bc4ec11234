"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import drop_scratch, hot_keys, materialize, salted_join

MAX_ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a batch by a star per component, with the least node as its centre."""
    for batch in batches:
        parent: dict = {}

        def find(x, parent=parent):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        leaves = [(x, find(x)) for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in leaves], batch.schema.field(0).type), pa.array([r for _, r in leaves], batch.schema.field(0).type)], names=["u", "v"])


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One large-star and one small-star step; edges (u, v) in any direction in, (larger, smaller) out, and a table to drop.

    The centre of a star may have any number of neighbours, so its edges are dealt over tasks.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    large = salted_join(both.filter("v > u"), least.select("u", "m"), "u", hot_keys(least, "u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    near = large.groupBy("u").agg(F.min("v").alias("m"))
    far = large.join(near, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.union(near.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): the component is named by its least node. No edges: no rows.

    Nulls and loops are left out. State between rounds is a table in the shared folder.
    """
    kind = edges.schema["u"].dataType.simpleString()
    now = materialize(edges.select("u", "v").filter("u is not null and v is not null and u <> v").mapInArrow(_forest, f"u {kind}, v {kind}"), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        step, least = _star(now)
        after = materialize(step, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(now, least)
        now = after
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

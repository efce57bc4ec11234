"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame functions only. An item of q distinct five-word shingles is contained in a document that has at least 3/4 of
them. Any k = q - ceil(3q/4) + 1 shingles of the item then include one of the document's, so the item's bottom-k MinHash
sketch (its k least hashes) finds every document that contains it: recall is 1, not a matter of luck. Items are
partitioned by size, in powers of two; a partition's largest sketch hash bounds what a document must show it, so a
document's shingle meets only the partitions whose bound it reaches, and is joined on partition and hash. Candidate pairs
are verified on the shingles themselves: the text of each candidate document is fetched once, its shingles are joined with
those of its candidate items and counted, so the work is linear in the length of a document.

The sketch is broadcast while it has at most `BROADCAST_SHINGLES` rows; beyond that the same join is dealt by partition and
hash. No shuffle carries a text: documents stand under a 16-byte key of doc_id and text.

Words are runs without ASCII white space of the lower-cased text. With fewer than five words the whole sequence is the
only shingle. null or blank texts on either side match nothing. A repeated item row is one item; an item_id with two
texts is two items with that id; repeated document rows give one row. Other columns are not looked at. A text may be as long as a row: its words are one array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import materialize

WIDTH = 5
NUM, DEN = 3, 4
#: Rows of the sketch, or shingles of all items, that are broadcast at most (about 20 and 60 bytes each), and keys of
#: candidate documents (16 bytes each).
BROADCAST_SHINGLES = 200_000
BROADCAST_KEYS = 500_000

def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: a lambda's variable isn't expanded at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; null for null or blank texts."""
    return _with(F.trim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), lambda t: F.when(t != "", F.split(t, r"[\x20\x09-\x0D]+")))


def shingle_hashes(text: Column) -> Column:
    """A hash for each shingle of a text, by position."""
    full = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))
    return _with(words(text), lambda w: F.when(F.size(w) >= WIDTH, full(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))))


def shingle_texts(text: Column) -> Column:
    """The distinct shingles of a text, words joined by a blank."""
    full = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WIDTH - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, WIDTH)))
    return F.array_distinct(_with(words(text), lambda w: F.when(F.size(w) >= WIDTH, full(w)).when(F.size(w) > 0, F.array(F.concat_ws(" ", w)))))


def _hash_of(shingle: Column) -> Column:
    return F.xxhash64(F.split(shingle, " "))


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and key, which stands for both in joins."""
    docs = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return docs.withColumn("key", F.unhex(F.md5(F.concat_ws(":", F.md5("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))))


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: every pair whose item is contained in the document."""
    items = (
        benchmark.select(F.col("`item_id`").cast("bigint").alias("item_id"), F.col("`text`").cast("string").alias("text"))
        .withColumn("shingles", shingle_texts(F.col("text")))
        .filter(F.size("shingles") > 0)
        .select("item_id", "shingles", F.xxhash64("item_id", "shingles").alias("item"), F.size("shingles").alias("n_item"))
        .dropDuplicates(["item_id", "shingles"])
    )
    items = materialize(items.withColumn("part", F.floor(F.log2("n_item")).cast("int")), "items")
    least = F.slice(F.array_sort(F.transform("shingles", _hash_of)), F.lit(1), F.expr(f"n_item - ceil({NUM} * n_item / {DEN}) + 1").cast("int"))
    sketch = items.select("item", "part", F.explode(least).alias("h"))
    # one row a partition of sizes (at most 31): what a document must show the partition, and how many hashes it has
    parts = sketch.groupBy("part").agg(F.max("h").alias("most"), F.count("*").alias("rows")).orderBy("part").collect()
    n_shingles = items.agg(F.sum("n_item")).first()[0] or 0
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_SHINGLES else df.hint("merge")
    docs = _keyed(documents)
    shown = docs.select("key", F.explode(shingle_hashes(F.col("text"))).alias("h")).filter(F.col("h") <= F.lit(max((p.most for p in parts), default=None)).cast("bigint"))
    within = F.filter(F.array(*[F.when(F.col("h") <= p.most, F.lit(p.part)) for p in parts]), lambda x: x.isNotNull()) if parts else F.array().cast("array<int>")
    shown = shown.select("key", "h", F.explode(within).alias("part"))
    pairs = materialize(shown.join(small(sketch, sum(p.rows for p in parts)), ["part", "h"]).select("key", "item").distinct(), "candidates")
    keys = pairs.select("key").distinct()
    n_keys = keys.count()
    # the text of each candidate document once, then only its shingles
    held = docs.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys.hint("merge"), "key", "left_semi")
    ids = held.groupBy("key").agg(F.first("doc_id").alias("doc_id"))
    of_doc = held.select("key", F.explode(shingle_texts(F.col("text"))).alias("s")).distinct()
    of_item = pairs.join(small(items.select("item", F.explode("shingles").alias("s")), n_shingles), "item")
    shared = of_doc.join(of_item.hint("merge"), ["key", "s"]).groupBy("key", "item").agg(F.count("*").alias("n_shared"))
    n_items = items.select("item", "item_id", F.col("n_item").cast("bigint").alias("n_item"))
    found = shared.join(small(n_items, n_shingles), "item").filter(F.col("n_shared") * DEN >= F.col("n_item") * NUM)
    return found.join(ids.hint("merge"), "key").select("doc_id", "item_id", "n_item", "n_shared")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents that contain no item; all columns stay. Rows without doc_id stay."""
    leaks = find(documents, benchmark).select("doc_id").distinct()
    return documents.join(leaks.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_shingles(table: str, key: str) -> str:
    return f"""
        SELECT {key}, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
        FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""


OP9_SQL = f"""
WITH d AS ({_sql_shingles("documents", "doc_id")}),
     b AS ({_sql_shingles("benchmark", "item_id")}),
     n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, n.n_item, count(*) AS n_shared
FROM b JOIN d ON d.s = b.s JOIN n ON n.item_id = b.item_id
GROUP BY d.doc_id, b.item_id, n.n_item
HAVING 4 * count(*) >= 3 * n.n_item
"""

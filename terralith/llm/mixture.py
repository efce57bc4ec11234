"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id and text. A source whose target is k times its size and a rest takes all its
documents k times, and once more those whose hash is at most a threshold: the hash order's prefix whose words come nearest to
the rest. Thresholds are nested, so a larger target takes all that a smaller one takes, and a run on the same rows agrees.

The threshold comes from histograms, not from a sort: words are summed by source and the hash's first ten bits, the bucket in
which the sum passes the rest is the only one that is opened, by its next ten bits, until it holds one hash value. From the
second histogram on only rows of those buckets are read, about a thousandth of the table. Sources may be many: they are
ranked by ranges, and joined by broadcast only up to a checked number.

null texts have no words; null is a source like others and stands last. A source without words has target 0. Documents are
taken whole; rows equal in id and text have one hash and are taken alike, so a source's words may miss its target by half of
the words of the one document, or group of equal rows, that the threshold meets. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import drop_scratch, hot_keys, materialize, salted_join
from terralith.operators.ranks import ranked

#: Weights of the sources by code point order, repeating; a source gives at most CAP times its words.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Bits of the hash, and of one histogram's buckets.
HASH_BITS = 60
STEP_BITS = 10
#: Sources up to which the table of thresholds, one short row a source, is broadcast.
BROADCAST_SOURCES = 100_000
_BLANK = r"\x20\x09-\x0D"


def keyed(documents: DataFrame) -> DataFrame:
    """documents with _source (null told from all others), size in words and _hash."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    marks = F.regexp_replace(F.regexp_replace(text, f"^[{_BLANK}]++", ""), f"[^{_BLANK}]++[{_BLANK}]*+", "x")  # one mark a word
    digest = F.md5(F.concat(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")), F.lit(":"), text))
    return documents.withColumns({
        "_source": F.when(F.col("`source`").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("`source`").cast("string"))),
        "_size": F.length(marks).cast("bigint"),
        "_hash": F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint"),
    })


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows joined with one row a source; beyond a broadcast's bound the rows of large sources are dealt over tasks."""
    if few:
        return rows.join(F.broadcast(sources), "_source")
    return salted_join(rows, sources, "_source", hot_keys(rows.groupBy("_source").agg(F.count("*").alias("_n")), "_source", "_n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """_source, source_size, target, copies and rest of every source of (_source, source_size).

    Shares of all words by weight; what passes cap times a source's words is shared anew by weight among the others. That is
    one level of words a weight unit, raised until no further source is full.
    """
    order = F.when(F.col("_source") == "", F.lit(1)).otherwise(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = ranked(sizes, order, "_source", name="_rank").withColumn("_weight", weight).drop("_rank")
    total, units = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, full = (total or 0) / (units or 1), -1
    while True:
        is_full = F.col("source_size") * float(cap) < F.col("_weight") * F.lit(level)
        held, left, n = weighed.agg(F.sum(F.when(is_full, F.col("source_size") * cap)), F.sum(F.when(~is_full, F.col("_weight"))), F.count_if(is_full)).first()
        if n == full or not left:
            break
        level, full = (total - (held or 0)) / left, n
    target = F.least(F.col("source_size") * float(cap), F.col("_weight") * F.lit(level))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("bigint")
    return weighed.withColumn("target", target).withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).drop("_weight")


def thresholds(slim: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """_source and threshold: the hashes up to it are taken once more. slim: a table of _source, _size, _hash; goals: _source, rest."""
    state = goals.filter("rest > 0").select("_source", "rest", F.lit(0).cast("bigint").alias("_below"), F.lit(0).cast("bigint").alias("_prefix"))
    rows, used, done = slim, [], []
    for level in range(HASH_BITS // STEP_BITS):
        shift = HASH_BITS - STEP_BITS * (level + 1)
        if level:
            within = _with_sources(rows, state.select("_source", "_prefix"), few).filter(F.shiftright("_hash", shift + STEP_BITS) == F.col("_prefix"))
            rows = materialize(within.drop("_prefix"), "edge")  # the boundary buckets alone
            used.append(rows)
        sums = rows.groupBy("_source", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("_size").alias("_words"), F.min("_hash").alias("_first"), F.max("_hash").alias("_last"))
        w = Window.partitionBy("_source").orderBy("_bucket")  # at most 2**STEP_BITS rows a source
        passed = sums.join(state, "_source").withColumn("_upto", F.col("_below") + F.sum("_words").over(w)).filter("_upto > rest and _upto - _words <= rest")
        found = materialize(passed.select("_source", "rest", (F.col("_upto") - F.col("_words")).alias("_below"), F.col("_bucket").alias("_prefix"), "_words", "_first", "_last"), "bucket")
        used.append(found)
        nearer = 2 * F.col("_below") + F.col("_words") < 2 * F.col("rest")
        done.append(found.filter("_first = _last").select("_source", F.when(nearer, F.col("_first")).otherwise(F.col("_first") - 1).alias("threshold")))
        state = found.filter("_first < _last").select("_source", "rest", "_below", "_prefix")
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = materialize(out, "threshold")
    drop_scratch(*used)
    return out


def mixture(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, bool]:
    """One row a source (_source, source_size, target, copies, threshold) and whether they are few enough to broadcast."""
    goals = materialize(targets(slim.groupBy("_source").agg(F.sum("_size").alias("source_size")), weights, cap), "goal")
    few = goals.count() <= BROADCAST_SOURCES
    edge = thresholds(slim, goals.select("_source", "rest"), few)
    return goals.join(edge, "_source", "left").select("_source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(-1)).alias("threshold")), few


def _times() -> Column:
    """How often a document is taken."""
    return F.col("copies") + F.when(F.col("_hash") <= F.col("threshold"), 1).otherwise(0)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes of each document."""
    slim = materialize(keyed(documents).select(F.col("`doc_id`").cast("bigint").alias("doc_id"), "_source", "_size", "_hash"), "size")
    sources, few = mixture(slim, weights, cap)
    return _with_sources(slim, sources, few).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _times()).alias("taken"))


def drawn(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns and copy, from 1."""
    own = documents.select(F.struct("*").alias("_row"), *[F.col(f"`{c}`") for c in ("doc_id", "source", "text")])
    rows = keyed(own).select("_row", "_source", "_size", "_hash")
    slim = materialize(rows.drop("_row"), "size")
    sources, few = mixture(slim, weights, cap)
    taken = _with_sources(rows, sources.select("_source", "copies", "threshold"), few).withColumn("_times", _times()).filter("_times > 0")
    return taken.select("_row.*", F.explode(F.expr("sequence(1, cast(_times as int))")).alias("copy"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
  o AS (SELECT *, row_number() OVER (ORDER BY n / CAST(w AS DOUBLE), source NULLS LAST) AS k FROM s),
  f AS (SELECT *, CAST((SELECT sum(n) FROM s) - sum(3 * n) OVER (ORDER BY k) + 3 * n AS DOUBLE) / CAST((SELECT sum(w) FROM s) - sum(w) OVER (ORDER BY k) + w AS DOUBLE) AS level FROM o),
  l AS (SELECT arg_min(level, k) AS level FROM f WHERE 3e0 * n >= w * level),
  t AS (SELECT source, n, least(3e0 * n, w * l.level) AS target FROM s, l),
  g AS (SELECT *, CASE WHEN n > 0 THEN CAST(least(3, floor(target / n)) AS BIGINT) ELSE 0 END AS copies FROM t),
  c AS (SELECT doc_id, size, n, target, copies, target - copies * n AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS own FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
  SELECT doc_id, size, n AS source_size, target, CAST(size * (copies + CASE WHEN 2 * upto - own < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""

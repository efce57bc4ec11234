"""Groupings, windows and sets of the reference surface, with explicit orders wherever a first or last row decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The first row of each group: a minimum of (order, row), which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def last_rows(df: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def later_copies(df: DataFrame, keys: list[str], order: str = "ordinal", key: str = "id") -> DataFrame:
    """Every row of a group after the first, with the group's size and first key."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_n": F.row_number().over(w.orderBy(order)), "copies": F.count("*").over(w), "first_id": F.first(key).over(w.orderBy(order))})
    return ranked.filter("_n > 1").drop("_n")


def modal(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group; ties go to the value seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"), F.min(order).alias("_o"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_c", (-F.col("_o")).alias("o"))).alias(value))


def indexed_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles at index floor(q * (n - 1)) of the sorted values, without gathering a group in one row.

    Ranks come from a window sorted on disk if need be, and the wanted ranks are picked by conditional minima.
    """
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    picks = [F.min(F.when(F.col("_i") == F.floor(F.lit(q) * (F.col("_n") - 1)), F.col(value))).alias(name) for name, q in shares.items()]
    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at index n div 2 of the sorted group."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), F.min(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col(value))).alias("median"))


def asset_usage(props: DataFrame) -> DataFrame:
    """Uses, mean scale and commonest layer of each model."""
    return props.groupBy("model").agg(F.count("*").alias("uses"), F.avg("scale").alias("mean_scale")).join(modal(props, ["model"], "layer", "ordinal"), "model")


def infer_schema(fields: DataFrame, most_values: int = 40) -> DataFrame:
    """Type, count, distinct values and default of each (component, field), from its texts.

    Texts are counted first, so only distinct values are tested; sets are never gathered. Empty texts fit any type.
    """
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    counts = fields.groupBy("comp", "field", "val").agg(F.count("*").alias("c"), F.min("id").alias("o"))
    some = F.col("val") != ""
    parts = F.split("val", " ")
    vector = F.when(F.size(parts).between(2, 4) & F.forall(parts, lambda p: p.rlike(number)), F.size(parts)).otherwise(0)
    quad = F.forall(parts, lambda p: p.rlike(r"^\d{1,3}$") & (p.cast("int") <= 255))
    every = lambda test: F.coalesce(F.bool_and(F.when(some, test)), F.lit(True))
    g = counts.groupBy("comp", "field").agg(
        F.sum("c").alias("n"),
        F.count("*").alias("distinct_values"),
        F.count_if(some).alias("filled"),
        every(F.col("val").isin("true", "false")).alias("is_bool"),
        every(F.col("val").rlike(r"^[0-9a-f]{15}$")).alias("is_id"),
        every(F.col("val").rlike(r"^[+-]?\d{1,18}$")).alias("is_int"),
        every(F.col("val").rlike(number)).alias("is_float"),
        F.min(F.when(some, vector)).alias("v0"),
        F.max(F.when(some, vector)).alias("v1"),
        every(quad).alias("is_quad"),
        every(F.contains("val", F.lit("/")) | F.contains("val", F.lit("\\"))).alias("is_path"),
        every(F.col("val").rlike(r"^[A-Za-z0-9_\-.,]{1,64}$")).alias("is_word"),
        F.max(F.struct("c", (-F.col("o")).alias("o"), "val")).alias("top"),
    )
    vec = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(0)
    few = F.col("distinct_values") <= most_values
    kind = (
        F.when(F.col("filled") == 0, "String").when(F.col("is_bool"), "Bool").when(F.col("is_id"), "Id").when(F.col("is_int"), "Int").when(F.col("is_float"), "Float")
        .when((vec == 4) & F.col("is_quad"), "Colour").when(vec == 2, "Vec2").when(vec == 3, "Vec3").when(vec == 4, "Vec4").when(F.col("is_path"), "Path")
        .when(few & (F.col("filled") <= 24) & F.col("is_word"), "Enum").otherwise("String")
    )
    neutral = F.when(kind == "Bool", "false").when(kind.isin("Int", "Float"), "0").when(kind == "Vec2", "0 0").when(kind == "Vec3", "0 0 0").when(kind == "Vec4", "0 0 0 0").when(kind == "Colour", "255 255 255 255").when(kind == "Enum", F.col("top.val")).otherwise("")
    default = F.when((F.col("top.c") * 2 >= F.col("n")) | few, F.col("top.val")).otherwise(neutral)
    return g.select("comp", "field", kind.alias("type"), "n", "distinct_values", default.alias("default_value"))


def templates(fields: DataFrame, kinds: DataFrame, most: int = 12) -> DataFrame:
    """Component layouts of each entity type by count, the first `most` of them; a layout is its sorted component names."""
    layout = fields.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("comp")), ",").alias("layout"))
    counts = layout.join(kinds.select("id", "type"), "id").groupBy("type", "layout").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy(F.desc("n"), "layout")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def running_offsets(runs: DataFrame, order: str = "ordinal", size: str = "n", chunk: int = 10_000) -> DataFrame:
    """Runs with the total of all sizes before them. Totals of chunks of `order` are added up first, so no task sorts all runs."""
    keyed = runs.withColumn("_k", F.floor(F.col(order) / chunk))
    totals = keyed.groupBy("_k").agg(F.sum(size).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    own = Window.partitionBy("_k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("_own", F.coalesce(F.sum(size).over(own), F.lit(0))).join(before, "_k").withColumn("start", F.col("_before") + F.col("_own")).drop("_k", "_own", "_before")


def expand_runs(runs: DataFrame) -> DataFrame:
    """One row for each position of each run."""
    return running_offsets(runs).select("ordinal", "val", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))


def colour_report(hexes: DataFrame, palette: DataFrame, nearest) -> DataFrame:
    """Colours off the palette by count, with the nearest palette colour and whether they look systematic (500 or more) or stray (near, under 10)."""
    unknown = hexes.join(palette.select("rgb").distinct(), "rgb", "left_anti").groupBy("rgb").agg(F.count("*").alias("n"))
    both = unknown.join(nearest(unknown, palette), "rgb")
    kind = F.when(F.col("rgb") == 0, "black").when((F.col("n") < 10) | (F.col("n") < 500) & (F.col("distance") <= 8), "stray").otherwise("unknown")
    return both.withColumn("kind", kind)


def multiset_common(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each key row in both, the lesser of its counts."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("_a")), right.groupBy(*keys).agg(F.count("*").alias("_b"))
    return a.join(b, keys).select(*keys, F.least("_a", "_b").alias("common"))


def semver_key(text: Column) -> Column:
    """A sort key for semantic versions: numbers, then release after pre-release, then identifiers (numeric before words)."""
    core = F.transform(F.split(F.regexp_extract(text, r"^v?([0-9.]+)", 1), r"\."), lambda p: F.lpad(p, 10, "0"))
    pre = F.regexp_extract(text, r"^v?[0-9.]+-([0-9A-Za-z.\-]+)", 1)
    ids = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 10, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return F.struct(core.alias("core"), (pre == "").alias("release"), ids.alias("ids"))

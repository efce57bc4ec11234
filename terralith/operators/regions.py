"""Battle regions: kind suggestion, catchment states, issues and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a primary building chain that give a region's kind, in order.
BUILDING_KINDS = (
    ("lumber", "lumber"), ("livestock", "livestock"), ("iron", "mine_iron"), ("farms_rice", "farm_rice"), ("farms_grain", "farm_grain"),
    ("salt", "salt"), ("trading_port", "trade"), ("tools", "tools"), ("fish", "fish"), ("3k_city_", "city:a"),
)
#: Redirect folder of each resource kind.
RESOURCE_FOLDERS = {
    "lumber": "resource_han_lumber_a_small", "livestock": "resource_han_livestock_a_regular_small", "salt": "resource_han_salt_a_small", "mine_iron": "resource_han_mine_a_iron_large",
    "farm_grain": "resource_han_farm_grain_a_large", "farm_rice": "resource_han_farm_rice_a_large", "tools": "resource_han_tools_a_regular_large",
    "fish": "settlement_port_han_a_small", "trade": "settlement_port_han_b_small",
}


def kind_from_layout(layout: Column) -> Column:
    letter = F.substring(layout, -1, 1)
    city = layout.startswith("settlement_land_layout_") & (F.length(layout) > 23) & letter.between("a", "h")
    return F.when(city, F.concat(F.lit("city:"), letter)).when(F.contains(layout, F.lit("port_layout_1")), "port:a").when(F.contains(layout, F.lit("port_layout_2")), "port:b")


def kind_from_building(building: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(building, F.lit(word)), kind) for word, kind in BUILDING_KINDS])


def suggest_kind(regions: DataFrame, layouts: DataFrame, buildings: DataFrame) -> DataFrame:
    """Regions with kind: from the display layout, else from the primary building, else null."""
    both = regions.join(layouts, "region_key", "left").join(buildings, "region_key", "left")
    return both.withColumn("kind", F.coalesce(kind_from_layout(F.col("layout")), kind_from_building(F.col("building"))))


def folder_table(spark) -> DataFrame:
    """kind, std, unf: the redirect folders of every kind that carries some; each pair belongs to one kind."""
    rows = [(f"city:{c}", f"settlement_city_han_{c}_small_walled", f"settlement_city_han_{c}_small") for c in "abcdefgh"]
    rows += [(f"port:{c}", f"settlement_port_han_{c}_small_walled", f"settlement_port_han_{c}_small") for c in "ab"]
    rows += [(k, f, f) for k, f in RESOURCE_FOLDERS.items()]
    return spark.createDataFrame(rows, "kind string, std string, unf string")


def status(rows: DataFrame, width: int, height: int) -> DataFrame:
    """status and issues of settlements with is_gate, std, unf, gate (ordinals or null), std_folder, unf_folder, found_kind and kind."""
    off = ~(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    none = F.col("std").isNull() & F.col("unf").isNull()
    part = F.col("std").isNull() | F.col("unf").isNull()
    missing = F.coalesce(F.col("std_folder"), F.lit("")) == ""
    wrong = F.col("kind").isNotNull() & F.col("found_kind").isNotNull() & (F.col("kind") != F.col("found_kind"))
    state = (
        F.when(off, "OffGrid").when(F.col("is_gate") & F.col("gate").isNotNull(), "Ok").when(F.col("is_gate") | none, "NoCatchment").when(part, "PartialCatchment")
        .when(missing, "RedirectMissing").when(F.col("found_kind").isNull(), "RedirectInvalid").when(wrong, "WrongType").otherwise("Ok")
    )
    issues = F.filter(F.array(F.when(off, "off the grid"), F.when(~off & ~F.col("is_gate") & F.col("std").isNull(), "no walled area"), F.when(~off & ~F.col("is_gate") & F.col("unf").isNull(), "no open area"), F.when(~off & ~none & missing, "no redirect"), F.when(wrong, "another kind")), lambda i: i.isNotNull())
    return rows.withColumns({"status": state, "issues": issues})


def siege_boxes(rows: DataFrame, width: int, height: int, reach: int = 7) -> DataFrame:
    """A clamped square box around each settlement on the grid that lacks one."""
    lo = lambda c: F.greatest(F.col(c) - reach, F.lit(0))
    hi = lambda c, n: F.least(F.col(c) + reach, F.lit(n - 1))
    inside = rows.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("std").isNull())
    return inside.select("id", lo("x").alias("min_x"), lo("y").alias("min_y"), hi("x", width).alias("max_x"), hi("y", height).alias("max_y"))


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, unsigned 32 bits; the product stays below 2**57."""
    data = F.hex(text.cast("binary"))
    pairs = F.transform(F.sequence(F.lit(0), (F.length(data) / 2).cast("int") - 1), lambda i: F.conv(F.substr(data, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint"))
    step = lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.when(F.length(data) == 0, F.lit(2166136261)).otherwise(F.aggregate(pairs, F.lit(2166136261).cast("bigint"), step))

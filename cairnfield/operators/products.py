"""Whole products: land-cover fractions, fire seasons of several products, composites, banded daily directories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import date_of_year_day
from ..model import month_key
from . import ordered, spatial

#: Sums of plant types.
PLANT_SUMS = {
    "HrbCrp": ("pftHerb", "pftCrop"),
    "TreeAll": ("pftTreeBE", "pftTreeBD", "pftTreeNE", "pftTreeND"),
    "ShrubAll": ("pftShrubBE", "pftShrubBD", "pftShrubNE"),
    "Broadleaf": ("pftTreeBE", "pftTreeBD", "pftShrubBE", "pftShrubBD"),
    "Needleleaf": ("pftTreeNE", "pftTreeND", "pftShrubNE"),
}
#: Attributes of yearly files whose different values are joined, and those that go.
JOINED = ("id", "tracking_id", "creation_date", "contact", "geospatial_lon_max", "geospatial_lon_min", "history", "license", "naming_authority", "product_version", "project", "references", "source", "title", "type")
DROPPED = ("time_coverage_start", "time_coverage_end", "flag_meanings", "flag_values")


def fold_attributes(attributes: DataFrame, file: str = "file", joined: tuple[str, ...] = JOINED, dropped: tuple[str, ...] = DROPPED) -> DataFrame:
    """(key, values): the attributes of merged files, from rows (file, key, value).

    Joined keys get their different values in order; others must be equal in all files, or the result is an error; ``time_coverages`` lists each
    file's start-end in the order of files; dropped keys go.
    """
    known = attributes.where(~F.col("key").isin(*joined, *dropped))
    differ = known.groupBy("key").agg(F.count_distinct("value").alias("n")).where("n > 1")
    plain = attributes.where(~F.col("key").isin(*dropped)).groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    plain = plain.join(F.broadcast(differ), "key", "left").select("key", F.when(F.col("n").isNotNull(), F.raise_error(F.concat(F.lit("files differ in "), "key")).cast("array<string>")).otherwise(F.col("values")).alias("values"))
    spans = attributes.where(F.col("key").isin("time_coverage_start", "time_coverage_end")).groupBy(file).agg(F.max(F.when(F.col("key") == "time_coverage_start", F.col("value"))).alias("a"), F.max(F.when(F.col("key") == "time_coverage_end", F.col("value"))).alias("b"))
    listed = spans.agg(F.array_sort(F.collect_list(F.struct(F.col(file).alias("f"), F.concat_ws("-", "a", "b").alias("s")))).alias("l")).where(F.size("l") > 0)
    return plain.unionByName(listed.select(F.lit("time_coverages").alias("key"), F.transform("l", lambda x: x["s"]).alias("values")))


def landcover(pixels: DataFrame, conversion: DataFrame, source_lat: list[float], source_lon: list[float], target_lat: list[float], target_lon: list[float], keys: tuple[str, ...] = ("year",), sums: dict[str, tuple[str, ...]] | None = None, category: str = "category") -> DataFrame:
    """(keys, lat_idx, lon_idx, a column for each plant type and each sum): fractions on the target grid from category pixels.

    A category's percentages come from a conversion table (category, pft, pct); one that it lacks counts as 0 of all. Fractions are
    averaged by area, and divided by 100. Categories are counted for each target cell first, with the overlaps as weights, so pixels are
    not multiplied by the plant types; only the few categories of a cell are. Columns are named pft and the type, without dots.
    """
    sums = PLANT_SUMS if sums is None else sums
    spark = pixels.sparkSession
    lat = spatial.weight_table(spark, spatial.conservative_weights(source_lat, target_lat, True), "lat")
    lon = spatial.weight_table(spark, spatial.conservative_weights(source_lon, target_lon, False), "lon")
    each = pixels.join(F.broadcast(lat), "lat_idx").join(F.broadcast(lon), "lon_idx")
    mixed = each.groupBy(*keys, F.col("lat_tgt").alias("lat_idx"), F.col("lon_tgt").alias("lon_idx"), category).agg(F.sum(F.col("lat_w") * F.col("lon_w")).alias("_w"))
    # a bounded lookup: the legend's categories times the plant types
    names = sorted(r["pft"] for r in conversion.select("pft").distinct().collect())
    wide = conversion.groupBy(category).pivot("pft", names).agg(F.sum("pct"))
    total = F.sum("_w")
    found = mixed.join(F.broadcast(wide), category, "left").groupBy(*keys, "lat_idx", "lon_idx").agg(*[(F.sum(F.col("_w") * F.coalesce(F.col(f"`{n}`"), F.lit(0))) / total / 100).alias("pft" + n.replace(".", "")) for n in names])
    return found.withColumns({name: sum((F.col(p) for p in parts if p in found.columns), F.lit(0.0)) for name, parts in sums.items()})


def fire_seasons(products: DataFrame, cell: list[str], threshold: float, product: str = "product", month: str = "month", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Season statistics (product, cell, start, end, size, fraction) and season months (product, cell, month) of all products' climatologies at once.

    A cell that any product masks stays out for that product alone, as masks differ between products.
    """
    keys = [product, *cell]
    whole = products.where(F.col(value).isNotNull())
    stats = ordered.fire_season(whole, keys, month, value, threshold)
    return stats, ordered.season_mask(stats, keys)


def composites(table: DataFrame, name: str = "file", pattern: str = r"_(\d{4})(\d{3})_", ignore: tuple[str, ...] = (), days: int = 8, low: float = 0.0, high: float = 1.0, expected_missing: tuple[date, ...] = (), value: str = "value") -> DataFrame:
    """Add start and time (the middle: start + days / 2 less a second) to composites whose names hold year and day of year.

    Names with an ignored year and day go. A value outside low..high is an error, and so is a gap of more than ``days`` between starts, unless its
    first absent start is expected (starts begin anew each year, so the last composite of a year is shorter).
    """
    year, day = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    kept = table.withColumn("_at", F.concat(year, day)).where((F.col("_at") != "") & ~F.col("_at").isin(*ignore)).withColumn("start", date_of_year_day(year.cast("int"), day.cast("int"))).drop("_at")
    outside = F.when((F.col(value) < low) | (F.col(value) > high), F.raise_error(F.lit(f"a value lies outside {low}..{high}")).cast("double")).otherwise(F.col(value))
    starts = kept.select("start").distinct()  # a row a composite
    gaps = starts.withColumn("next", F.lead("start").over(Window.orderBy("start"))).where(F.datediff("next", "start") > days).select(F.date_add("start", days).alias("absent"))
    bad = [r["absent"] for r in gaps.collect() if r["absent"] not in set(expected_missing)]
    if bad:
        raise ValueError(f"composites are missing from {bad}")
    middle = F.timestamp_seconds(F.unix_date("start").cast("long") * 86400 + (days // 2) * 86400 - 1).cast("timestamp_ntz")
    return kept.withColumns({value: outside, "time": middle})


def banded_months(table: DataFrame, cell: list[str], path: str = "path", name: str = "name", band: str = "band", wanted: str = "vegetation optical depth", time: str = "time", value: str = "value") -> DataFrame:
    """(variable, cell, m, value): monthly means of daily files below directories named by year.

    Only variables whose name holds ``wanted`` (in any case) count; the band is added to the name, so that bands stay apart. A file whose directory is not
    a year of four digits is an error.
    """
    directory = F.element_at(F.split(path, "/"), -2)
    checked = F.when(directory.rlike(r"^\d{4}$"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not a year: "), directory)).cast("double"))
    rows = table.where(F.lower(name).contains(wanted)).withColumn(value, checked)
    return rows.groupBy(F.concat_ws(" ", name, band).alias("variable"), *cell, month_key(F.col(time)).alias("m")).agg(F.avg(value).alias(value))


def flip_latitude(cube: DataFrame, n_lat: int) -> DataFrame:
    """Rows stored from the north, numbered from the south."""
    return cube.withColumn("lat_idx", (F.lit(n_lat - 1) - F.col("lat_idx")).cast("int"))


#: Parts of names of variables that are shown on a log scale.
LOG_NAMES = ("burned area", "popd", "dry day period")


def log_scale(name: Column, names: tuple[str, ...] = LOG_NAMES) -> Column:
    """Whether a variable is to be shown on a log scale: its name holds one of the names (underscores as spaces) and not yet ``log``."""
    lower = F.lower(name)
    spaced = F.replace(lower, F.lit("_"), F.lit(" "))
    hit = F.lit(False)
    for n in names:
        hit = hit | lower.contains(n) | spaced.contains(n)
    return hit & ~lower.contains("log")

"""ESRI ASCII grids of any size, read as splittable text.

Spark deals a file's lines over tasks. A line's number comes from the lines before its block (one row for each block of a file is
grouped, and summed along the file) and its place in the block, so no task holds more than one line. Header fields are found by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spatial
from ..tables import broadcast_up_to

#: The fields of a header, in lower case.
FIELDS = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


class HeaderError(ValueError):
    """A grid's header lacks a field."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, text): ids are consecutive in a block of a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.trim(F.regexp_replace("value", r"[\t\r]", " ")).alias("text"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, with the header's fields as doubles (null for one it lacks)."""
    named = _lines(spark, path).where(F.col("text").rlike("^[A-Za-z]")).select("file", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name"), F.regexp_extract("text", r"^\S+\s+(\S+)", 1).cast("double").alias("number"))
    return named.groupBy("file").pivot("name", list(FIELDS)).agg(F.first("number"))


def grids(spark: SparkSession, path: str, lats: tuple[float, float] | None = None, lons: tuple[float, float] | None = None) -> DataFrame:
    """(file, lat_idx, lon_idx, lat, lon, value); lat_idx counts from the south, missing values are NULL.

    lats, lons: rows and columns whose centres lie outside are not split up at all. A file whose header lacks ncols, nrows, a corner or
    a cell size is an error; a file without lines gives no rows.
    """
    head = headers(spark, path)
    x0 = F.coalesce(F.col("xllcorner"), F.col("xllcenter") - F.col("cellsize") / 2)
    y0 = F.coalesce(F.col("yllcorner"), F.col("yllcenter") - F.col("cellsize") / 2)
    known = head.select("file", F.col("ncols").cast("int").alias("n_lon"), F.col("nrows").cast("int").alias("n_lat"), x0.alias("x0"), y0.alias("y0"), F.col("cellsize").alias("step"), F.coalesce("nodata_value", F.lit(-9999.0)).alias("missing"))
    whole = F.col("n_lon").isNotNull() & F.col("n_lat").isNotNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("step").isNotNull()
    known = known.withColumn("n_lat", F.when(whole, F.col("n_lat")).otherwise(F.raise_error(F.concat(F.lit("the header is not whole: "), "file")).cast("int")))
    lines = _lines(spark, path)
    body = F.count(F.when(~F.col("text").rlike("^[A-Za-z]") & (F.col("text") != ""), 1))
    blocks = lines.groupBy("file", "block").agg(body.alias("n"))
    before = blocks.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # header and blank lines stand before or after the values, so a block's first line of values tells the place of the others
    first = lines.where(~F.col("text").rlike("^[A-Za-z]") & (F.col("text") != "")).groupBy("file", "block").agg(F.min("id").alias("first"))
    placed = broadcast_up_to(before.join(first, ["file", "block"]), 100_000)
    rows = lines.where(~F.col("text").rlike("^[A-Za-z]") & (F.col("text") != "")).join(placed, ["file", "block"]).join(broadcast_up_to(known, 10_000), "file")
    rows = rows.withColumn("lat_idx", (F.col("n_lat") - 1 - (F.col("before") + F.col("id") - F.col("first"))).cast("int"))
    rows = rows.withColumn("lat", F.col("y0") + (F.col("lat_idx") + 0.5) * F.col("step"))
    if lats is not None:
        rows = rows.where(F.col("lat").between(*lats))
    values = F.split("text", r" +")
    if lons is not None:
        start = F.greatest(F.lit(0), F.ceil((F.lit(lons[0]) - F.col("x0")) / F.col("step") - 0.5)).cast("int")
        stop = F.least(F.col("n_lon") - 1, F.floor((F.lit(lons[1]) - F.col("x0")) / F.col("step") - 0.5)).cast("int")
        rows = rows.withColumns({"skip": start, "take": F.greatest(F.lit(0), stop - start + 1)})
        values = F.slice(values, F.col("skip") + 1, F.col("take"))
    else:
        rows = rows.withColumn("skip", F.lit(0))
    cells = rows.select("file", "lat_idx", "lat", "x0", "step", "missing", "skip", F.posexplode(values).alias("at", "number"))
    lon_idx, value = F.col("at") + F.col("skip"), F.col("number").cast("double")
    return cells.select("file", "lat_idx", lon_idx.alias("lon_idx"), "lat", (F.col("x0") + (lon_idx + 0.5) * F.col("step")).alias("lon"), F.when(value != F.col("missing"), value).alias("value"))


def regridded(spark: SparkSession, path: str, target_lat: list[float], target_lon: list[float], missing_tolerance: float = 1.0) -> DataFrame:
    """(file, lat_idx, lon_idx, value): grids of one shape brought to the target axes, weighted by area."""
    shape = headers(spark, path).select("ncols", "nrows", F.coalesce("xllcorner", F.col("xllcenter") - F.col("cellsize") / 2).alias("x"), F.coalesce("yllcorner", F.col("yllcenter") - F.col("cellsize") / 2).alias("y"), "cellsize").distinct().limit(2).collect()
    if len(shape) != 1 or None in shape[0]:
        raise HeaderError("the grids differ in shape, or a header is not whole")
    n_lon, n_lat, x, y, step = shape[0]
    lat, lon = [y + (i + 0.5) * step for i in range(int(n_lat))], [x + (j + 0.5) * step for j in range(int(n_lon))]
    return spatial.regrid_to(grids(spark, path), lat, lon, target_lat, target_lon, ["file"], "conservative", missing_tolerance)


def write(cube: DataFrame, path: str, x0: float, y0: float, step: float, missing: float = -9999.0) -> None:
    """One grid (lat_idx, lon_idx, value) as a folder of text parts in order, headed by the first."""
    lines = cube.groupBy("lat_idx").agg(F.array_sort(F.collect_list(F.struct("lon_idx", F.coalesce("value", F.lit(missing)).alias("v")))).alias("cells"))
    size = cube.agg(F.count_distinct("lat_idx").alias("rows"), F.count_distinct("lon_idx").alias("cols")).first()
    head = [f"ncols {size['cols']}", f"nrows {size['rows']}", f"xllcorner {x0}", f"yllcorner {y0}", f"cellsize {step}", f"NODATA_value {missing}"]
    first = cube.sparkSession.createDataFrame([(1 << 30, "\n".join(head))], "lat_idx int, text string")
    text = lines.select("lat_idx", F.array_join(F.transform("cells", lambda c: c["v"].cast("string")), " ").alias("text")).unionByName(first)
    text.coalesce(1).sortWithinPartitions(F.desc("lat_idx")).select("text").write.text(path)

"""The cube: one row per variable, time and cell; a masked value is a NULL in a row that is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import broadcast_up_to

CUBE = T.StructType(
    [
        T.StructField("variable", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("lat_idx", T.IntegerType()),
        T.StructField("lon_idx", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)
META = T.StructType([T.StructField(n, T.StringType()) for n in ("dataset", "dataset_pretty", "variable", "variable_pretty", "units", "frequency")] + [T.StructField(n, T.IntegerType()) for n in ("min_month", "max_month")])
CELL = ["lat_idx", "lon_idx"]


class NonUniformCoordError(ValueError):
    """An axis neither rises nor falls throughout."""


def month_key(time: Column) -> Column:
    """Months since year 0, so that differences are whole months."""
    return (F.year(time) * 12 + F.month(time) - 1).cast("int")


def month_key_of(year: int, month: int) -> int:
    return year * 12 + month - 1


def month_start(key: Column) -> Column:
    """The first day of a month key."""
    return F.make_date(F.floor(key / 12).cast("int"), (F.pmod(key, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def full_frame(cube: DataFrame, time: str, cell: list[str], value: str = "value") -> DataFrame:
    """Every (time, cell) as a row, NULL where the cube has none. The axes are the cube's own distinct values."""
    times, cells = cube.select(time).distinct(), cube.select(*cell).distinct()
    return cells.crossJoin(times).join(cube.select(time, *cell, value), [time, *cell], "left")


def validate_cube(cube: DataFrame) -> DataFrame:
    """One row with the number of violations of each invariant."""
    dup = cube.groupBy("variable", "time", *CELL).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_cells"))
    lat = cube.select("lat_idx", "lat").distinct().alias("a")
    order = lat.join(lat.alias("b"), F.col("a.lat_idx") + 1 == F.col("b.lat_idx")).agg(F.count(F.when(F.col("a.lat") >= F.col("b.lat"), 1)).alias("lat_not_rising"))
    rng = cube.agg(F.count(F.when(~F.col("lon").between(-180, 180), 1)).alias("lon_out_of_range"), F.count(F.when(~F.col("lat").between(-90, 90), 1)).alias("lat_out_of_range"))
    return dup.crossJoin(order).crossJoin(rng)


def repair_axes(cube: DataFrame) -> DataFrame:
    """Longitudes into [-180, 180) and both axes numbered upwards from 0."""
    moved = cube.withColumn("lon", F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180)
    for axis in ("lat", "lon"):
        from pyspark.sql import Window

        places = moved.select(axis).distinct().withColumn(f"{axis}_idx", F.row_number().over(Window.orderBy(axis)) - 1)
        moved = moved.drop(f"{axis}_idx").join(F.broadcast(places), axis)
    return moved.select(*CUBE.fieldNames())


def replace_axis(cube: DataFrame, points: DataFrame, axis: str) -> DataFrame:
    """The cube with new points (axis_idx, point) on an axis; a cell whose number has no new point is an error."""
    new = points.select(f"{axis}_idx", F.col("point").alias("_point"), F.lit(True).alias("_known"))
    joined = cube.drop(axis).join(broadcast_up_to(new, 1_000_000), f"{axis}_idx", "left")
    found = F.when(F.col("_known"), F.col("_point")).otherwise(F.raise_error(F.concat(F.lit(f"no point for {axis} "), F.col(f"{axis}_idx").cast("string"))).cast("double"))
    return joined.withColumn(axis, found).drop("_point", "_known")


def reorder_axis(cube: DataFrame, order: list[int], axis: str, points: list[float] | None = None) -> DataFrame:
    """The cube with an axis in another order: new place i holds what was at order[i], under new points if given. The order must be a permutation."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("the order is no permutation")
    if points is not None and len(points) != len(order):
        raise ValueError("there are as many points as places")
    table = cube.sparkSession.createDataFrame([(old, new, None if points is None else float(points[new])) for new, old in enumerate(order)], f"{axis}_idx int, _new int, _point double")
    moved = cube.join(F.broadcast(table), f"{axis}_idx").withColumn(f"{axis}_idx", F.col("_new"))
    return (moved if points is None else moved.withColumn(axis, F.col("_point"))).drop("_new", "_point")


def synthetic_cube(spark, n_lat: int, n_lon: int, n_months: int = 0, value: Column | None = None, variable: str = "dummy", lat_lims=(-90.0, 90.0), lon_lims=(-180.0, 180.0), start: int = 1970 * 12) -> DataFrame:
    """Evenly spaced cell centres; with months, one slab a month from ``start``. value: of t, lat_idx, lon_idx."""
    months = max(1, n_months)
    rows = spark.range(months * n_lat * n_lon).select(
        (F.col("id") / (n_lat * n_lon)).cast("int").alias("t"), (F.pmod(F.col("id"), F.lit(n_lat * n_lon)) / n_lon).cast("int").alias("lat_idx"), F.pmod(F.col("id"), F.lit(n_lon)).cast("int").alias("lon_idx")
    )
    h_lat, h_lon = (lat_lims[1] - lat_lims[0]) / n_lat, (lon_lims[1] - lon_lims[0]) / n_lon
    time = month_start(F.col("t") + start) if n_months else F.lit(None).cast("timestamp_ntz")
    return rows.select(
        F.lit(variable).alias("variable"), time.alias("time"), "lat_idx", "lon_idx", (lat_lims[0] + (F.col("lat_idx") + 0.5) * h_lat).alias("lat"), (lon_lims[0] + (F.col("lon_idx") + 0.5) * h_lon).alias("lon"), (F.lit(0.0) if value is None else value).cast("double").alias("value")
    )

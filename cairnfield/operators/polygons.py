"""Points in polygons whose edges are a table, for coastlines of any size.

An edge table has a row (polygon, x1, y1, x2, y2) for each edge of each ring; x is the longitude. Holes are further rings of the same
polygon (even-odd rule), parts of a coastline polygons of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import broadcast_up_to, materialize

#: The first and last slice of a degree of longitude; what lies further is in them.
FAR = 400


def edges(vertices: DataFrame, polygon: str = "polygon", ring: str = "ring", place: str = "place", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(polygon, x1, y1, x2, y2) from ordered vertices; the last vertex of a ring is joined to its first.

    Rings of one vertex make no edge that counts; rows with a null coordinate are no vertices.
    """
    rows = vertices.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    by = Window.partitionBy(polygon, ring).orderBy(place)
    ends = F.struct(F.col(lon).alias("x"), F.col(lat).alias("y"))
    start = F.first(ends).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.coalesce(F.lead(ends).over(by), start)
    return rows.select(F.col(polygon).alias("polygon"), F.col(lon).cast("double").alias("x1"), F.col(lat).cast("double").alias("y1"), after["x"].cast("double").alias("x2"), after["y"].cast("double").alias("y2"))


def crossings(lats: DataFrame, edge_table: DataFrame, lat: str, band: float = 1.0) -> DataFrame:
    """(lat, polygon, x): where the edges of each polygon cross each of the latitudes, a row for each crossing.

    Edges are dealt to the latitude bands that they touch, so a latitude meets the edges of its band alone. A horizontal edge crosses
    none; of an edge's two ends the upper counts (an edge crosses y if one end lies above it and the other not).
    """
    of = lambda y: F.floor(F.col(y) / band).cast("int")
    tall = edge_table.where("y1 != y2").withColumn("_band", F.explode(F.sequence(F.least(of("y1"), of("y2")), F.greatest(of("y1"), of("y2")))))
    rows = lats.select(lat).where(F.col(lat).isNotNull()).distinct().withColumn("_band", of(lat))
    y = F.col(lat)
    met = tall.join(broadcast_up_to(rows, 100_000), "_band").where((F.col("y1") > y) != (F.col("y2") > y))
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return met.select(lat, "polygon", x.alias("x")).where("x is not null")


def _carried(met: DataFrame) -> DataFrame:
    """(_line, polygon, x, _slice): an endless crossing in each slice that lies west of an odd number of a polygon's crossings in further slices."""
    by = Window.partitionBy("_line", "polygon").orderBy(F.desc("_slice"))
    counted = met.groupBy("_line", "polygon", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    east = counted.select("_line", "polygon", F.col("_slice").alias("_east"), F.sum("_n").over(by).alias("_n"), F.coalesce(F.lead("_slice").over(by), F.lit(-FAR)).alias("_west"))
    slices = F.explode(F.sequence(F.col("_west"), F.col("_east") - 1)).alias("_slice")
    return east.where("_n % 2 = 1 and _west < _east").select("_line", "polygon", F.lit(float("inf")).alias("x"), slices)


def inside(points: DataFrame, edge_table: DataFrame, lat: str = "lat", lon: str = "lon", ignore: list = (), name: str = "inside", band: float = 1.0) -> DataFrame:
    """Add a boolean column: whether the point lies in any polygon but the ignored ones.

    A point lies in a polygon if the polygon's edges cross its latitude an odd number of times east of it. The crossings are found once for
    each different latitude (a grid has few). Points and crossings of a latitude then meet in one window over slices of a degree of longitude: from
    the east, a polygon's crossings open and close it in turn, and a point lies in as many polygons as are open. So the work
    is a sort of both, however many there are on a latitude. Points without coordinates lie in none.
    """
    if name.lower() in (c.lower() for c in points.columns):
        raise ValueError(f"there is a column {name}")
    used = edge_table.where(~F.col("polygon").isin(*ignore)) if ignore else edge_table
    slice_ = F.floor(F.least(F.greatest(F.col("x"), F.lit(-FAR)), F.lit(FAR))).cast("int").alias("_slice")
    placed = points.select(F.col(lat).cast("double").alias("_line"), F.col(lon).cast("double").alias("x"), F.struct(*points.columns).alias("_row"))
    met = materialize(crossings(placed, used, "_line", band).select("*", slice_), "crossings")
    lines = met.unionByName(_carried(met)).withColumn("_point", F.lit(False))
    some = F.col("_line").isNotNull() & F.col("x").isNotNull()
    both = lines.unionByName(placed.where(some).select("*", slice_, F.lit(True).alias("_point")), allowMissingColumns=True).repartition("_line", "_slice")
    turn = F.row_number().over(Window.partitionBy("_line", "_slice", "_point", "polygon").orderBy(F.desc("x"))) % 2
    turned = both.withColumn("_turn", F.when(F.col("_point"), 0).otherwise(2 * turn - 1))
    # a crossing at the point's own place is not east of it
    by = Window.partitionBy("_line", "_slice").orderBy(F.desc("x"), F.desc("_point")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = turned.withColumn("_open", F.sum("_turn").over(by)).where("_point").select("_row.*", (F.col("_open") > 0).alias(name))
    return found.unionByName(placed.where(~some).select("_row.*", F.lit(False).alias(name)))


def grid_mask(spark, edge_table: DataFrame, n_lon: int = 1440, ignore: list = ()) -> DataFrame:
    """(lat_idx, lon_idx, lat, lon, land) of the world grid of n_lon x n_lon / 2 cells: whether a cell's centre lies in a polygon."""
    if n_lon % 2:
        raise ValueError("the number of longitudes has to be even")
    step = 360 / n_lon
    rows = spark.range(n_lon * n_lon // 2).select((F.col("id") / n_lon).cast("int").alias("lat_idx"), F.pmod("id", F.lit(n_lon)).cast("int").alias("lon_idx"))
    cells = rows.withColumns({"lat": -90 + (F.col("lat_idx") + 0.5) * step, "lon": -180 + (F.col("lon_idx") + 0.5) * step})
    return inside(cells, edge_table, ignore=list(ignore), name="land")

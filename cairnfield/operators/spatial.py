"""Regridding by weight tables, land-cover lookups, tiles and areas."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounds(centres: list[float]) -> list[tuple[float, float]]:
    """Cell bounds of evenly spaced centres."""
    h = (centres[1] - centres[0]) / 2 if len(centres) > 1 else 0.5
    return [(c - h, c + h) for c in centres]


def overlaps(source: list[tuple[float, float]], target: list[tuple[float, float]], tol: float = 1e-9) -> list[list[int]]:
    """For each target cell the source cells that overlap it by more than tol; none at all is an error."""
    src, tgt = _pairs(np.array(source, float).reshape(-1, 2), np.array(target, float).reshape(-1, 2), tol)
    if not len(src):
        raise ValueError("the axes do not overlap")
    ends = np.searchsorted(tgt, np.arange(len(target) + 1))
    return [src[a:b].tolist() for a, b in itertools.pairwise(ends)]


def _pairs(source: np.ndarray, target: np.ndarray, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(source, target) numbers of the cells that overlap, by target, then source: a merge of the two sorted axes.

    Cells of an axis do not overlap each other, so those that meet a target cell are a stretch of the sorted axis.
    """
    order = np.argsort(source[:, 0], kind="stable")
    low, high = source[order, 0], source[order, 1]
    first = np.searchsorted(high, target[:, 0] + tol, "right")
    n = np.maximum(np.searchsorted(low, target[:, 1] - tol, "left") - first, 0)
    tgt = np.repeat(np.arange(len(target)), n)
    src = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
    by = np.lexsort((src, tgt))
    return src[by], tgt[by]


def _weights(src: np.ndarray, tgt: np.ndarray, w: np.ndarray) -> list[tuple[int, int, float]]:
    return list(zip(src.tolist(), tgt.tolist(), w.tolist(), strict=True))


def conservative_weights(source: list[float], target: list[float], is_lat: bool) -> list[tuple[int, int, float]]:
    """(src, tgt, weight): overlap in degrees of longitude or in sin of latitude."""
    s, t = np.array(bounds(source)), np.array(bounds(target))
    src, tgt = _pairs(s, t)
    if not len(src):
        raise ValueError("the axes do not overlap")
    low, high = np.maximum(s[src, 0], t[tgt, 0]), np.minimum(s[src, 1], t[tgt, 1])
    if is_lat:
        low, high = np.sin(np.radians(np.maximum(low, -90))), np.sin(np.radians(np.minimum(high, 90)))
    return _weights(src, tgt, high - low)


def nearest_weights(source: list[float], target: list[float]) -> list[tuple[int, int, float]]:
    """The nearest source cell of each target, of equally near ones the first."""
    s, t = np.array(source, float), np.array(target, float)
    order = np.argsort(s, kind="stable")
    at = np.searchsorted(s[order], t)
    around = np.clip(np.stack([at - 1, at]), 0, len(s) - 1)
    # of equal points the first: move each candidate to the start of its run
    around = order[np.searchsorted(s[order], s[order][around])]
    far = np.abs(s[around] - t)
    pick = np.where((far[0] < far[1]) | ((far[0] == far[1]) & (around[0] < around[1])), around[0], around[1])
    return _weights(pick, np.arange(len(t)), np.ones(len(t)))


def linear_weights(source: list[float], target: list[float], circular: float | None = None) -> list[tuple[int, int, float]]:
    """Bracketing cells by distance; a circular axis goes on past its ends; others extrapolate from their outer cells."""
    number, points, x = np.arange(len(source)), np.array(source, float), np.array(target, float)
    if circular:
        number = np.concatenate(([len(source) - 1], number, [0]))
        points = np.concatenate(([points[-1] - circular], points, [points[0] + circular]))
    k = np.clip(np.searchsorted(points, x, "right") - 1, 0, len(points) - 2)
    w = (x - points[k]) / (points[k + 1] - points[k])
    src, tgt, weight = np.stack([number[k], number[k + 1]], 1).ravel(), np.repeat(np.arange(len(x)), 2), np.stack([1 - w, w], 1).ravel()
    return _weights(src[weight != 0], tgt[weight != 0], weight[weight != 0])


def weight_table(spark: SparkSession, weights: list[tuple[int, int, float]], axis: str) -> DataFrame:
    src, tgt, w = zip(*weights, strict=True) if weights else ((), (), ())
    columns = [np.array(src, np.int32), np.array(tgt, np.int32), np.array(w, float)]
    return spark.createDataFrame(pa.table(columns, names=[f"{axis}_idx", f"{axis}_tgt", f"{axis}_w"]))


def regrid(cube: DataFrame, lat_weights: DataFrame, lon_weights: DataFrame, keys: list[str], scheme: str = "nearest", missing_tolerance: float = 1.0, value: str = "value") -> DataFrame:
    """(keys, lat_idx, lon_idx, value) on the target grid.

    The weight tables follow the two axes, not the data, and are broadcast. conservative: masked cells
    leave the weights, and a target is masked if more than ``missing_tolerance`` of its weight is; bilinear: masked
    if any contributor is, or if the value lies beyond the source slice's range by more than that range.
    """
    each = cube.join(F.broadcast(lat_weights), "lat_idx").join(F.broadcast(lon_weights), "lon_idx").withColumn("_w", F.col("lat_w") * F.col("lon_w"))
    valid = F.when(F.col(value).isNotNull(), F.col("_w"))
    out = each.groupBy(*keys, F.col("lat_tgt").alias("lat_idx"), F.col("lon_tgt").alias("lon_idx")).agg(F.sum(F.col("_w") * F.col(value)).alias("_s"), F.sum(valid).alias("_ok"), F.sum("_w").alias("_all"))
    if scheme == "conservative":
        share = 1 - F.coalesce("_ok", F.lit(0.0)) / F.col("_all")
        result = F.when(share <= missing_tolerance + 1e-12, F.try_divide("_s", "_ok"))
        return out.select(*keys, "lat_idx", "lon_idx", result.alias(value))
    out = out.select(*keys, "lat_idx", "lon_idx", F.when(F.col("_ok") >= F.col("_all") - 1e-12, F.col("_s")).alias(value))
    if scheme == "bilinear":
        span = cube.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        guard = F.col(value).between(2 * F.col("_lo") - F.col("_hi"), 2 * F.col("_hi") - F.col("_lo"))
        out = (out.join(span, keys) if keys else out.crossJoin(F.broadcast(span))).select(*keys, "lat_idx", "lon_idx", F.when(guard, F.col(value)).alias(value))
    return out


def regrid_to(cube: DataFrame, source_lat: list[float], source_lon: list[float], target_lat: list[float], target_lon: list[float], keys: list[str], scheme: str = "nearest", missing_tolerance: float = 1.0, value: str = "value") -> DataFrame:
    """As regrid, with the weights made from the axes; equal axes give the cube back."""
    if source_lat == target_lat and source_lon == target_lon:
        return cube.select(*keys, "lat_idx", "lon_idx", value)
    make = {
        "nearest": lambda: (nearest_weights(source_lat, target_lat), nearest_weights(source_lon, target_lon)),
        "conservative": lambda: (conservative_weights(source_lat, target_lat, True), conservative_weights(source_lon, target_lon, False)),
        "bilinear": lambda: (linear_weights(source_lat, target_lat), linear_weights(source_lon, target_lon, 360.0 if abs(source_lon[-1] - source_lon[0] + (source_lon[1] - source_lon[0]) - 360) < 1e-6 else None)),
    }
    if scheme not in make:
        raise ValueError(f"scheme must be one of {sorted(make)}")
    lat, lon = make[scheme]()
    return regrid(cube, weight_table(cube.sparkSession, lat, "lat"), weight_table(cube.sparkSession, lon, "lon"), keys, scheme, missing_tolerance, value)


def category_fractions(cells: DataFrame, conversion: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """One row per cell and name with its percentage; unknown categories give 0.

    conversion: (category, pft, pct), a bounded lookup table.
    """
    names = conversion.select("pft").distinct()
    table = conversion.select(category).distinct().crossJoin(names).join(conversion, [category, "pft"], "left").groupBy(category).agg(F.map_from_entries(F.collect_list(F.struct("pft", F.coalesce("pct", F.lit(0)).alias("pct")))).alias("_m"))
    every = names.agg(F.array_sort(F.collect_list("pft")).alias("_names"))
    out = cells.join(F.broadcast(table), category, "left").crossJoin(F.broadcast(every))
    return out.select(*keys, F.explode("_names").alias("pft"), "_m").select(*keys, "pft", F.coalesce(F.try_element_at("_m", F.col("pft")), F.lit(0)).alias("pct"))


def sums_of_fractions(wide: DataFrame, groups: dict[str, list[str]], scale: float = 0.01) -> DataFrame:
    """Columns that add up others, scaled (percent to fractions)."""
    return wide.withColumns({name: sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0)) * scale for name, cols in groups.items()})


def mosaic(pixels: DataFrame, size: int, tiles: int, least_tiles: int = 200, allowed: tuple = (), keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(keys, row, col, value): pixels (h, v, i, j) placed in the world grid, rows counted upwards; dates with too few tiles go."""
    count = pixels.groupBy(*keys).agg(F.count_distinct(F.struct("h", "v")).alias("_tiles"))
    enough = count.where((F.col("_tiles") >= least_tiles) | F.col(keys[0]).isin(*allowed) if allowed else F.col("_tiles") >= least_tiles)
    return pixels.join(enough, list(keys)).select(*keys, (tiles * size - 1 - (F.col("v") * size + F.col("i"))).alias("row"), (F.col("h") * size + F.col("j")).alias("col"), "value")


def cell_area(lat: Column, d_lat: float, d_lon: float, radius: float = 6367470.0) -> Column:
    """Area in square metres of the cell around a latitude."""
    return radius**2 * math.radians(d_lon) * (F.sin(F.radians(lat + d_lat / 2)) - F.sin(F.radians(lat - d_lat / 2)))


def coarsen(pixels: DataFrame, keys: list[str], lat: Column, lon: Column, step: float = 0.25, scale: float = 1.0, value: str = "value") -> DataFrame:
    """Mean of the valid pixels in each cell of ``step`` degrees."""
    return pixels.groupBy(*keys, F.floor((lat + 90) / step).alias("lat_idx"), F.floor((lon + 180) / step).alias("lon_idx")).agg((F.avg(value) * scale).alias(value))


#: Fire regions of the basis-region raster, by code.
REGIONS = {
    0: ("Ocean", "Ocean"),
    1: ("BONA", "Boreal North America"),
    2: ("TENA", "Temperate North America"),
    3: ("CEAM", "Central America"),
    4: ("NHSA", "Northern Hemisphere South America"),
    5: ("SHSA", "Southern Hemisphere South America"),
    6: ("EURO", "Europe"),
    7: ("MIDE", "Middle East"),
    8: ("NHAF", "Northern Hemisphere Africa"),
    9: ("SHAF", "Southern Hemisphere Africa"),
    10: ("BOAS", "Boreal Asia"),
    11: ("CEAS", "Central Asia"),
    12: ("SEAS", "Southeast Asia"),
    13: ("EQAS", "Equatorial Asia"),
    14: ("AUST", "Australia and New Zealand"),
}


def region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGIONS.items()], "region int, code string, name string")




def footprint_shares(pixels: DataFrame, size: int, step: float = 0.25) -> DataFrame:
    """Pixels (h, v, i, j of a sinusoidal tile grid of size x size pixels a tile) with (lat_idx, lon_idx, share) of each cell they touch.

    Tiles are 10 degrees wide and high at the equator, numbered from the north-west. The projection keeps areas, and a degree of longitude
    is cos(latitude) wide in it, so a pixel is cut at the cells' parallels, each strip at the meridians as they run at the strip's middle: a share
    is the strip's part of the height times the part of the width. Shares of a pixel sum to 1; what lies beyond the globe's edge has none.
    """
    edge = 10.0 / size
    top, west = F.lit(90.0) - (F.col("v") * size + F.col("i")) * edge, F.lit(-180.0) + (F.col("h") * size + F.col("j")) * edge
    rows = pixels.withColumns({"_n": top, "_s": top - edge, "_w": west, "_e": west + edge})
    first = F.floor((F.col("_s") + 90) / step + 1e-9).cast("int")
    last = F.greatest(first, F.ceil((F.col("_n") + 90) / step - 1e-9).cast("int") - 1)
    strips = rows.withColumn("lat_idx", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("_s"), F.col("lat_idx") * step - 90), F.least(F.col("_n"), (F.col("lat_idx") + 1) * step - 90)
    strips = strips.withColumns({"_part": (high - low) / edge, "_cos": F.cos(F.radians((low + high) / 2))})
    a, b = F.greatest(F.lit(-180.0), F.col("_w") / F.col("_cos")), F.least(F.lit(180.0), F.col("_e") / F.col("_cos"))
    strips = strips.withColumns({"_a": a, "_b": b}).where((F.col("_part") > 1e-12) & (F.col("_b") - F.col("_a") > 1e-12))
    left = F.floor((F.col("_a") + 180) / step + 1e-9).cast("int")
    right = F.greatest(left, F.ceil((F.col("_b") + 180) / step - 1e-9).cast("int") - 1)
    cells = strips.withColumn("lon_idx", F.explode(F.sequence(left, right)))
    width = F.least(F.col("_b"), (F.col("lon_idx") + 1) * step - 180) - F.greatest(F.col("_a"), F.col("lon_idx") * step - 180)
    share = F.col("_part") * width * F.col("_cos") / edge
    return cells.withColumn("share", share).where("share > 0").drop("_n", "_s", "_w", "_e", "_part", "_cos", "_a", "_b")


def footprint_average(pixels: DataFrame, size: int, step: float = 0.25, keys: tuple[str, ...] = ("date",), scale: float = 1.0, value: str = "value") -> DataFrame:
    """(keys, lat_idx, lon_idx, value): the mean of the valid pixels that touch a cell, weighted by the area of the touch, times the scale.

    The sums of shares are combined before the shuffle. A cell that valid pixels do not touch has no row.
    """
    each = footprint_shares(pixels.where(F.col(value).isNotNull()), size, step)
    out = each.groupBy(*keys, "lat_idx", "lon_idx").agg((F.sum(F.col("share") * F.col(value)) / F.sum("share") * scale).alias(value))
    return out.select(*keys, "lat_idx", "lon_idx", value)


def tile_product(pixels: DataFrame, size: int, step: float = 0.25, least_tiles: int = 200, allowed: tuple = (), keys: tuple[str, ...] = ("date",), largest: int = 100, bits: int = 0b11010111, scale: float = 0.01) -> DataFrame:
    """Tiled pixels (keys, h, v, i, j, value, qc) to fractions on the world grid: quality mask, dates with enough tiles, average by footprint, scale."""
    from .masks import quality_mask

    good = pixels.withColumn("value", quality_mask(F.col("value"), F.col("qc"), largest, bits).cast("double"))
    count = pixels.groupBy(*keys).agg(F.count_distinct("h", "v").alias("_tiles"))
    enough = F.col("_tiles") >= least_tiles
    kept = good.join(count.where(enough | F.col(keys[0]).isin(*allowed) if allowed else enough).drop("_tiles"), list(keys))
    return footprint_average(kept, size, step, keys, scale)

"""Variograms, mergeable statistics, correlation, histograms, scores and fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EARTH_KM, haversine_km
from ..tables import broadcast_up_to, materialize


def variogram(points: DataFrame, pid: str, lat: str, lon: str, x: str, bins: int, max_lag: float, per_slice: int = 2048) -> DataFrame:
    """(bin, low, high, n, semivariance): half the population variance of the signed differences x_i - x_j, i > j.

    Points are dealt into latitude bands of ``max_lag`` km, and these into cells of longitude that are as wide as two points
    of neighbouring bands within that distance can be apart; only equal and neighbouring cells meet. Cells are counted, and a cell
    is dealt over slices of about ``per_slice`` points, so a task's pairs are bounded by them however crowded a cell is; points go to the slices
    of cells that have points alone.
    """
    named = [F.col(c).alias(n) for c, n in ((pid, "id"), (lat, "lat"), (lon, "lon"), (x, "x"))]
    band_of = F.floor(F.radians(F.col("lat")) * EARTH_KM / max_lag).cast("int")
    height = max_lag / EARTH_KM

    def cells(band: Column) -> Column:
        """How many cells a band has: the nearest pole's parallel of its neighbours bounds the longitudes between two points."""
        narrow = F.cos(F.least(F.greatest(F.abs((band - 1) * height), F.abs((band + 2) * height)), F.lit(math.pi / 2)))
        reach = 2 * F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(math.sin(min(height, math.pi) / 2)), F.greatest(narrow, F.lit(1e-12)))))
        return F.greatest(F.lit(1), F.floor(2 * math.pi / reach).cast("int"))

    def cell(lon: Column, n: Column) -> Column:
        return F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360 * n).cast("int"), n - 1)

    a = points.select(*named).withColumn("band", band_of)
    a = a.select("band", cell(F.col("lon"), cells(F.col("band"))).alias("cell"), *[F.col(n).alias(f"a_{n}") for n in ("id", "lat", "lon", "x")])
    counted = materialize(a.groupBy("band", "cell").agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("int").alias("slices")), "cells")
    sizes = broadcast_up_to(counted, 100_000)
    a = a.join(sizes, ["band", "cell"]).withColumn("slice", F.pmod(F.xxhash64("a_id"), F.col("slices")).cast("int")).drop("slices")
    b = points.select(*named).withColumn("band", F.explode(F.array(band_of - 1, band_of, band_of + 1))).withColumn("n", cells(F.col("band")))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(cell(F.col("lon"), F.col("n")) + i, F.col("n"))))
    b = b.withColumn("cell", F.explode(near)).join(sizes, ["band", "cell"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    b = b.select("band", "cell", "slice", *[F.col(n).alias(f"b_{n}") for n in ("id", "lat", "lon", "x")])
    pairs = a.join(b, ["band", "cell", "slice"]).where("a_id > b_id").withColumn("d", haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).where(F.col("d") < max_lag)
    width = max_lag / bins
    found = pairs.groupBy(F.floor(F.col("d") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.var_pop(F.col("a_x") - F.col("b_x")) / 2).alias("semivariance"))
    every = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("semivariance", F.lit(0.0)).alias("semivariance"))


def merge_stats(parts: DataFrame, keys: list[str], n: str = "n", mean: str = "mean", var: str = "var") -> DataFrame:
    """(keys, n, mean, var) of the union of parts, from their sizes, means and population variances."""
    total, first = F.sum(n), F.sum(F.col(n) * F.col(mean))
    second = F.sum(F.col(n) * (F.col(var) + F.col(mean) * F.col(mean)))
    out = parts.groupBy(*keys).agg(total.alias("n"), F.try_divide(first, total).alias("mean"), F.try_divide(second, total).alias("_m2"))
    return out.select(*keys, "n", "mean", F.greatest(F.lit(0.0), F.col("_m2") - F.col("mean") * F.col("mean")).alias("var"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of different columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(each))


def vif(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """1 / (1 - R^2) of each column on the others: the diagonal of the inverse correlation matrix (columns x columns)."""
    import numpy as np

    matrix = np.eye(len(columns))
    for r in correlations(rows, columns).collect():
        i, j = columns.index(r["a"]), columns.index(r["b"])
        matrix[i, j] = matrix[j, i] = r["r"]
    return dict(zip(columns, np.diag(np.linalg.inv(matrix)).tolist(), strict=True))


def vif_pair(a: Column, b: Column) -> Column:
    """1 / (1 - R^2) of two columns: infinite if one follows from the other, null if one is constant."""
    share = F.regr_r2(a, b)
    return F.coalesce(F.try_divide(F.lit(1.0), 1 - share), F.when(share.isNotNull(), F.lit(float("inf"))))


def histogram(rows: DataFrame, value: str, bins: int = 70) -> DataFrame:
    """(bin, low, n, density) of valid values over their range; the last bin holds its upper edge. A constant column's range is its value -0.5 .. +0.5."""
    half = F.when(F.min(value) == F.max(value), 0.5).otherwise(0.0)
    span = rows.agg((F.min(value) - half).alias("_lo"), (F.max(value) + half).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    each = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int"))
    return each.groupBy("bin").agg(F.first(F.col("_lo") + F.col("bin") * width).alias("low"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.first(F.col("_n") * width)).alias("density"))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(keys, share, percentile): linear between the two values at share * (n - 1), as numpy gives it.

    Keys of up to 2 * accuracy rows are put in order by a window. Of larger ones an approximate sketch, whose ranks are off by
    n / accuracy at most, brackets the two wanted ranks; values below the bracket are counted and only those in it are put in order,
    equal ones as one row. So no task orders more than some 2 * accuracy values of a key, and a rank outside its bracket is an error.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * accuracy).drop("_n").withColumn("_large", F.lit(True)), "large")
    if large.limit(1).count() == 0:
        return _ordered_percentiles(rows, keys, shares)
    if not keys:
        return _bracketed_percentiles(rows, keys, shares, accuracy)
    side = broadcast_up_to(large.drop("_large"), 100_000)
    return _ordered_percentiles(rows.join(side, keys, "left_anti"), keys, shares).unionByName(_bracketed_percentiles(rows.join(side, keys, "left_semi"), keys, shares, accuracy))


def _ordered_percentiles(rows: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """exact_percentiles of (keys, _v) by each value's place in its key."""
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at, parts = [], []
    for i, s in enumerate(shares):
        rank = F.lit(s) * (F.col("_n") - 1)
        first, last = F.floor(rank + 1e-9), F.ceil(rank - 1e-9)
        at += [F.min(F.when(F.col("_k") == first, F.col("_v"))).alias(f"_low{i}"), F.min(F.when(F.col("_k") == last, F.col("_v"))).alias(f"_high{i}")]
        at.append(F.first(F.greatest(rank - first, F.lit(0.0))).alias(f"_part{i}"))
        value = F.col(f"_low{i}") + F.col(f"_part{i}") * (F.col(f"_high{i}") - F.col(f"_low{i}"))
        parts.append(F.struct(F.lit(s).alias("share"), value.alias("percentile")))
    return placed.groupBy(*keys).agg(*at).select(*keys, F.inline(F.array(*parts))).where("percentile is not null")


def _bracketed_percentiles(rows: DataFrame, keys: list[str], shares: list[float], accuracy: int) -> DataFrame:
    """exact_percentiles of (keys, _v) of large keys."""
    slack = 3 / accuracy
    edges = F.percentile_approx("_v", F.array(*[F.lit(min(1.0, max(0.0, s + e))) for s in shares for e in (-slack, slack)]), F.lit(accuracy))
    brackets = rows.groupBy(*keys).agg(edges.alias("_e"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    small = F.col("_n") <= 2 * accuracy
    low = lambda i, s: F.when(small | F.lit(s <= slack), F.col("_least")).otherwise(F.get("_e", F.lit(2 * i)))
    high = lambda i, s: F.when(small | F.lit(s >= 1 - slack), F.col("_most")).otherwise(F.get("_e", F.lit(2 * i + 1)))
    listed = F.array(*[F.struct(F.lit(s).alias("share"), low(i, s).alias("_a"), high(i, s).alias("_b")) for i, s in enumerate(shares)])
    brackets = materialize(brackets.select(*keys, "_n", F.inline(listed)), "brackets")
    side = broadcast_up_to(brackets, 100_000)
    each = rows.join(side, keys) if keys else rows.crossJoin(F.broadcast(brackets))  # without keys: a row for each share
    below = each.where("_v < _a").groupBy(*keys, "share").agg(F.count(F.lit(1)).alias("_below"))
    inside = each.where("_v between _a and _b").groupBy(*keys, "share", "_v").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*keys, "share").orderBy("_v")
    placed = inside.withColumn("_to", F.sum("_c").over(by)).join(below, [*keys, "share"], "left").join(side, [*keys, "share"])
    rank = F.col("share") * (F.col("_n") - 1)
    to = F.coalesce("_below", F.lit(0)) + F.col("_to")
    first, last = F.floor(rank + 1e-9), F.ceil(rank - 1e-9)
    found = placed.groupBy(*keys, "share").agg(
        F.min(F.when(to > first, F.col("_v"))).alias("_low"),
        F.min(F.when(to > last, F.col("_v"))).alias("_high"),
        F.first(F.greatest(rank - first, F.lit(0.0))).alias("_part"),
        F.first((F.coalesce("_below", F.lit(0)) <= first)).alias("_reached"),
    )
    whole = F.col("_reached") & F.col("_high").isNotNull()
    return found.select(*keys, "share", F.when(whole, F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).alias("percentile"))


def percentile_limits(cubes: DataFrame, variable: str, value: str, low: float | None, high: float | None) -> DataFrame:
    """(vmin, vmax): the least low and the greatest high percentile over the variables; None takes the extremes."""
    low, high = (low or 0) / 100, 1.0 if high is None else high / 100
    found = exact_percentiles(cubes, [variable], value, sorted({low, high}))
    return found.agg(F.min(F.when(F.col("share") == low, F.col("percentile"))).alias("vmin"), F.max(F.when(F.col("share") == high, F.col("percentile"))).alias("vmax"))


def scores(rows: DataFrame, observed: str, predicted: str) -> DataFrame:
    """(r2, mse) of predictions. Of constant observations r2 is 1 if all are met, else 0."""
    y, p = F.col(observed), F.col(predicted)
    error = F.sum((y - p) * (y - p))
    r2 = F.coalesce(1 - F.try_divide(error, F.var_pop(y) * F.count(y)), F.when(error == 0, 1.0).when(error.isNotNull(), 0.0))
    return rows.agg(r2.alias("r2"), F.avg((y - p) * (y - p)).alias("mse"))


def area_weighted_mean(cube: DataFrame, keys: list[str], lat: str = "lat", value: str = "value") -> DataFrame:
    w = F.when(F.col(value).isNotNull(), F.cos(F.radians(F.col(lat))))
    return cube.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def fingerprint_columns(names: list[str]) -> list[Column]:
    """Aggregates n, total and mix of a table with these columns: a content hash that does not depend on the order of rows or columns."""
    h = F.xxhash64(*[F.struct(F.lit(n), F.col(f"`{n}`").isNull(), F.col(f"`{n}`")) for n in sorted(names)])
    return [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("mix")]


def fingerprint(rows: DataFrame) -> DataFrame:
    """(n, total, mix): a content hash that does not depend on the order of rows or columns."""
    return rows.agg(*fingerprint_columns(rows.columns))

"""Operators along an order: runs, seasons, extrema, intervals. All are windows over a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """(keys, start, end, length) of the islands of rows with ``hit`` true; ``order`` counts 0, 1, 2, .. in each key."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = rows.where(hit).select(*keys, F.col(order).alias("_at"), (F.col(order) - F.row_number().over(by)).alias("_island"))
    return marked.groupBy(*keys, "_island").agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count(F.lit(1)).alias("length")).drop("_island")


def longest_run(rows: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """The longest run of each key (of equal ones the first), with whether it touches either end.

    Keys without a hit stay, with length 0.
    """
    ends = rows.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    best = runs(rows, keys, order, hit).groupBy(*keys).agg(F.max(F.struct("length", (-F.col("start")).alias("k"), "start", "end")).alias("_r"))
    out = ends.join(best, keys, "left")
    return out.select(
        *keys,
        F.coalesce("_r.length", F.lit(0).cast("long")).alias("length"),
        F.coalesce(F.col("_r.start") == F.col("_lo"), F.lit(False)).alias("at_start"),
        F.coalesce(F.col("_r.end") == F.col("_hi"), F.lit(False)).alias("at_end"),
    )


def chained_run(longest: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Add ``chained``: lengths summed over neighbouring periods whose longest runs touch at the border.

    Only the longest runs' own flags count, as one period follows the other.
    """
    by = Window.partitionBy(*keys).orderBy(period)
    follows = F.col("at_start") & F.coalesce(F.lag("at_end").over(by), F.lit(False))
    chain = longest.withColumn("_chain", F.sum((~follows).cast("int")).over(by))
    inside = Window.partitionBy(*keys, "_chain").orderBy(period)
    return chain.withColumn("chained", F.sum("length").over(inside)).drop("_chain")


def fire_season(rows: DataFrame, keys: list[str], order: str, value: str, threshold: float = 0.5, n: int = 12) -> DataFrame:
    """(keys, start, end, size, fraction) of each cell's season.

    Values over ``threshold`` times the cell's largest are significant. The largest cluster is the season,
    the first of equal ones; clusters at both ends of the cycle join if together they are larger, and
    cells where they are as large as the main one are left out, as are cells whose largest value is 0. fraction: size / significant months.
    """
    whole = Window.partitionBy(*keys)
    hit = rows.withColumn("_hit", F.try_divide(F.col(value), F.max(value).over(whole)) > threshold).where("_hit")
    islands = runs(hit, keys, order, F.lit(True))
    ranked = islands.withColumns(
        {
            "_rank": F.row_number().over(whole.orderBy(F.desc("length"), "start")),
            "_n": F.count(F.lit(1)).over(whole),
            "_all": F.sum("length").over(whole),
            "_first": F.max(F.when(F.col("start") == 0, F.col("length"))).over(whole),
            "_last": F.max(F.when(F.col("end") == n - 1, F.col("length"))).over(whole),
            "_last_start": F.max(F.when(F.col("end") == n - 1, F.col("start"))).over(whole),
            "_first_end": F.max(F.when(F.col("start") == 0, F.col("end"))).over(whole),
        }
    ).where("_rank = 1")
    joined = F.when(F.col("_n") > 1, F.col("_first") + F.col("_last"))
    wraps = F.coalesce(joined > F.col("length"), F.lit(False))
    size = F.when(wraps, joined).otherwise(F.col("length"))
    return ranked.where(~F.coalesce(joined == F.col("length"), F.lit(False))).select(
        *keys, F.when(wraps, F.col("_last_start")).otherwise(F.col("start")).alias("start"), F.when(wraps, F.col("_first_end")).otherwise(F.col("end")).alias("end"), size.alias("size"), (size / F.col("_all")).alias("fraction")
    )


def season_mask(season: DataFrame, keys: list[str], n: int = 12) -> DataFrame:
    """(keys, month): the months of each season, over the year's end where it wraps."""
    length = F.pmod(F.col("end") - F.col("start"), F.lit(n))
    return season.select(*keys, F.explode(F.sequence(F.lit(0), length.cast("int"))).alias("_i"), "start").select(*keys, F.pmod(F.col("start") + F.col("_i"), F.lit(n)).cast("int").alias("month"))


def local_extrema(rows: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Add is_max and is_min: the slope changes sign; edges repeat their value and both ends of a plateau count."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.signum(F.col(value) - F.coalesce(F.lag(value).over(by), F.col(value)))
    after = F.signum(F.coalesce(F.lead(value).over(by), F.col(value)) - F.col(value))
    return rows.withColumns({"is_max": after - before < 0, "is_min": after - before > 0})


def significant_peaks(rows: DataFrame, keys: list[str], order: str, value: str = "value", difference: float = 0.5, spread: float = 0.0, strict: bool = False) -> DataFrame:
    """(keys, order, value, height, rank) of the peaks: positive maxima and negative minima; rank 1 is the largest in size, of equal ones the first.

    A peak's height is the largest over both sides of min(|peak|, |peak - nearest extremum of the other
    kind|), or |peak| without one, relative to the tallest; it must reach ``difference``. Keys whose range
    is below ``spread`` have none; strict keeps keys with one peak only.
    """
    marked = local_extrema(rows, keys, order, value)
    by = Window.partitionBy(*keys).orderBy(order)
    ahead, behind = by.rowsBetween(1, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    low, high = F.when(F.col("is_min"), v), F.when(F.col("is_max"), v)
    near = lambda kind, w, f: f(kind, ignorenulls=True).over(w)
    trough = [F.when(v > 0, near(low, behind, F.last)).otherwise(near(high, behind, F.last)), F.when(v > 0, near(low, ahead, F.first)).otherwise(near(high, ahead, F.first))]
    side = [F.when(t.isNotNull(), F.least(F.abs(v), F.abs(v - t))) for t in trough]
    whole = Window.partitionBy(*keys)
    out = marked.withColumns({"_height": F.coalesce(F.greatest(*side), F.abs(v)), "_range": F.max(v).over(whole) - F.min(v).over(whole)})
    peaks = out.where(((F.col("is_max") & (v > 0)) | (F.col("is_min") & (v < 0))) & (F.col("_range") >= spread))
    peaks = peaks.withColumn("height", F.col("_height") / F.max("_height").over(whole)).where(F.col("height") >= difference)
    if strict:
        peaks = peaks.withColumn("_n", F.count(F.lit(1)).over(whole)).where("_n = 1")
    return peaks.select(*keys, order, value, "height", F.row_number().over(whole.orderBy(F.desc(F.abs(v)), order)).alias("rank"))


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Touching or overlapping intervals of a key joined; intervals without a start join those before them."""
    by = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    seen = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("_new", F.when((F.col(start) > seen) | (F.row_number().over(by) == 1), 1).otherwise(0))
    return cut.withColumn("_group", F.sum("_new").over(by)).groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def outside_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Points that lie in no interval [start, end) of their key.

    Intervals are merged first; then the last start at or before a point decides, found by one window over
    points and intervals of a key rather than by a range join. Null keys meet no interval, nor do points without a place.
    """
    merged = merge_intervals(intervals.dropna(subset=keys), keys, start, end).dropna(subset=[start, end])
    both = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(merged.schema[end].dataType).alias("_end")).unionByName(
        merged.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_end")), allowMissingColumns=True
    )
    by = Window.partitionBy(*keys).orderBy("_at", "_kind")
    open_until = F.last("_end", ignorenulls=True).over(by)
    return both.withColumn("_until", open_until).where("_kind = 1 and (_until is null or _at >= _until)").select("_row.*")


def centres(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("centre", (F.col(value) + F.lead(value).over(by)) / 2).where("centre is not null")


def outer_bounds(rows: DataFrame, value: str) -> DataFrame:
    """(low, high) of evenly spaced centres."""
    step = (F.max(value) - F.min(value)) / (F.count_distinct(value) - 1)
    return rows.agg((F.min(value) - step / 2).alias("low"), (F.max(value) + step / 2).alias("high"))


def batch_bounds(size: int, n: int) -> list[tuple[int, int]]:
    """n contiguous batches of a sequence, cut at the floors of even steps."""
    edges = [size * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def batches(rows: DataFrame, order: str, size: int, n: int) -> DataFrame:
    """Add batch: which of the n contiguous batches a row (numbered 0.. by ``order``) is in."""
    out = F.lit(n - 1)
    for i, (_, stop) in reversed(list(enumerate(batch_bounds(size, n)))):
        out = F.when(F.col(order) < stop, i).otherwise(out)
    return rows.withColumn("batch", out)

"""Masks and predicates. A mask is a condition or a table of cells; masking a value sets it to NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import all_of, any_of, month_key


class VariableNotFoundError(KeyError):
    """A constraint names a column that the table lacks."""


def mask_where(cube: DataFrame, masked: Column, value: str = "value") -> DataFrame:
    return cube.withColumn(value, F.when(~F.coalesce(masked, F.lit(False)), F.col(value)))


def apply_masks(cube: DataFrame, *masks: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """OR of mask tables (keys, mask); a mask without the time column holds for all times."""
    hidden = F.lit(False)
    for i, mask in enumerate(masks):
        on = [k for k in keys if k in mask.columns]
        cube = cube.join(mask.select(*on, F.col("mask").alias(f"_mask{i}")), on, "left")
        hidden = hidden | F.coalesce(F.col(f"_mask{i}"), F.lit(False))
    return mask_where(cube, hidden, value).drop(*[f"_mask{i}" for i in range(len(masks))])


def observed_mask(fraction: DataFrame, keys: list[str], threshold: float = 0.8, frequency: str | None = None, time: str = "time", value: str = "value") -> DataFrame:
    """(keys, mask): observed fraction below the threshold; monthly averages first if asked."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")
    if frequency == "monthly":
        rest = [k for k in keys if k != time]
        fraction = fraction.groupBy(*rest, month_key(F.col(time)).alias("m")).agg(F.avg(value).alias(value))
        keys = [*rest, "m"]
    return fraction.select(*keys, (F.col(value) < threshold).alias("mask"))


def no_fire_mask(products: DataFrame, cell: list[str], value: str = "value") -> DataFrame:
    """(cell, mask): true where every product is zero (within 1e-8) at every month; NULL counts as zero."""
    return products.groupBy(*cell).agg(F.bool_and(F.coalesce(F.abs(F.col(value)) <= 1e-8, F.lit(True))).alias("mask"))


def box(lat: Column, lon: Column, lats: tuple[float, float], lons: tuple[float, float]) -> Column:
    return lat.between(*lats) & lon.between(*lons)


def polygon(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's (lon, lat) corners."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            spans = (lat > F.lit(y1)) != (lat > F.lit(y2))
            crossings = crossings + F.when(spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def land(lat: Column, lon: Column, polygons: list[list[tuple[float, float]]], ignore: tuple[int, ...] = ()) -> Column:
    """Whether a place lies in any polygon but those whose numbers are ignored."""
    return any_of([polygon(lat, lon, p) for i, p in enumerate(polygons) if i not in set(ignore)])


def has_columns(cube: DataFrame, *names: str) -> bool:
    """Whether the cube has all these coordinates."""
    return set(names) <= set(cube.columns)


def observed_masked(cube: DataFrame, fraction: DataFrame, keys: list[str], variables: list[str], name: str, threshold: float = 0.8, digits: int = 3, value: str = "value") -> tuple[str, DataFrame]:
    """(new name, cube): the named variables masked where the observed fraction, at its own frequency, is below the threshold.

    A threshold of more digits than ``digits`` is an error, as it could not be told from the name.
    """
    if abs(threshold - round(threshold, digits)) > 1e-8:
        raise AssertionError(f"the threshold has more than {digits} digits")
    hidden = observed_mask(fraction, keys, round(threshold, digits), value=value)
    hit = F.col("variable").isin(*variables)
    masked = cube.join(hidden.withColumnRenamed("mask", "_observed"), keys, "left").withColumn(value, F.when(~(hit & F.coalesce("_observed", F.lit(False))), F.col(value))).drop("_observed")
    parts = "__".join(re.sub(r"_+", "_", re.sub(r"[ -]", "_", v)).strip("_") for v in variables)
    return f"{name}_{parts}__thres_{threshold:.{digits}f}", masked


def select_box(cube: DataFrame, lats: tuple[float, float] | None, lons: tuple[float, float] | None, half_lat: float, half_lon: float) -> DataFrame:
    """Cells whose bounds meet the box."""
    tests = []
    for axis, limits, half in (("lat", lats, half_lat), ("lon", lons, half_lon)):
        if limits is not None:
            tests.append((F.col(axis) + half > limits[0]) & (F.col(axis) - half < limits[1]))
    return cube.where(all_of(tests))


def match_constraints(constraints: list[dict[str, tuple]], columns: list[str]) -> Column:
    """OR over dicts, AND within; limits are half-open [start, stop), None is unbounded."""
    def one(name: str, limits: tuple) -> Column:
        if name not in columns:
            raise VariableNotFoundError(name)
        low, high = limits
        return all_of(([F.col(name) >= low] if low is not None else []) + ([F.col(name) < high] if high is not None else []))

    return any_of([all_of([one(n, x) for n, x in c.items()]) for c in constraints])


def constrained_map(rows: DataFrame, grid: DataFrame, keys: list[str], constraints: list[dict[str, tuple]] | dict[str, tuple], variable: str | None = None, land: DataFrame | None = None, lats: tuple[float, float] = (-60.0, 90.0), lat: str = "lat") -> DataFrame:
    """(keys, lat, value): the rows that meet the constraints, placed back on the grid; everything else is NULL.

    rows: unmasked samples (keys, features); grid: all cells (keys, lat). The value is the variable's, or 1. land: cells (some of the keys, land
    boolean), cells it lacks are no land; cells outside lats are masked.
    """
    constraints = [constraints] if isinstance(constraints, dict) else list(constraints)
    for c in constraints:
        for name, limits in c.items():
            if not isinstance(limits, tuple) or len(limits) != 2:
                raise TypeError(f"{name}: expected a pair of limits, got {limits!r}")
    if variable is not None and variable not in rows.columns:
        raise VariableNotFoundError(variable)
    value = F.lit(1.0) if variable is None else F.col(variable).cast("double")
    hits = rows.where(match_constraints(constraints, rows.columns)).select(*keys, value.alias("value"))
    out = grid.select(*keys, lat).join(hits, keys, "left")
    shown = F.col(lat).between(*lats)
    if land is not None:
        on = [k for k in keys if k in land.columns]
        out = out.join(land.select(*on, F.col("land").alias("_land")), on, "left")
        shown = shown & F.coalesce("_land", F.lit(False))
    return out.select(*keys, lat, F.when(shown, F.col("value")).alias("value"))


def constraints_title(constraints: list[dict[str, tuple]]) -> str:
    def one(name, limits):
        low, high = limits
        return f"{low} < {name} < {high}" if None not in limits else f"{name} < {high}" if low is None else f"{low} < {name}"

    parts = [" & ".join(one(n, x) for n, x in c.items()) for c in constraints]
    return parts[0] if len(parts) == 1 else " | ".join(f"({p})" for p in parts)


def quality_mask(value: Column, quality: Column, largest: int = 100, bits: int = 0b11010111) -> Column:
    """The value, or NULL if it is over ``largest`` or a bad-quality bit is set."""
    return F.when(~((value > largest) | (quality.bitwiseAND(F.lit(bits)) != 0)), value)


def valid_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    tests = ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
    return F.when(all_of(tests) & ~F.isnan(value.cast("double")) & (F.abs(value) != float("inf")), value)


def unmasked(cube: DataFrame, value: str = "value") -> DataFrame:
    return cube.where(F.col(value).isNotNull())


def scatter(values: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Values placed back on the whole grid, NULL elsewhere."""
    return grid.select(*keys).join(values, keys, "left")


def valid_extent(cube: DataFrame, axis: str, value: str = "value", keys: list[str] = ()) -> DataFrame:
    """(keys, first, last): the axis without masked borders."""
    return unmasked(cube, value).groupBy(*keys).agg(F.min(axis).alias("first"), F.max(axis).alias("last"))


def valid_extent_circular(cube: DataFrame, axis: str, n: int, value: str = "value") -> DataFrame:
    """(first, last, size): the arc that is left when the longest masked run of a circular axis is cut out.

    Edge trims win if they remove as much; of equal runs the first counts.
    """
    valid = unmasked(cube, value).select(axis).distinct()
    w = Window.orderBy(axis)
    gaps = valid.select(F.col(axis).alias("before"), F.lead(axis).over(w).alias("after")).where("after is not null").withColumn("run", F.col("after") - F.col("before") - 1)
    inner = gaps.agg(F.max(F.struct("run", (-F.col("before")).alias("k"), "before", "after")).alias("g"))
    ends = valid.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    edge = F.col("lo") + n - 1 - F.col("hi")
    use = F.coalesce(F.col("g.run") > edge, F.lit(False))
    first, last = F.when(use, F.col("g.after")).otherwise(F.col("lo")), F.when(use, F.col("g.before")).otherwise(F.col("hi"))
    return ends.crossJoin(inner).select(first.alias("first"), last.alias("last"), (F.pmod(last - first, F.lit(n)) + 1).alias("size"))

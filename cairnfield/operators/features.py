"""From cubes to feature matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import log_feature, sqrt_feature
from ..model import all_of
from .temporal import climatology, with_shifts


def feature_matrix(cubes: DataFrame, keys: list[str], variables: list[str], value: str = "value", complete: bool = True) -> DataFrame:
    """One row per key, one column per variable, by a single pivoting aggregation (of repeated rows the greatest value); complete keeps keys that are valid in all."""
    wide = cubes.where(F.col("variable").isin(*variables)).groupBy(*keys).pivot("variable", variables).agg(F.max(value))
    return wide.dropna(subset=variables) if complete else wide


def transformed(rows: DataFrame, transformations: dict[str, Column] | None = None, deletions: list[str] = (), log_names: list[str] = (), sqrt_names: list[str] = ()) -> DataFrame:
    """Derived columns first, then deletions, then ``log x`` and ``sqrt x`` in place of x."""
    rows = rows.withColumns(transformations or {}).drop(*deletions)
    for names, word, function in ((log_names, "log", log_feature), (sqrt_names, "sqrt", sqrt_feature)):
        for n in names:
            rows = rows.withColumn(f"{word} {n}", function(F.col(n))).drop(n)
    return rows


def data_processing(
    cubes: DataFrame,
    keys: list[str],
    target: str,
    features: list[str],
    transformations: dict[str, Column] | None = None,
    deletions: list[str] = (),
    log_names: list[str] = (),
    sqrt_names: list[str] = (),
    masks: list[DataFrame] = (),
    fill: Callable[[DataFrame], DataFrame] | None = None,
    lat_limits: tuple[float, float] | None = None,
    fire_mask: bool = False,
    land: DataFrame | None = None,
) -> DataFrame:
    """(keys, target, features ..): masks, then gap filling, then the complete rows, then transformations.

    lat_limits: cells whose ``lat`` lies outside are masked; fire_mask: cells whose target is never above 0 are masked;
    land: a table (cell columns, mask) whose masked cells are no land.
    """
    return processed(cubes, keys, target, features, transformations, deletions, log_names, sqrt_names, masks, fill, lat_limits, fire_mask, land)["rows"]


def processed(cubes, keys, target, features, transformations=None, deletions=(), log_names=(), sqrt_names=(), masks=(), fill=None, lat_limits=None, fire_mask=False, land=None) -> dict[str, DataFrame]:
    """The tables of data_processing: rows, master_mask (keys, mask: a row that is not complete), filled and masked cubes."""
    from .masks import apply_masks, no_fire_mask

    masks = list(masks)
    if lat_limits is not None:
        masks.append(cubes.select("lat_idx", (~F.col("lat").between(*lat_limits)).alias("mask")).distinct())
    if fire_mask:
        cell = [k for k in keys if k in ("lat_idx", "lon_idx")]
        masks.append(no_fire_mask(cubes.where(F.col("variable") == target), cell))
    if land is not None:
        masks.append(land)
    masked = apply_masks(cubes, *masks, keys=keys) if masks else cubes
    filled = fill(masked) if fill is not None else masked
    names = [target, *features]
    whole = feature_matrix(filled, keys, names, complete=False)
    complete = all_of([F.col(f"`{n}`").isNotNull() for n in names])
    rows = transformed(whole.where(complete), transformations, list(deletions), list(log_names), list(sqrt_names))
    return {"rows": rows, "master_mask": whole.select(*keys, (~complete).alias("mask")), "filled": filled, "masked": masked}


def lag_pipeline(cubes: DataFrame, cell: list[str], target: str, features: list[str], shifted: list[str], shifts: list[int], span: tuple[int, int], **options) -> DataFrame:
    """(cell, month, target, features, "x -n Month" ..): copies moved by each shift, then the climatology of the months span, then data_processing."""
    moved = with_shifts(cubes, shifted, shifts)
    monthly = climatology(moved, ["variable", *cell], *span)
    names = [*features, *(f"{v} {-n} Month" for v in shifted for n in shifts)]
    return data_processing(monthly, [*cell, "month"], target, names, **options)

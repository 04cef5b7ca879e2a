"""Plans made of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import month_key
from ..operators import spatial, temporal
from ..operators.algebra import Datasets


def prepare_selection(datasets: Datasets, kinds: dict[str, str], keys: list[str], start: int | None = None, end: int | None = None, which: str = "all", grids: dict[str, tuple[list[float], list[float]]] | None = None, target: tuple[list[float], list[float]] | None = None, scheme: str = "conservative"):
    """Limit, regrid and reduce every dataset, in the order of their names: the tables monthly, mean and climatology, or the one asked for.

    kinds: how each dataset's months are made; grids and target: axes for regridding by ``scheme``. A limit that is not given is that of
    the span which the datasets with months have in common; without such a dataset both must be given.
    """
    if start is None or end is None:
        first, last = common_span(datasets, kinds)
        start, end = first if start is None else start, last if end is None else end
        if start is None or end is None:
            raise ValueError("the time limits are undefined")
    makers = {"monthly": _monthly, "mean": _mean, "climatology": _climatology}
    if which != "all" and which not in makers:
        raise ValueError(f"which must be all or one of {sorted(makers)}")
    tables = {name: None for name in (makers if which == "all" else [which])}
    for d in datasets.datasets:
        kind = kinds[d.name]
        cube = temporal.limit_months(d.cube, start, end, kind) if kind != "climatology" else d.cube
        if grids and target:
            keep = ["variable", *(c for c in ("time", "year", "month") if c in cube.columns)]
            cube = spatial.regrid_to(cube, *grids[d.name], *target, keep, scheme)
        for name in tables:
            made = makers[name](cube, kind, start, end, ["variable", *keys])
            tables[name] = made if tables[name] is None else tables[name].unionByName(made)
    return tables if which == "all" else tables[which]


def common_span(datasets: Datasets, kinds: dict[str, str]) -> tuple[int, int] | tuple[None, None]:
    """The first and last month that all datasets have whose months move; (None, None) without any."""
    meta = None
    for d in datasets.datasets:
        if kinds[d.name] in ("static", "yearly", "climatology"):
            continue
        m = month_key(F.col("time"))
        part = d.cube.agg(F.lit(d.name).alias("dataset"), F.min(m).alias("min_month"), F.max(m).alias("max_month"), F.lit(kinds[d.name]).alias("frequency"))
        meta = part if meta is None else meta.unionByName(part)
    return (None, None) if meta is None else temporal.overlap(meta)


def _monthly(cube: DataFrame, kind: str, start: int, end: int, keys: list[str]) -> DataFrame:
    out = temporal.dispatch_monthly(cube, kind, start, end, keys)
    return out.select(*keys, (F.col("m") if "m" in out.columns else month_key(F.col("time"))).alias("m"), "value")


def _mean(cube: DataFrame, kind: str, start: int, end: int, keys: list[str]) -> DataFrame:
    return cube.select(*keys, "value") if kind == "static" else temporal.mean_over_time(cube, keys)


def _climatology(cube: DataFrame, kind: str, start: int, end: int, keys: list[str]) -> DataFrame:
    months = _monthly(cube, kind, start, end, keys)
    return months.groupBy(*keys, (F.col("m") % 12 + 1).alias("month")).agg(F.avg("value").alias("value"))

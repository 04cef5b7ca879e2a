"""Gap filling: temporal neighbours, persistent gaps, season and trend, spatial neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import all_of
from ..tables import broadcast_up_to, materialize


def temporal_neighbours(cube: DataFrame, cell: list[str], t: str, n: int, threshold: float = 0.0, land: Column | None = None, value: str = "value", period: int = 12) -> DataFrame:
    """Add filled: masked values take the mean of the nearest valid months at the same distance, up to n.

    Only where more than ``threshold`` of a month-of-year's samples are missing. Reads the given values
    only, so fills do not cascade. The cube must hold a row for each (cell, t).
    """
    by = Window.partitionBy(*cell).orderBy(t)
    missing = F.avg(F.col(value).isNull().cast("double")).over(Window.partitionBy(*cell, F.pmod(F.col(t), F.lit(period))))
    found = []
    for d in range(1, n + 1):
        a, b = F.lag(value, d).over(by), F.lead(value, d).over(by)
        found.append(F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)))
    wanted = F.col(value).isNull() & (missing > threshold)
    if land is not None:
        wanted = wanted & land
    return cube.withColumn("filled", F.when(wanted, F.coalesce(*found)).otherwise(F.col(value)))


def persistent(cube: DataFrame, cell: list[str], t: str, percent: int = 50, value: str = "value", period: int = 12) -> DataFrame:
    """Add filled: a cell's least value where a month-of-year is missing in at least ``percent`` of its samples."""
    missing = F.avg(F.col(value).isNull().cast("double")).over(Window.partitionBy(*cell, F.pmod(F.col(t), F.lit(period))))
    least = F.min(value).over(Window.partitionBy(*cell))
    return cube.withColumn("filled", F.when(F.col(value).isNull() & (missing + 1e-5 >= percent / 100), least).otherwise(F.col(value)))


def minimum(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return cube.withColumn("filled", F.coalesce(F.col(value), F.min(value).over(Window.partitionBy(*keys))))


def season_design(t: np.ndarray, k: int, period: float = 12.0) -> np.ndarray:
    """Columns 1, t and sin, cos of the k harmonics."""
    waves = [f(2 * math.pi * j * t / period) for j in range(1, k + 1) for f in (np.sin, np.cos)]
    return np.stack([np.ones(len(t)), t.astype(float), *waves], 1)


def _solve(rows: Column) -> Column:
    """The solution (array) of a symmetric positive system given as rows with the right side last; null if a pivot vanishes.

    Gauss-Jordan elimination without exchanges; a pivot below 1e-8 of its diagonal counts as zero.
    """

    def step(m: Column, j: Column) -> Column:
        pivot_row = F.get(m, j)
        pivot = F.get(pivot_row, j)
        scaled = F.transform(pivot_row, lambda x: x / pivot)
        reduced = F.transform(m, lambda row, i: F.when(i == j, scaled).otherwise(F.zip_with(row, scaled, lambda x, y: x - y * F.get(row, j))))
        return F.when(pivot > 1e-8 * F.get(F.get(rows, j), j), reduced)

    size = F.size(rows)
    done = F.aggregate(F.sequence(F.lit(0), size - 1), rows, step)
    return F.transform(done, lambda row: F.element_at(row, -1))


def season_trend(cube: DataFrame, cell: list[str], t: str, k: int = 4, value: str = "value", period: float = 12.0) -> DataFrame:
    """Add filled: masked values of partly valid cells from a least-squares trend with k harmonics.

    One aggregation gives each cell the sums of the products of its design columns (2 + 2 k of them) and of the values; the normal equations are
    solved in an expression. Time is centred and scaled over the table, so the sums are well conditioned. Cells whose
    samples do not settle all terms get the solution of least norm in 1, t and the waves, from an array of their own samples.
    """
    if not isinstance(k, int) or isinstance(k, bool):
        raise ValueError("k must be an integer")
    span = cube.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    if span["a"] is None:
        return cube.withColumn("filled", F.col(value).cast("double"))
    centre, scale = (span["a"] + span["b"]) / 2, max(1.0, (span["b"] - span["a"]) / 2)
    angle = F.pmod(F.col(t).cast("double"), F.lit(period)) * (2 * math.pi / period)
    design = [F.lit(1.0), (F.col(t) - centre) / scale, *[f(angle * j) for j in range(1, k + 1) for f in (F.sin, F.cos)]]
    d = len(design)
    names = [f"_x{i}" for i in range(d)]
    x = cube.select(*cell, t, F.col(value).cast("double").alias("_y"), *[c.alias(n) for c, n in zip(design, names, strict=True)])
    valid = x.where(F.col("_y").isNotNull())
    sums = valid.groupBy(*cell).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(names) for b in [*names[i:], "_y"]])
    system = F.array(*[F.array(*[F.col(f"{names[min(i, j)]}{names[max(i, j)]}") for j in range(d)], F.col(f"{names[i]}_y")) for i in range(d)])
    solved = sums.select(*cell, system.alias("_m")).select(*cell, _solve(F.col("_m")).alias("_beta"))
    solved = materialize(solved, "season")
    weak = solved.where("_beta is null").select(*cell)
    strong = solved.where("_beta is not null")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"x.{c}")) for c in cell]
    samples = valid.alias("x").join(broadcast_up_to(weak, 100_000).alias("w"), all_of(same), "left_semi").groupBy(*cell).agg(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col("_y").alias("y"))).alias("_s"))

    @F.pandas_udf("array<double>")
    def least_norm(series: pd.Series) -> pd.Series:
        def one(pairs):
            at, y = np.array([p["t"] for p in pairs]), np.array([p["y"] for p in pairs])
            beta = np.linalg.lstsq(season_design(at, k, period), y, rcond=None)[0]
            beta[0], beta[1] = beta[0] + beta[1] * centre, beta[1] * scale
            return beta

        return series.map(one)

    betas = strong.unionByName(samples.select(*cell, least_norm("_s").alias("_beta")))
    places = [F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}")) for c in cell]
    joined = cube.alias("c").join(broadcast_up_to(betas, 100_000).alias("b"), all_of(places), "left").select("c.*", "_beta")
    fitted = F.aggregate(F.zip_with("_beta", F.array(*design), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumn("filled", F.coalesce(F.col(value).cast("double"), fitted)).drop("_beta")


def season_sql(source: str, cell: str, t: str, k: int = 4, value: str = "value", period: int = 12) -> str:
    """The same as SQL by orthogonalisation, one design column after the other (cells whose samples settle all terms): cell, t, filled."""
    columns = ["1.0", f"CAST({t} AS DOUBLE)", *[f"{f}({t} % {period} * {2 * j} * pi() / {period})" for j in range(1, k + 1) for f in ("sin", "cos")]]
    names = [f"x{i}" for i in range(len(columns))]
    steps = [f"s0 AS (SELECT {cell}, {t}, {value} AS y, {value} AS r, 0.0 AS fit, {', '.join(f'{c} AS {n}' for c, n in zip(columns, names, strict=True))} FROM {source})"]
    for i, n in enumerate(names):
        share = lambda b, n=n: f"(sum({n} * {b}) FILTER (WHERE y IS NOT NULL) OVER w / sum({n} * {n}) FILTER (WHERE y IS NOT NULL) OVER w)"
        rest = "".join(f", {m} - {n} * {share(m)} AS {m}" for m in names[i + 1 :])
        steps.append(f"s{i + 1} AS (SELECT {cell}, {t}, y, r - {n} * {share('r')} AS r, fit + {n} * {share('r')} AS fit{rest} FROM s{i} WINDOW w AS (PARTITION BY {cell}))")
    return f"{', '.join(steps)} SELECT {cell}, {t}, coalesce(y, fit) AS filled FROM s{len(names)}"


def persistent_season_trend(cube: DataFrame, cell: list[str], t: str, percent: int = 50, k: int = 4, value: str = "value") -> DataFrame:
    if not (isinstance(percent, int) and isinstance(k, int)):
        raise ValueError("percent and k must be integers")
    first = persistent(cube, cell, t, percent, value).withColumn(value, F.col("filled")).drop("filled")
    return season_trend(first, cell, t, k, value)


def temporal_neighbours_span(cube: DataFrame, cell: list[str], t: str, n: int, start: int, end: int, threshold: float = 0.0, land: Column | None = None, value: str = "value", period: int = 12) -> DataFrame:
    """As temporal_neighbours, for the months start..end: missing fractions are those of these months, and fills read n months more on either side.

    A month that no cell of a variable has in start..end, or in the n months around, is an error.
    """
    if not isinstance(n, int) or isinstance(n, bool):
        raise ValueError("n must be an integer")
    owner = [c for c in ("variable",) if c in cube.columns]
    per = cube.where(F.col(t).between(start - n, end + n)).groupBy(*owner).agg(F.count_distinct(F.when(F.col(t).between(start, end), F.col(t))).alias("target"), F.count_distinct(t).alias("source"))
    seen = per.agg(F.min("target").alias("target"), F.min("source").alias("source")).first()
    every = cube.select(*owner).distinct().count() if owner else 1
    if seen["target"] != end - start + 1 or (owner and per.count() != every):
        raise RuntimeError("months of the target period are missing")
    if seen["source"] != end - start + 1 + 2 * n:
        raise RuntimeError("months around the target period are missing")
    rows = cube.where(F.col(t).between(start - n, end + n))
    inside = F.col(t).between(start, end)
    hole = F.col(value).isNull() if land is None else F.col(value).isNull() & land
    by = Window.partitionBy(*cell).orderBy(t)
    missing = F.avg(F.when(inside, hole.cast("double"))).over(Window.partitionBy(*cell, F.pmod(F.col(t), F.lit(period))))
    found = []
    for d in range(1, n + 1):
        a, b = F.lag(value, d).over(by), F.lead(value, d).over(by)
        found.append(F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)))
    return rows.withColumn("filled", F.when(F.col(value).isNull() & (missing > threshold), F.coalesce(*found)).otherwise(F.col(value))).where(inside)


def nearest_cell(cube: DataFrame, axes: list[str], value: str = "value", within: list[str] = ()) -> DataFrame:
    """Add filled: the nearest valid value by Euclidean index distance over the axes; ties by least indices.

    One pass for each axis, from the last to the first: along a line of the grid, the nearest valid cell in the lines seen so
    far is the one with the least squared distance there plus the squared step along the line. So a task holds
    a line (the length of one axis), and the cost does not depend on how far data are. Combinations of the axes that the cube has no row for are
    taken for masked cells, and are not returned. Without any valid value nothing is filled. within: columns (such as the month) of which each
    value is a grid of its own.
    """
    within = list(within)
    places = [cube.select(*x).dropna().distinct() for x in ([within] if within else []) + [[a] for a in axes]]
    whole = places[0]
    for p in places[1:]:
        whole = whole.crossJoin(F.broadcast(p))
    rows = whole.join(cube.where(F.col(value).isNotNull()).select(*within, *axes, F.col(value).alias("_v")), [*within, *axes], "left")
    rows = rows.withColumn("_d", F.when(F.col("_v").isNotNull(), F.lit(0).cast("long")))
    schema = rows.schema

    def along(axis: str):
        def line(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(axis, ignore_index=True)
            ok, want = np.flatnonzero(group["_d"].notna()), np.flatnonzero(group["_d"].isna() | (group["_d"] > 0))
            if not len(ok) or not len(want):
                return group
            at, distance = group[axis].to_numpy(np.int64), group["_d"].to_numpy(float)
            values, best, best_d = group["_v"].to_numpy(object), np.arange(len(group)), distance.copy()
            step = max(1, (1 << 20) // len(ok))
            for i in range(0, len(want), step):
                part = want[i : i + step]
                cost = distance[ok] + (at[part][:, None] - at[ok][None, :]).astype(float) ** 2
                least = cost.argmin(1)
                best[part], best_d[part] = ok[least], cost[np.arange(len(part)), least]
            return group.assign(_v=values[best], _d=pd.Series(best_d).astype("Int64"))

        return line

    for axis in reversed(axes):
        others = within + [a for a in axes if a != axis]
        rows = rows.groupBy(*others).applyInPandas(along(axis), schema)
    return cube.join(rows.select(*within, *axes, F.col("_v").alias("_fill")), [*within, *axes], "left").withColumn("filled", F.coalesce(F.col(value), F.col("_fill"))).drop("_fill")

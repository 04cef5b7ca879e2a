"""Scalar functions, all as Column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def log_modulus(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def log_feature(x: Column) -> Column:
    """ln(x + 0.01); rows below -1e-8 are an error."""
    return F.when(x < -1e-8, F.raise_error(F.lit("log of a negative value")).cast("double")).otherwise(F.log(x + 0.01))


def sqrt_feature(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("root of a negative value")).cast("double")).otherwise(F.sqrt(x))


def relative_difference(observed: Column, predicted: Column) -> Column:
    return F.try_divide(observed - predicted, observed)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), s)))


def lon_to_180(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def lon_to_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def in_360_system(lons: list[float], tol: float = 1e-4) -> bool:
    """Whether longitudes run from 0 to 360; values outside of both systems are an error."""
    if any(x < -180 - tol or x > 360 + tol for x in lons):
        raise ValueError("longitudes must lie in [-180, 360]")
    if any(x > 180 + tol for x in lons):
        if any(x < -tol for x in lons):
            raise ValueError("longitudes mix two systems")
        return True
    return False


def harmonic(t: Column, c: float, g: float, terms: list[tuple[float, float]], period: float = 12.0) -> Column:
    """c + g t + sum of amplitude * sin(2 pi j t / period + phase)."""
    out = F.lit(c) + g * t
    for j, (amplitude, phase) in enumerate(terms, 1):
        out = out + amplitude * F.sin(2 * math.pi * j * t / period + phase)
    return out


def sinusoidal_to_lat_lon(x: Column, y: Column, radius: float = 6371007.181) -> tuple[Column, Column]:
    lat = y / radius
    return F.degrees(lat), F.degrees(x / (radius * F.cos(lat)))


def date_of_year_day(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)


def walltime_seconds(text: Column) -> Column:
    """HHH:MM:SS as seconds; anything else is null."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d{2}):(\d{2})$", i)
    return F.when(text.rlike(r"^\d+:\d{2}:\d{2}$"), part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int"))


def decode_chars(codes: Column) -> Column:
    return F.trim(F.array_join(F.transform(codes, lambda c: F.char(c)), ""))


#: Patterns and their short forms, applied in this order.
SHORT_NAMES = (
    (r"-(\d+) - .*Month$", "Δ$1M"),
    (r"-(\d+) Month$", "$1M"),
    (r"(\d+) M$", "$1M"),
    ("VOD Ku-band", "VOD"),
    ("Diurnal Temp Range", "DTR"),
    ("Dry Day Period", "DD"),
    (r"SWI\(1\)", "SWI"),
    ("lightning", "Lightning"),
    ("Max Temp", "MaxT"),
    ("AGB Tree", "AGB"),
    ("ShrubAll", "SHRUB"),
    ("TreeAll", "TREE"),
    ("pftCrop", "CROP"),
    ("pftHerb", "HERB"),
    ("popd", "POPD"),
)


def shorten(name: Column) -> Column:
    """A feature's short name."""
    for pattern, short in SHORT_NAMES:
        name = F.regexp_replace(name, pattern, short)
    return name


def shorten_py(name: str) -> str:
    for pattern, short in SHORT_NAMES:
        name = re.sub(pattern, short.replace("$1", r"\1"), name)
    return name


def scientific(x: float, precision: int = 1) -> str:
    """1.2e3 rather than 1.2e+03."""
    mantissa, exponent = f"{x:.{precision}e}".split("e")
    return f"{mantissa}e{int(exponent)}"


def linear_edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / n for i in range(n + 1)]


def _decades(smallest: float, top: float) -> list[float]:
    out = [smallest]
    while out[-1] * 10 < top * (1 - 1e-9):
        out.append(out[-1] * 10)
    return [*out, top] if top > out[-1] * (1 + 1e-9) else out


def log_edges(low: float, high: float, n: int | None, smallest: float) -> list[float]:
    """Edges even in log on both sides of 0; ``smallest`` is the least magnitude besides 0; without n a bin a decade."""
    if low > 0:
        return _decades(low, high) if n is None else [low * (high / low) ** (i / n) for i in range(n + 1)]
    if high < 0:
        return [-x for x in log_edges(-high, -low, n, smallest)[::-1]]
    sides = [-low if -low > smallest else 0.0, high if high > smallest else 0.0]
    if n is None:
        down, up = (_decades(smallest, x) if x else [] for x in sides)
    else:
        weight = [math.log10(x / smallest) if x else 0.0 for x in sides]
        if not sum(weight):
            return linear_edges(low, high, n)
        inner = n - sum(x > 0 for x in sides)
        n_up = round(inner * weight[1] / sum(weight))
        even = lambda x, k: [smallest * (x / smallest) ** (i / k) for i in range(k + 1)] if x and k > 0 else [x] * bool(x)
        down, up = even(sides[0], inner - n_up), even(sides[1], n_up)
    return [-x for x in down[::-1]] + [0.0] + up


def bin_edges(low: float, high: float, n: int | None, log: bool = False, smallest: float = 1.0, simple: bool = False) -> list[float]:
    """Linear edges (with an edge at 0 if both signs occur, unless simple) or log edges."""
    if log:
        return log_edges(low, high, n, smallest)
    if simple or low >= 0 or high <= 0:
        return linear_edges(low, high, n)
    down = max(1, min(n - 1, round(n * -low / (high - low))))
    return linear_edges(low, 0.0, down)[:-1] + linear_edges(0.0, high, n - down)


def float_format(x: float, additional: int = 0) -> str:
    """Decimals only for small numbers: none from 10 on, below as many as its order of magnitude needs (one more up to 1); none for 0."""
    digits = 0 if x >= 10 or x == 0 else math.ceil(abs(math.log10(abs(x)))) + (x <= 1)
    return f"{x:.{digits + additional}f}"


def map_names(names: list[str], table: dict[str, str]) -> list[str]:
    """Names through a table; those it lacks stay."""
    return [table.get(n, n) for n in names]


def nested_items(tree: dict, path: tuple = ()):
    """(path, leaf) of nested dicts, depth first."""
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from nested_items(v, (*path, k))
        else:
            yield (*path, k), v


def nested_update(tree: dict, other: dict) -> dict:
    """A new dict: other's leaves over those of tree, level by level."""
    out = dict(tree)
    for k, v in other.items():
        out[k] = nested_update(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def pack_input(var, elements: int = 2, fill=0, single=str) -> tuple:
    """A tuple of ``elements`` items: those given (one, or an iterable), and as many more as are needed, each the item at a place named by ``fill`` or None."""
    items = [var] if isinstance(var, single) or not hasattr(var, "__iter__") else list(var)
    need = elements - len(items)
    if need < 0:
        raise ValueError(f"{len(items)} items are more than {elements}")
    sources = list(fill) if hasattr(fill, "__iter__") else [fill] * need
    if len(sources) < need:
        raise ValueError(f"{need} items are needed, {len(sources)} sources given")
    return (*items, *(None if i is None else items[i] for i in sources[:need]))

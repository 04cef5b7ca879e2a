"""Collections of datasets: names with aliases, union, selection and removal."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dataset:
    """A cube table with its variables' raw and pretty names."""

    name: str
    cube: DataFrame
    variables: tuple[str, ...]
    pretty_name: str = ""
    pretty_variables: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        pretty = [self.pretty_variables.get(v, v) for v in self.variables]
        if len(set(self.variables)) < len(self.variables) or len(set(pretty)) < len(pretty):
            raise ValueError(f"variable names of {self.name} are not unique")

    def grid(self, axis: str = "lat") -> float | str:
        """The mean spacing of an axis' points, or "N/A" if they are uneven, single, or the cube lacks the axis."""
        if axis not in self.cube.columns:
            return "N/A"
        points = self.cube.select(axis).dropna().distinct()
        steps = points.select((F.lead(axis).over(Window.orderBy(axis)) - F.col(axis)).alias("step")).where("step is not null")
        row = steps.agg(F.avg("step").alias("mean"), F.min("step").alias("least"), F.max("step").alias("most")).first()
        if row["mean"] is None:
            return "N/A"
        even = all(abs(x - row["mean"]) <= 1e-8 + 1e-5 * abs(row["mean"]) for x in (row["least"], row["most"]))
        return abs(row["mean"]) if even else "N/A"

    def names(self) -> set[str]:
        return {self.name, self.pretty_name or self.name}

    def resolve(self, variable: str) -> str:
        for v in self.variables:
            if variable in (v, self.pretty_variables.get(v, v)):
                return v
        raise KeyError(f"{variable!r} is not a variable of {self.name!r}; it has {list(self.variables)}")

    def __getitem__(self, variable: str) -> DataFrame:
        return self.cube.where(F.col("variable") == self.resolve(variable))

    def with_variables(self, keep: list[str]) -> "Dataset":
        left = tuple(v for v in self.variables if v in keep)
        return Dataset(self.name, self.cube.where(F.col("variable").isin(*left)), left, self.pretty_name, {v: p for v, p in self.pretty_variables.items() if v in left})


class Datasets:
    """Datasets sorted by name; no name, raw or pretty, may occur twice."""

    def __init__(self, datasets: list[Dataset] = ()):
        self.datasets = sorted(datasets, key=lambda d: d.name)
        seen: set[str] = set()
        for d in self.datasets:
            if seen & d.names():
                raise ValueError(f"the name {sorted(seen & d.names())[0]!r} occurs twice")
            seen |= d.names()

    def __add__(self, other: "Datasets | Dataset") -> "Datasets":
        return Datasets([*self.datasets, *(other.datasets if isinstance(other, Datasets) else [other])])

    def __getitem__(self, name: str) -> Dataset:
        for d in self.datasets:
            if name in d.names():
                return d
        raise KeyError(f"{name!r} is not a dataset; there are {[d.name for d in self.datasets]}")

    def __contains__(self, name: str) -> bool:
        return any(name in d.names() for d in self.datasets)

    def get_index(self, name: str) -> int:
        """The place of a dataset, by raw or pretty name."""
        return self.datasets.index(self[name])

    def fill(self, keys: list[str], *masks: DataFrame, reference: str | None = "burned.*area", axes: list[str] | None = None) -> "Datasets":
        """Every variable's masked values filled from the nearest valid cell; then the combined mask, and only it, hides values.

        The mask is the OR of the given mask tables (keys, mask) and of the masked cells of the one variable whose name matches
        ``reference`` (None: of the given ones alone). keys: integer columns of time and cell; distance counts along all of them, or
        along ``axes``. Valid values under the mask go, masked values outside it are filled.
        """
        from .gapfill import nearest_cell
        from .masks import apply_masks

        masks, axes = list(masks), keys if axes is None else axes
        if reference is not None:
            hits = [(d, v) for d in self.datasets for v in d.variables if any(re.fullmatch(reference, n, re.IGNORECASE) for n in (v, d.pretty_variables.get(v, v)))]
            if len(hits) != 1:
                raise ValueError(f"{len(hits)} variables match {reference!r}")
            masks.append(hits[0][0][hits[0][1]].select(*keys, F.col("value").isNull().alias("mask")))
        others = [k for k in keys if k not in axes]
        out = []
        for d in self.datasets:
            filled = nearest_cell(d.cube, axes, within=["variable", *others])
            out.append(replace(d, cube=apply_masks(filled.withColumn("value", F.col("filled")).drop("filled"), *masks, keys=keys)))
        return Datasets(out)

    def select_datasets(self, names: list[str]) -> "Datasets":
        return Datasets([self[n] for n in dict.fromkeys(names)])

    def remove_datasets(self, names: list[str]) -> "Datasets":
        gone = {self[n].name for n in names}
        return Datasets([d for d in self.datasets if d.name not in gone])

    def _variables(self, names: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for n in names:
            hits = [(d.name, v) for d in self.datasets for v in d.variables if n in (v, d.pretty_variables.get(v, v))]
            if not hits:
                raise KeyError(f"{n!r} is not a variable of any dataset")
            for d, v in hits:
                out.setdefault(d, []).append(v)
        return out

    def select_variables(self, names: list[str], strict: bool = True) -> "Datasets":
        found = self._variables(names)
        if strict and sum(map(len, found.values())) != len(names):
            raise ValueError("the names do not select one variable each")
        return Datasets([d.with_variables(found[d.name]) for d in self.datasets if d.name in found])

    def remove_variables(self, names: list[str]) -> "Datasets":
        found = self._variables(names)
        rest = [(d, [v for v in d.variables if v not in found.get(d.name, [])]) for d in self.datasets]
        return Datasets([d.with_variables(keep) for d, keep in rest if keep])

    def state(self) -> dict[str, list[str]]:
        return {d.name: sorted(d.variables) for d in self.datasets}

    def cube(self) -> DataFrame:
        """All rows with a dataset column."""
        out = None
        for d in self.datasets:
            part = d.cube.withColumn("dataset", F.lit(d.name))
            out = part if out is None else out.unionByName(part)
        return out


def shared_attributes(attributes: DataFrame, owner: str = "cube") -> DataFrame:
    """(key, value) pairs that all owners have."""
    n = attributes.agg(F.count_distinct(owner).alias("_all"))
    return attributes.groupBy("key", "value").agg(F.count_distinct(owner).alias("_n")).crossJoin(F.broadcast(n)).where("_n = _all").select("key", "value")

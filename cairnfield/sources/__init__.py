"""Scans, the read-through store and the catalogue of datasets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import masks, ordered, temporal
from ..tables import exists


class CommitMatchError(RuntimeError):
    """Parts of a stored dataset were written by different versions."""


def load_files(spark: SparkSession, files: list[str], n: int | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """The first n files by name, as one table with their names."""
    chosen = sorted(files)[:n]
    if not chosen:
        raise FileNotFoundError("no files to load")
    return spark.read.format(fmt).options(**options).load(chosen).withColumn("file", F.input_file_name())


def save(df: DataFrame, path: str, commit: str) -> None:
    """Store with its version; what is there already is never overwritten."""
    df.withColumn("commit", F.lit(commit)).write.mode("ignore").parquet(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if len(df.select("commit").distinct().limit(2).collect()) > 1:
        raise CommitMatchError(path)
    return df.drop("commit")


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame], commit: str) -> DataFrame:
    """The stored table, built and stored first if it is absent."""
    if not exists(spark, path):
        save(build(), path, commit)
    return read_stored(spark, path)


def ascii_grid(spark: SparkSession, path: str, header: int = 6, missing: float = -9999.0) -> DataFrame:
    """(file, lat_idx, lon_idx, value) of ESRI ASCII grids; rows count upwards from the last line."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\r?\n").alias("lines"))
    body = lines.select("file", F.slice("lines", header + 1, F.size("lines")).alias("lines")).select("file", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    cells = body.select("file", (F.col("n") - 1 - F.col("i")).alias("lat_idx"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("lon_idx", "text"))
    value = F.col("text").cast("double")
    return cells.select("file", "lat_idx", "lon_idx", F.when(value != missing, value).alias("value"))


def year_in_name(name: Column) -> Column:
    """1999AD, after any prefix."""
    return F.regexp_extract(name, r"(\d{4})AD", 1).cast("int")


def month_in_name(name: Column) -> Column:
    """_1999_05_ or 199905 as a month key."""
    a, b = F.regexp_extract(name, r"_(\d{4})_(\d{2})", 0), F.regexp_extract(name, r"(?<!\d)(\d{4})(\d{2})(?!\d)", 0)
    pick = lambda i: F.when(a != "", F.regexp_extract(name, r"_(\d{4})_(\d{2})", i)).when(b != "", F.regexp_extract(name, r"(?<!\d)(\d{4})(\d{2})(?!\d)", i))
    return (pick(1).cast("int") * 12 + pick(2).cast("int") - 1).cast("int")


def day_in_name(name: Column) -> Column:
    """yyyymmdd as a date."""
    return F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def year_day_in_name(name: Column, centre_days: int = 0) -> Column:
    """yyyyddd as a date, moved to the middle of a composite."""
    return F.date_add(fn.date_of_year_day(F.regexp_extract(name, r"(\d{4})(\d{3})", 1).cast("int"), F.regexp_extract(name, r"(\d{4})(\d{3})", 2).cast("int")), centre_days)


def tile_files(files: DataFrame, start: str, end: str) -> DataFrame:
    """(day, files): tiles by the second dotted field of their name (A and seven digits), start included, end not."""
    field_ = F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(2))
    day = year_day_in_name(field_)
    good = files.where(field_.rlike(r"^A?\d{7}$")).withColumn("day", day).where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
    return good.groupBy("day").agg(F.array_sort(F.collect_list("path")).alias("files"))


def tile_position(name: Column) -> tuple[Column, Column]:
    return F.regexp_extract(name, r"h(\d{2})v(\d{2})", 1).cast("int"), F.regexp_extract(name, r"h(\d{2})v(\d{2})", 2).cast("int")


def monthly_and_daily(monthly: DataFrame, daily: DataFrame, cell: list[str], value: str = "value") -> DataFrame:
    """Monthly rows, and months made of the daily rows that no monthly interval [start, end) covers.

    monthly: (cell, start, end, value); daily: (cell, time, value).
    """
    rest = ordered.outside_intervals(daily, monthly.select(*cell, "start", "end"), cell, "time")
    return monthly.select(*cell, F.col("start").alias("time"), value).unionByName(temporal.monthly_mean(rest, cell, "time", value).select(*cell, "time", value))


@dataclass(frozen=True)
class Loader:
    """How a dataset's long table (variable, time, cell, value) becomes a cube."""

    pretty: str
    monthly: str = "monthly"  # how months are made: monthly, static, yearly, climatology, daily
    names: dict[str, str] = field(default_factory=dict)  # raw to pretty variable names
    scale: float = 1.0
    low: float | None = None
    high: float | None = None
    per_area: bool = False  # divide by the cell's area
    scales: dict[str, float] = field(default_factory=dict)  # by raw variable name, besides ``scale``

    def read(self, table: DataFrame, area: Column | None = None) -> DataFrame:
        """Values out of range, not a number or infinite are masked; the rest is scaled, by variable where that is given."""
        value = masks.valid_range(F.col("value"), self.low, self.high) * self.scale
        if self.scales:
            by_name = None
            for name, scale in self.scales.items():
                hit = F.col("variable") == name
                by_name = F.when(hit, value * scale) if by_name is None else by_name.when(hit, value * scale)
            value = by_name.otherwise(value)
        if self.per_area:
            value = value / area
        return table.withColumn("value", value)

    def months(self, cube: DataFrame, start: int, end: int, keys: list[str]) -> DataFrame:
        return temporal.dispatch_monthly(cube, self.monthly, start, end, keys)


def loaders(ignore: tuple[str, ...] = (), match: str = ".*") -> dict[str, Loader]:
    """The catalogue's loaders by name, in order, without the ignored ones."""
    return {name: CATALOGUE[name] for name in sorted(CATALOGUE) if name not in ignore and re.fullmatch(match, name)}


def burned_by_class(areas: DataFrame, classes: DataFrame, cell_area: Column, per_area: tuple[str, ...] = ("burned_area", "burned area in vegetation class", "standard error of the estimation of burned area")) -> DataFrame:
    """Rows (variable, vegetation_class, .., value) with the class's label; the variables that are areas become shares of their cell.

    classes: (vegetation_class, codes), codes the character codes of a label, padded by 32.
    """
    share = F.when(F.col("variable").isin(*per_area), F.col("value") / cell_area).otherwise(F.col("value"))
    labels = classes.select("vegetation_class", F.rtrim(fn.decode_chars(F.col("codes"))).alias("label"))
    return areas.withColumn("value", share).join(F.broadcast(labels), "vegetation_class", "left")


#: The datasets, their pretty names and how their months are made.
CATALOGUE = {
    "AvitabileAGB": Loader("Avitabile AGB", "static"),
    "AvitabileThurnerAGB": Loader("Avitabile Thurner AGB", "static", {"AGBtree": "AGB Tree"}),
    "CarvalhaisGPP": Loader("Carvalhais GPP", "static"),
    "CCI_BurnedArea_MERIS_4_1": Loader("CCI MERIS 4.1", "daily", {"burned_area": "CCI MERIS BA"}, per_area=True),
    "CCI_BurnedArea_MODIS_5_1": Loader("CCI MODIS 5.1", "monthly", {"burned_area": "CCI MODIS BA"}, per_area=True),
    "CHELSA": Loader("CHELSA", "monthly", {"maximum temperature": "Max Temp", "minimum temperature": "Min Temp", "mean temperature": "Mean Temp", "monthly precipitation": "Precipitation"}),
    "Copernicus_SWI": Loader("Copernicus SWI", "monthly", {"Soil Water Index with T=1": "SWI(1)"}),
    "CRU": Loader("CRU"),
    "ERA5_Temperature": Loader("ERA5 Temperature", "monthly", {"Mean 2 metre temperature": "Mean Temp", "Min 2 metre temperature": "Min Temp", "Max 2 metre temperature": "Max Temp", "DTR 2 metre temperature": "Diurnal Temp Range"}),
    "ERA5_TotalPrecipitation": Loader("ERA5 Total Precipitation", "monthly", {"Total precipitation": "Precipitation"}),
    "ERA5_DryDayPeriod": Loader("ERA5 Dry Day Period", "monthly", {"dry_day_period": "Dry Day Period"}),
    "ERA5_CAPEPrecip": Loader("ERA5 Cape x Precip", "monthly", {"Product of CAPE and Precipitation": "CAPE x Precip"}),
    "ESA_CCI_Fire": Loader("ESA CCI Fire", "yearly"),
    "ESA_CCI_Landcover": Loader("ESA Landcover", "yearly"),
    "Ext_ESA_CCI_Landcover_PFT": Loader("Ext ESA Landcover", "yearly", scale=0.01),
    "ESA_CCI_Landcover_PFT": Loader("ESA Landcover PFT", "yearly"),
    "ESA_CCI_Soilmoisture": Loader("ESA CCI Soil Moisture"),
    "GFEDv4": Loader("GFED4", "monthly", {"monthly burned area": "GFED4 BA"}, per_area=True),
    "GFEDv4s": Loader("GFED4s", "monthly", {"Burnt_Area": "GFED4s BA"}),
    "GlobFluo_SIF": Loader("Glob Fluo SIF", low=0.0, high=20.0),
    "GPW_v4_pop_dens": Loader("GPW4 Pop Density", "yearly"),
    "GSMaP_dry_day_period": Loader("GSMaP Dry Day Period", "monthly", {"dry_day_period": "Dry Day Period"}),
    "GSMaP_precipitation": Loader("GSMaP Precipitation", "monthly", {"dry_days": "Dry Days", "precip": "Precipitation"}),
    "HYDE": Loader("HYDE", "yearly"),
    "Ext_HYDE": Loader("Ext HYDE", "yearly"),
    "LIS_OTD_lightning_climatology": Loader("LIS/OTD", "climatology", {"Combined Flash Rate Monthly Climatology": "Lightning Climatology"}, low=0.0),
    "LIS_OTD_lightning_time_series": Loader("LIS/OTD Time Series"),
    "Liu_VOD": Loader("Liu VOD", "monthly", {"VODorig": "VOD"}),
    "MCD64CMQ_C6": Loader("MCD64CMQ C6", "monthly", {"Burned Area": "MCD64CMQ BA"}, scale=0.01, per_area=True),
    "MOD15A2H_LAI_fPAR": Loader("MOD15A2H", "monthly", {"Fraction of Absorbed Photosynthetically Active Radiation": "FAPAR", "Leaf Area Index": "LAI"}),
    "Ext_MOD15A2H_fPAR": Loader("Ext MOD15A2H", "monthly", {"Fraction of Absorbed Photosynthetically Active Radiation": "FAPAR"}, low=0.0, high=1.0),
    "Simard_canopyheight": Loader("Simard Canopy Height", "static"),
    "Thurner_AGB": Loader("Thurner AGB", "static"),
    "VODCA": Loader("VODCA", "monthly", {"Vegetation optical depth Ku-band (18.7 GHz - 19.35 GHz)": "VOD Ku-band", "Vegetation optical depth X-band (10.65 GHz - 10.7 GHz)": "VOD X-band"}),
    "WWLLN": Loader("WWLLN Lightning", "monthly", {"frequency of lightning flashes per unit area": "lightning"}),
}

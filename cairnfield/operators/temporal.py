"""Reductions, selections, expansions and shifts along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import month_key, month_start
from ..tables import broadcast_up_to


def date_order_check(start: int | None, end: int | None) -> None:
    if (start is None) != (end is None):
        raise AssertionError("both limits or none")
    if start is not None and start > end:
        raise AssertionError("start lies after end")


def limit_months(cube: DataFrame, start: int, end: int, frequency: str = "monthly", time: str = "time") -> DataFrame:
    """Keep months start..end (keys, both included). Static data stay whole; yearly data keep the years that bracket them."""
    date_order_check(start, end)
    if frequency in ("static", "climatology"):
        return cube
    key = month_key(F.col(time))
    if frequency == "yearly":
        return cube.where(F.year(time).between(start // 12, end // 12 if end % 12 == 0 else end // 12 + 1))
    return cube.where(key.between(start, end))


def select_monthly(cube: DataFrame, start: int, end: int, inclusive_lower: bool = True, inclusive_upper: bool = True, time: str = "time") -> DataFrame:
    key = month_key(F.col(time))
    return cube.where((key >= start) if inclusive_lower else (key > start)).where((key <= end) if inclusive_upper else (key < end))


def mean_over_time(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return cube.groupBy(*keys).agg(F.avg(value).alias(value))


def monthly_mean(cube: DataFrame, keys: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """Mean per (month, key) of finer data."""
    return cube.groupBy(*keys, F.date_trunc("month", F.col(time)).cast("timestamp_ntz").alias(time)).agg(F.avg(value).alias(value))


def climatology(cube: DataFrame, keys: list[str], start: int | None = None, end: int | None = None, time: str = "time", value: str = "value") -> DataFrame:
    """Mean per month number (1..12) and key of the months start..end."""
    rows = cube if start is None else limit_months(cube, start, end, time=time)
    return rows.groupBy(*keys, F.month(time).alias("month")).agg(F.avg(value).alias(value))


def months_between(spark, start: int, end: int) -> DataFrame:
    date_order_check(start, end)
    return spark.range(start, end + 1).select(F.col("id").cast("int").alias("m")).select("m", month_start(F.col("m")).alias("time"))


def broadcast_static(static: DataFrame, start: int, end: int) -> DataFrame:
    """Every month start..end for each static row."""
    return static.crossJoin(F.broadcast(months_between(static.sparkSession, start, end)))


def broadcast_climatology(clim: DataFrame, start: int, end: int) -> DataFrame:
    """A 12-month climatology (month, ...) repeated over start..end."""
    months = months_between(clim.sparkSession, start, end).withColumn("month", F.month("time"))
    return clim.join(F.broadcast(months), "month")


def interpolate_yearly(yearly: DataFrame, keys: list[str], start: int, end: int, value: str = "value", limits: tuple[float, float] | None = None) -> DataFrame:
    """Yearly values (year, keys, value; dated 1 January) to months, linear in time.

    Months outside the years go on along the nearest segment; results outside of their variable's own least and largest
    value (of all values, if ``variable`` is no key) are masked. Each segment (year, next year) makes its own months, so nothing is joined by range.
    """
    by = Window.partitionBy(*keys).orderBy("year")
    seg = yearly.withColumns({"next_year": F.lead("year").over(by), "next_value": F.lead(value).over(by), "first": F.row_number().over(by) == 1})
    last = F.lead("year", 2).over(by)
    seg = seg.withColumn("last", last.isNull()).where("next_year is not null")
    from_ = F.when(F.col("first"), F.lit(start)).otherwise(F.col("year") * 12)
    to = F.when(F.col("last"), F.lit(end)).otherwise(F.col("next_year") * 12 - 1)
    from_, to = F.greatest(from_, F.lit(start)), F.least(to, F.lit(end))
    each = seg.where(from_ <= to).withColumn("m", F.explode(F.sequence(from_, to)))
    part = F.datediff(month_start(F.col("m")).cast("date"), F.make_date("year", F.lit(1), F.lit(1))) / F.datediff(F.make_date("next_year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    result = each.select(*keys, F.col("m").cast("int").alias("m"), (F.col(value) + part * (F.col("next_value") - F.col(value))).alias(value))
    if limits is None:
        own = [k for k in keys if k == "variable"]
        low_high = F.broadcast(yearly.groupBy(*own).agg(F.min(value).alias("low"), F.max(value).alias("high")))
        result = result.join(low_high, own) if own else result.crossJoin(low_high)
        inside = F.col(value).between(F.col("low"), F.col("high"))
    else:
        inside = F.col(value).between(*limits)
    return result.select(*keys, "m", F.when(inside, F.col(value)).alias(value))


def shift_months(cube: DataFrame, months: int, time: str = "time", variable: str | None = "variable") -> DataFrame:
    """Subtract ``months`` from the time (-1 moves January's data to February) and name the variable so."""
    if not isinstance(months, int) or isinstance(months, bool):
        raise ValueError("months must be an integer")
    if months == 0:
        return cube
    moved = cube.withColumn(time, month_start(month_key(F.col(time)) - months))
    return moved if variable is None or variable not in cube.columns else moved.withColumn(variable, F.concat(F.col(variable), F.lit(f" {months} Month")))


def lag_features(cube: DataFrame, keys: list[str], lags: list[int], time: str = "time", value: str = "value") -> DataFrame:
    """Columns value_lag{n}: the value n months before, NULL where that month is absent; rows need not be gapless."""
    by = Window.partitionBy(*keys).orderBy(month_key(F.col(time)))
    out = {f"{value}_lag{n}": F.max(value).over(by.rangeBetween(-n, -n)) for n in lags}
    return cube.withColumns(out)


def frequency(cube: DataFrame, time: str = "time") -> str:
    """static, monthly, yearly, climatology or the step in days, from the first two times in that order."""
    first = [r[0] for r in cube.select(time).distinct().orderBy(time).limit(2).collect()]
    if len(first) < 2 or first[0] is None:
        return "static"
    a, b = first
    months = (b.year - a.year) * 12 + b.month - a.month
    if months == 1:
        return "monthly"
    if months == 12:
        return "yearly"
    return f"{(b - a).days} days"


def time_spans(meta: DataFrame) -> DataFrame:
    """Span of each dataset and the row Overall: the latest start and the earliest end of those with monthly data."""
    each = meta.groupBy("dataset").agg(F.max("min_month").alias("min_month"), F.min("max_month").alias("max_month"), F.first("frequency").alias("frequency"))
    moving = each.where(~F.col("frequency").isin("static", "yearly", "climatology"))
    overall = moving.agg(F.lit("Overall").alias("dataset"), F.max("min_month").alias("min_month"), F.min("max_month").alias("max_month"), F.lit(None).cast("string").alias("frequency"))
    return each.unionByName(overall)


def overlap(meta: DataFrame) -> tuple[int, int] | tuple[None, None]:
    row = time_spans(meta).where("dataset = 'Overall'").select("min_month", "max_month").first()
    if row["min_month"] is None:
        return None, None
    if row["min_month"] > row["max_month"]:
        raise ValueError("the datasets have no months in common")
    return row["min_month"], row["max_month"]


def month_gaps(cube: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Rows whose month does not follow the one before."""
    by = Window.partitionBy(*keys).orderBy(month_key(F.col(time)))
    return cube.withColumn("gap", month_key(F.col(time)) - F.lag(month_key(F.col(time))).over(by)).where("gap <> 1")


def dispatch_monthly(cube: DataFrame, kind: str, start: int, end: int, keys: list[str]) -> DataFrame:
    """Monthly data of a dataset by what its time axis is."""
    if kind == "monthly":
        return select_monthly(cube, start, end)
    if kind == "static":
        return broadcast_static(cube, start, end)
    if kind == "climatology":
        return broadcast_climatology(cube, start, end)
    if kind == "yearly":
        return interpolate_yearly(cube, keys, start, end)
    return monthly_mean(limit_months(cube, start, end), keys)


def with_shifts(cube: DataFrame, variables: list[str], shifts: list[int], time: str = "time") -> DataFrame:
    """The cube and, for each shift, copies of the variables moved that many months later ("LAI -3 Month")."""
    out = cube
    for n in shifts:
        out = out.unionByName(shift_months(cube.where(F.col("variable").isin(*variables)), -n, time))
    return out


def year_groups(table: DataFrame, groups: dict[int, str], name: str = "file", year: Column | None = None, value: str = "value") -> DataFrame:
    """Files of one year with a column for each month: (columns, m, value). The year is the last four digits of the name's stem."""
    year = F.regexp_extract(name, r"(\d{4})\.[A-Za-z0-9]+$", 1).cast("int") if year is None else year
    rest = [c for c in table.columns if c not in groups.values()]
    listed = F.array(*[F.struct((year * 12 + month - 1).cast("int").alias("m"), F.col(c).alias(value)) for month, c in sorted(groups.items())])
    return table.select(*rest, F.inline(listed))


def slabs(table: DataFrame, years: list[int], raster: str = "raster") -> DataFrame:
    """Numbered rasters (1, 2, ..) to (year, ..): the first len(years) of them, as dated 1 January; the rest is no data of a year."""
    at = F.get(F.array(*[F.lit(y) for y in years]), F.col(raster) - 1)
    return table.withColumn("year", at).where("year is not null").drop(raster)


def yearly_files(table: DataFrame, variables: list[str], order: str = "file", first_year: int = 1992) -> DataFrame:
    """(year, ..) of one file a year in the order of names, each with the same variables; reading one with others is an error."""
    files = table.groupBy(order).agg(F.array_sort(F.collect_set("variable")).alias("_found"))
    same = F.col("_found") == F.array(*map(F.lit, sorted(variables)))
    year = F.when(same, (first_year - 1 + F.row_number().over(Window.orderBy(order))).cast("int")).otherwise(F.raise_error(F.concat(F.lit("other variables than asked for in "), F.col(order).cast("string"))).cast("int"))
    return table.join(broadcast_up_to(files.select(order, year.alias("year")), 100_000), order).drop(order)

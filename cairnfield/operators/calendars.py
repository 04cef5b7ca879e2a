"""Times as numbers since a base in a named calendar: decoding, encoding and one common unit.

Whole days are counted by arithmetic in Columns, so 29 February of a 365-day calendar and 30 February of a 360-day one exist
where they should, which timestamps could not hold. A date is (year, month, day, seconds of the day).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of calendars, by the rule they follow.
CALENDARS = {
    "standard": "standard",
    "gregorian": "standard",
    "proleptic_gregorian": "standard",
    "noleap": "noleap",
    "365_day": "noleap",
    "360_day": "360_day",
}
#: Seconds of a unit.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Days before each month of a year of 365 days.
BEFORE = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


class CalendarError(ValueError):
    """Calendars differ, or a unit or calendar is not known."""


def kind(calendar: str) -> str:
    if calendar not in CALENDARS:
        raise CalendarError(f"calendar {calendar!r} is none of {sorted(CALENDARS)}")
    return CALENDARS[calendar]


def parse_units(text: str) -> tuple[int, tuple[int, int, int], int]:
    """Seconds of the unit, base date and seconds of the base's day, of a text such as ``hours since 2000-01-01 06:00:00``."""
    m = re.fullmatch(r"\s*(second|minute|hour|day)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T\s]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?\s*", text)
    if not m:
        raise CalendarError(f"units {text!r} are not understood")
    h, mi, s = (int(x or 0) for x in m.groups()[4:])
    return UNITS[m[1]], (int(m[2]), int(m[3]), int(m[4])), h * 3600 + mi * 60 + s


def day_number(year: Column, month: Column, day: Column, calendar: str) -> Column:
    """Days since 1 January 1970 of the calendar."""
    rule = kind(calendar)
    if rule == "360_day":
        return ((year - 1970) * 360 + (month - 1) * 30 + day - 1).cast("long")
    if rule == "noleap":
        return ((year - 1970) * 365 + F.get(F.array(*map(F.lit, BEFORE)), (month - 1).cast("int")) + day - 1).cast("long")
    return F.unix_date(F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))).cast("long")


def date_of(days: Column, calendar: str) -> tuple[Column, Column, Column]:
    """(year, month, day) of a number of days since 1 January 1970."""
    rule = kind(calendar)
    if rule == "360_day":
        year, rest = F.floor(days / 360) + 1970, F.pmod(days, F.lit(360))
        return year.cast("int"), (F.floor(rest / 30) + 1).cast("int"), (rest % 30 + 1).cast("int")
    if rule == "noleap":
        rest, months = F.pmod(days, F.lit(365)), F.array(*map(F.lit, BEFORE))
        month = F.size(F.filter(months, lambda b: b <= rest))
        return (F.floor(days / 365) + 1970).cast("int"), month, (rest - F.get(months, month - 1) + 1).cast("int")
    date = F.date_from_unix_date(days.cast("int"))
    return F.year(date), F.month(date), F.dayofmonth(date)


def seconds_since_1970(value: Column, units: str, calendar: str) -> Column:
    """Seconds (double) from 1 January 1970 of the calendar."""
    size, (y, m, d), second = parse_units(units)
    base = day_number(F.lit(y), F.lit(m), F.lit(d), calendar)
    return base * 86400.0 + float(second) + value.cast("double") * float(size)


def convert(value: Column, units: str, to: str, calendar: str) -> Column:
    """A number in other units of the same calendar."""
    size, (y, m, d), second = parse_units(to)
    return (seconds_since_1970(value, units, calendar) - (day_number(F.lit(y), F.lit(m), F.lit(d), calendar) * 86400.0 + float(second))) / float(size)


def common_calendar(calendars: dict[str, str]) -> str:
    """The one calendar of all cubes, by name of cube; different ones are an error."""
    rules = {kind(c) for c in calendars.values()}
    if len(rules) != 1:
        raise CalendarError(f"calendars differ: {sorted(set(calendars.values()))}")
    return rules.pop()


def homogenise_time(cubes: dict[str, tuple[DataFrame, str | None, str]], time: str = "time", to: str = "days since 1970-01-01") -> dict[str, DataFrame]:
    """Cubes (table, units, calendar) with their times as numbers in one unit; without units a cube has no time axis, an error."""
    for name, (cube, units, _) in cubes.items():
        if units is None or time not in cube.columns:
            raise CalendarError(f"{name} has no time axis")
    calendar = common_calendar({name: c for name, (_, _, c) in cubes.items()})
    return {name: cube.withColumn(time, convert(F.col(time), units, to, calendar)) for name, (cube, units, _) in cubes.items()}


def with_dates(cube: DataFrame, units: str, calendar: str, time: str = "time", names: tuple[str, str, str, str] = ("year", "month", "day", "second")) -> DataFrame:
    """Add year, month, day and second of the day (rounded to whole seconds)."""
    total = F.round(seconds_since_1970(F.col(time), units, calendar)).cast("long")
    days = F.floor(total / F.lit(86400)).cast("long")
    return cube.withColumns(dict(zip(names, (*date_of(days, calendar), F.pmod(total, F.lit(86400)).cast("int")), strict=True)))


def month_length(year: Column, month: Column, calendar: str) -> Column:
    after = day_number(year + F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1), calendar)
    return (after - day_number(year, month, F.lit(1), calendar)).cast("int")


def mid_months(rows: DataFrame, calendar: str, year: str = "year", month: str = "month", to: str | None = None, name: str = "time") -> DataFrame:
    """Add the middle of each month, as a number in the units ``to`` (days since 1 January of the year 1970 by default)."""
    y, m = F.col(year).cast("int"), F.col(month).cast("int")
    middle = day_number(y, m, F.lit(1), calendar) + month_length(y, m, calendar) / 2
    return rows.withColumn(name, convert(middle, "days since 1970-01-01", to or "days since 1970-01-01", calendar))

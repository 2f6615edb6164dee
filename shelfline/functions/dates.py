"""Calendar parts of a date column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def monday_zero(day: Column | str) -> Column:
    """Day of the week, Monday = 0."""
    return F.weekday(day)


def is_weekend(day: Column | str) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def week_of_month(day: Column | str) -> Column:
    return F.ceil(F.dayofmonth(day) / 7).cast("int")


def _col(day: Column | str) -> Column:
    return F.col(day) if isinstance(day, str) else day


def edge_flags(day: Column | str) -> dict[str, Column]:
    """0/1 flags for the first and last day of month, quarter and year."""
    d = _col(day)
    tomorrow = F.date_add(d, 1)
    flags = {}
    for unit in ("year", "quarter", "month"):
        flags[f"is_{unit}_start"] = (F.trunc(d, unit) == d).cast("int")
        flags[f"is_{unit}_end"] = (F.trunc(tomorrow, unit) == tomorrow).cast("int")
    return flags


def parts(day: Column | str) -> dict[str, Column]:
    return {
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "week": F.weekofyear(day),
        "day": F.dayofmonth(day),
        "dayofweek": F.weekday(day),
    }


def sunday_one(day: Column | str) -> Column:
    """Day of the week, Sunday = 1."""
    return F.dayofweek(day)


def seven_day_week(day: Column | str) -> Column:
    """Complete seven-day periods since 1 January, plus one."""
    return (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int")

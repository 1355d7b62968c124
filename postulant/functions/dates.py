"""Calendar parts and date bounds."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postulant.functions import as_column

PERIODS = ("year", "month", "day")


def to_moment(value: Column | str) -> Column:
    """A timestamp; null if the value cannot be read as one."""
    return as_column(value).try_cast("timestamp")


def period_start(moment: Column | str, period: str) -> Column:
    """First day of the year, month or day: a plain date, cheap to group by."""
    day = as_column(moment).cast("date")
    return day if period == "day" else F.trunc(day, period)


def period_label(start: Column | str, period: str) -> Column:
    """Year as a number, month as `2024-03`, day as `2024-03-06`."""
    day = as_column(start)
    if period == "year":
        return F.year(day)
    return F.date_format(day, {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[period])


def calendar_part(moment: Column | str, period: str) -> Column:
    return period_label(period_start(moment, period), period)


def day_bounds(start: date, end: date, through_midnight: bool) -> tuple[datetime, datetime]:
    """Both bounds of a closed range of days.

    The range ends with the midnight after the last day, or one second before it.
    """
    first = datetime.combine(start, time())
    last = datetime.combine(end, time()) + timedelta(days=1)
    return first, last if through_midnight else last - timedelta(seconds=1)


def within_days(df: DataFrame, column: str, days: tuple[date, ...], through_midnight: bool) -> Column | None:
    """Range predicate, or None while a date is missing.

    The bounds get the column's own type, so that the scan can use them: with a
    bound of the other timestamp type Spark would cast the column instead. On a
    table partitioned by month only the folders of the range are read.
    """
    if len(days) != 2:
        return None
    kind = df.schema[column].dataType
    first, last = day_bounds(*days, through_midnight)
    inside = F.col(column).between(F.lit(str(first)).cast(kind), F.lit(str(last)).cast(kind))
    if "applied_month" in df.columns:
        # Wide enough for a table written under any other session time zone.
        slack = timedelta(days=2)
        inside &= F.col("applied_month").between(f"{first - slack:%Y-%m}", f"{last + slack:%Y-%m}")
    return inside

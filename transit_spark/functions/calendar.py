"""Dates: parsing, calendar parts and day types."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from transit_spark.fixed_values import HOLIDAY, HOLIDAYS, WEEKDAY, WEEKEND


def date_from_parts(text: Column) -> Column:
    """``'y,m,d'`` to a date; NULL for text that is no date (extra parts are ignored)."""
    parts = F.split(text, ",")
    numbers = [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    year, month, day = (n.cast("string") for n in numbers)
    return F.try_to_date(F.concat(F.lpad(year, 4, "0"), F.lit("-"), month, F.lit("-"), day), "yyyy-M-d")


def date_from_day_first(text: Column) -> Column:
    """``dd-MM-yyyy`` to a date; NULL for anything else."""
    return F.try_to_date(text, "dd-MM-yyyy")


def day_type(date: Column, holidays: Sequence[dt.date] = HOLIDAYS) -> Column:
    """2 on a holiday, else 1 on a weekend, else 0."""
    weekend = F.weekday(date) >= 5
    result = F.when(weekend, WEEKEND).otherwise(WEEKDAY)
    if holidays:
        result = F.when(date.isin(list(holidays)), HOLIDAY).otherwise(result)
    return result


def calendar_parts(date: Column) -> dict[str, Column]:
    """Month, day of month, weekday with Monday as 0, and ISO week."""
    return {
        "month": F.month(date),
        "day": F.day(date),
        "day_of_week": F.weekday(date),
        "week": F.weekofyear(date),
    }

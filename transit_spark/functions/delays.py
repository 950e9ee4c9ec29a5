"""Delay text, categories and flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from transit_spark.fixed_values import (
    MAINTENANCE_MINUTES,
    ON_TIME,
    ON_TIME_MINUTES,
    SIGNIFICANT_DELAY,
    SLIGHT_DELAY,
    SLIGHT_DELAY_MINUTES,
)


def delay_category(minutes: Column) -> Column:
    """Name of the delay band; NULL stays NULL."""
    return (
        F.when(minutes <= ON_TIME_MINUTES, ON_TIME)
        .when(minutes <= SLIGHT_DELAY_MINUTES, SLIGHT_DELAY)
        .when(minutes.isNotNull(), SIGNIFICANT_DELAY)
    )


def maintenance_flag(rolling: Column, threshold: float = MAINTENANCE_MINUTES) -> Column:
    """1 when the rolling average is above the threshold."""
    return F.when(rolling > threshold, 1).otherwise(0)


#: The texts a delay may have.
DELAY_TEXT = r"^(On Time( / 0 Min)?|\d{1,6} Min|\d{1,5}:[0-5]\d Hr)\z"


def delay_minutes(text: Column) -> Column:
    """``On Time``, ``On Time / 0 Min``, ``n Min`` and ``hh:mm Hr`` as minutes; NULL for every other text."""
    clean = F.when(F.trim(text).rlike(DELAY_TEXT), F.trim(text))
    number = F.substring_index(clean, " ", 1)
    hours, rest = (F.substring_index(number, ":", n).try_cast("int") for n in (1, -1))
    return (
        F.when(clean.startswith("On Time"), 0)
        .when(clean.endswith(" Min"), number.try_cast("int"))
        .when(clean.endswith(" Hr") & number.contains(":"), hours * 60 + rest)
    )

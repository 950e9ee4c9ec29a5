"""Booking flags and confidence bands.

Two treatments of NULL exist for waitlist and concession: under ``"absent"`` a
NULL means there is none, under ``"present"`` only the literal marker does.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from transit_spark.fixed_values import HIGH_CONFIDENCE, MEDIUM_CONFIDENCE

NULL_POLICIES = ("absent", "present")
CONFIRMED = "Confirmed"
NOT_CONFIRMED = "Not Confirmed"


def _is_marker(value: Column, marker: str, null_policy: str) -> Column:
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    return F.coalesce(value == marker, F.lit(null_policy == "absent"))


def is_waitlisted(waitlist: Column, null_policy: str = "absent") -> Column:
    return F.when(_is_marker(waitlist, "null", null_policy), 0).otherwise(1)


def waitlist_rank(waitlist: Column, null_policy: str = "absent") -> Column:
    """The number behind ``WL``; NULL for other waitlist text, 0 for none."""
    number = F.regexp_extract(waitlist, r"WL(\d+)", 1).try_cast("int")
    return F.when(_is_marker(waitlist, "null", null_policy), 0).otherwise(number)


def has_concession(concession: Column, null_policy: str = "absent") -> Column:
    return F.when(_is_marker(concession, "None", null_policy), 0).otherwise(1)


def is_holiday(season: Column) -> Column:
    return F.when(season == "Yes", 1).otherwise(0)


def is_confirmed(status: Column) -> Column:
    return F.when(status == CONFIRMED, 1).otherwise(0)


def confirmation_label(status: Column) -> Column:
    """Training label 1.0 or 0.0."""
    return is_confirmed(status).cast("double")


def waitlist_text(number: Column) -> Column:
    """``WL007`` for 7; NULL when there is no waitlist position."""
    return F.when(number > 0, F.format_string("WL%03d", number))


def confidence_band(probability: Column) -> Column:
    """High near 0 or 1, Low in the middle."""

    def outside(band):
        return (probability >= band[0]) | (probability <= band[1])

    return (
        F.when(outside(HIGH_CONFIDENCE), "High")
        .when(outside(MEDIUM_CONFIDENCE), "Medium")
        .when(probability.isNotNull(), "Low")
    )

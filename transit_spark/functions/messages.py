"""Text shown to users of the lookups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unknown_train(train: Column) -> Column:
    return F.format_string("Train %s not found. Please check the train number and try again.", train.cast("string"))


def encoding_failed(train: Column) -> Column:
    return F.format_string("Station encoding failed for train %s.", train.cast("string"))


def stop_delay(station: Column, minutes: Column) -> Column:
    return F.format_string("Predicted Delay at %s: %.2f minutes", station, minutes)


def stop_missing(station: Column, train: Column) -> Column:
    return F.format_string("Station '%s' not found in route for train %s", station, train.cast("string"))


def waiting_list(average: Column) -> Column:
    whole = F.bround(average, 0).cast("bigint").cast("string")
    return F.format_string("Predicted Waiting List: %s", F.coalesce(whole, F.lit("N/A")))


def route_line(train: Column, source: Column, destination: Column) -> Column:
    return F.format_string("Train %s: %s -> %s", train.cast("string"), source, destination)


NO_ROUTE = "No route found."


def possible_routes(lines: Column) -> Column:
    """Route lines under their heading."""
    return F.concat(F.lit("Possible Routes:\n"), F.array_join(lines, "\n"))

"""Route statistics of bookings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from transit_spark.fixed_values import FARE_PER_DISTANCE
from transit_spark.functions.numbers import exact_mean
from transit_spark.operators.joins import join_counted, with_global

ROUTE_KEYS = ("FromStation", "ToStation", "Class", "TrainType")


def route_stats(
    bookings: DataFrame,
    keys: Sequence[str] = ROUTE_KEYS,
    label: str = "label",
    distance: str = "Distance",
    fare: str | None = "Fare",
    booking_id: str = "PNR",
) -> DataFrame:
    """Confirmation rate, mean fare, mean distance and number of bookings per route."""
    measures = [F.avg(label).alias("route_confirmation_rate")]
    if fare:
        measures.append(exact_mean(F.col(fare)).alias("avg_fare_on_route"))
    measures += [
        exact_mean(F.col(distance)).alias("avg_distance"),
        F.count(booking_id).alias("bookings_count"),
    ]
    return bookings.groupBy(*keys).agg(*measures)


def out_of_fold_stats(
    bookings: DataFrame,
    fold: str,
    keys: Sequence[str] = ROUTE_KEYS,
    label: str = "label",
    distance: str = "Distance",
    fare: str | None = "Fare",
    booking_id: str = "PNR",
) -> DataFrame:
    """The same measures per route and fold, from the bookings of the other folds.

    Bookings are summed once per route and fold, before and after one shuffle by route; each fold's own sums are then
    taken off the route's. A route met in one fold only has NULLs and a count of 0 there. Rows without a fold count
    for every fold.
    """
    values = {"rate": label, "fare": fare, "distance": distance}
    sums = {f"__{n}": F.sum(F.col(c).cast("decimal(28,4)")) for n, c in values.items() if c}
    counts = {f"__{n}_n": F.count(c) for n, c in {**values, "all": booking_id}.items() if c}
    totals = bookings.groupBy(*keys, fold).agg(*[c.alias(n) for n, c in {**sums, **counts}.items()])
    route = Window.partitionBy(*keys)

    def others(n: str) -> Column:
        return F.sum(n).over(route) - F.coalesce(F.col(n), F.lit(0))

    def mean(n: str) -> Column:
        total = F.coalesce(F.sum(f"__{n}").over(route), F.lit(0)) - F.coalesce(F.col(f"__{n}"), F.lit(0))
        return total.cast("double") / F.nullif(others(f"__{n}_n"), F.lit(0))

    measures = [mean("rate").alias("route_confirmation_rate")]
    if fare:
        measures.append(mean("fare").alias("avg_fare_on_route"))
    measures += [mean("distance").alias("avg_distance"), others("__all_n").alias("bookings_count")]
    return totals.select(*keys, fold, *measures).filter(F.col(fold).isNotNull())


def enrich_out_of_fold(
    bookings: DataFrame, fold: str, keys: Sequence[str] = ROUTE_KEYS, **columns
) -> DataFrame:
    """Route statistics on every booking that its own fold had no part in."""
    return join_counted(bookings, out_of_fold_stats(bookings, fold, keys, **columns), [*keys, fold])


def enrich_routes(
    bookings: DataFrame, stats: DataFrame | None = None, keys: Sequence[str] = ROUTE_KEYS, **columns
) -> DataFrame:
    """Route statistics back on every booking.

    ``stats`` may come from part of the bookings, such as the training rows, so
    that the label of a test row does not reach its own features. By default it
    covers all of them.
    """
    if stats is None:
        stats = route_stats(bookings, keys, **columns)
    return join_counted(bookings, stats, list(keys))


def global_stats(
    bookings: DataFrame, label: str = "label", distance: str = "Distance", booking_id: str = "PNR"
) -> DataFrame:
    """The same measures over the whole table, in one row."""
    return bookings.agg(
        F.avg(label).alias("route_confirmation_rate"),
        exact_mean(F.col(distance)).alias("avg_distance"),
        F.count(booking_id).cast("double").alias("bookings_count"),
    )


def class_route_stats(
    stats: DataFrame, keys: Sequence[str] = ("FromStation", "ToStation", "Class"), weighted: bool = False
) -> DataFrame:
    """Route statistics folded over the remaining key.

    Each group counts once whatever its number of bookings; ``weighted=True``
    weights it by them.
    """
    weight = F.col("bookings_count") if weighted else F.lit(1)
    return stats.groupBy(*keys).agg(
        *[
            (F.sum(F.col(c) * weight) / F.sum(weight)).alias(c)
            for c in ("route_confirmation_rate", "avg_distance")
        ],
        exact_mean(F.col("bookings_count")).alias("bookings_count"),
    )


def lookup_route_stats(
    requests: DataFrame,
    stats: DataFrame,
    overall: DataFrame,
    keys: Sequence[str] = ("FromStation", "ToStation", "Class"),
    weighted: bool = False,
) -> DataFrame:
    """Statistics of each request's route, or of the whole table for an unknown route.

    Adds the fare estimate and whether the route was known.
    """
    measures = ("route_confirmation_rate", "avg_distance", "bookings_count")
    found = join_counted(requests, class_route_stats(stats, keys, weighted), list(keys))
    known = F.col("route_confirmation_rate").isNotNull()
    both = with_global(found, overall, "__all_")
    chosen = both.select(
        *requests.columns,
        known.alias("route_known"),
        *[F.when(known, F.col(m)).otherwise(F.col(f"__all_{m}")).alias(m) for m in measures],
    )
    return chosen.withColumn("fare_estimate", F.col("avg_distance") * FARE_PER_DISTANCE)

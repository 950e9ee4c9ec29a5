"""Bookings from raw rows to the training table, and scoring of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from transit_spark.fixed_values import BOOKING_REQUEST_DEFAULTS
from transit_spark.functions import bookings as fb
from transit_spark.functions.numbers import report_round
from transit_spark.operators.encode import FOLD, hash_bucket, hash_split
from transit_spark.operators.reshape import underscore_names
from transit_spark.operators.routes import ROUTE_KEYS, enrich_out_of_fold, enrich_routes, lookup_route_stats, route_stats
from transit_spark.schemas import BOOKING_REQUESTS
from transit_spark.sinks.tables import publish_path, publish_table, register_external

# Source column of each flag, by layout of the bookings table.
PATH_LAYOUT = {
    "waitlist": "Waitlist No",
    "season": "Holiday Season",
    "concession": "Concession",
    "status": "BookingStatus",
    "final": "FinalStatus",
    "required": ("Distance", "Fare", "Passengers"),
}
CATALOG_LAYOUT = {
    "waitlist": "Waitlist Position",
    "season": "Holiday or Peak Season",
    "concession": "Special Considerations",
    "status": "Current Status",
    "final": "Confirmation Status",
    "required": ("Travel Distance", "Number of Passengers"),
}

REQUEST_COLUMNS = tuple(BOOKING_REQUESTS.names)

CATALOG_ROUTE_KEYS = ("Source_Station", "Destination_Station", "Class_of_Travel", "Train_Type")
CATALOG_COLUMNS = {"label": "label", "distance": "Travel_Distance", "fare": None, "booking_id": "PNR_Number"}

# Path names to catalog names, for columns both layouts have.
PATH_TO_CATALOG = {
    "PNR": "PNR Number",
    "TrainNo": "Train Number",
    "BookingDate": "Booking Date",
    "Class": "Class of Travel",
    "FromStation": "Source Station",
    "ToStation": "Destination Station",
    "TravelDate": "Date of Journey",
    "BookingStatus": "Current Status",
    "Passengers": "Number of Passengers",
    "PassengerType": "Age of Passengers",
    "BookingChannel": "Booking Channel",
    "Distance": "Travel Distance",
    "TrainType": "Train Type",
    "Concession": "Special Considerations",
    "Holiday Season": "Holiday or Peak Season",
    "Waitlist No": "Waitlist Position",
    "FinalStatus": "Confirmation Status",
}


def silver(bookings: DataFrame, layout: dict = PATH_LAYOUT, null_policy: str = "absent") -> DataFrame:
    """Flags and label; rows without the required numbers are dropped."""

    def source(role: str):
        return F.col(f"`{layout[role]}`")

    flagged = bookings.withColumns(
        {
            "IsWaitlisted": fb.is_waitlisted(source("waitlist"), null_policy),
            "WaitlistRank": fb.waitlist_rank(source("waitlist"), null_policy),
            "IsHoliday": fb.is_holiday(source("season")),
            "HasConcession": fb.has_concession(source("concession"), null_policy),
            "IsConfirmed_AtBooking": fb.is_confirmed(source("status")),
            "label": fb.confirmation_label(source("final")),
        }
    )
    return flagged.dropna(subset=[f"`{c}`" for c in layout["required"]])


def silver_from_path(bookings: DataFrame) -> DataFrame:
    return silver(bookings, PATH_LAYOUT, "present")


def silver_from_catalog(bookings: DataFrame) -> DataFrame:
    return underscore_names(silver(bookings, CATALOG_LAYOUT, "absent"))


def build_booking_tables(raw: DataFrame, root: str, prefix: str = "railways_") -> dict[str, DataFrame]:
    """Bronze, silver and gold tables as folders under ``root``, each registered in the catalog.

    Every layer is read back from what was published, so nothing is computed twice.
    """
    spark = raw.sparkSession
    layers = {"bronze": lambda: raw, "silver": lambda: silver_from_path(built["bronze"]), "gold": lambda: route_stats(built["silver"])}
    built: dict[str, DataFrame] = {}
    for layer, make in layers.items():
        path = f"{root}/{layer}"
        publish_path(make(), path)
        register_external(spark, prefix + layer, path)
        built[layer] = spark.read.parquet(path)
    return built


def build_catalog_tables(source: DataFrame, silver_table: str, gold_table: str) -> DataFrame:
    """Silver and gold as managed tables from the catalog layout; returns the training table."""
    spark = source.sparkSession
    publish_table(silver_from_catalog(source), silver_table)
    publish_table(route_stats(spark.table(silver_table), CATALOG_ROUTE_KEYS, **CATALOG_COLUMNS), gold_table)
    return enrich_routes(spark.table(silver_table), spark.table(gold_table), CATALOG_ROUTE_KEYS)


def training_set(
    silver_bookings: DataFrame,
    keys: Sequence[str] = ROUTE_KEYS,
    split_key: Sequence[str] = ("PNR",),
    fit_on: str = "all",
    folds: int = 3,
    bucket: str | None = None,
    **columns,
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with route statistics.

    With ``fit_on="all"`` the statistics cover every row, test labels included;
    ``"train"`` uses the training rows only; with ``"out_of_fold"`` a training row
    has the statistics of the training rows in other folds and a column ``fold``,
    so that no row, held out or not, meets its own label.

    ``bucket`` names a column that holds the rows' ``hash_bucket``, so that no pass computes it again; it is left out
    of what is returned.
    """
    if fit_on not in ("all", "train", "out_of_fold"):
        raise ValueError("fit_on must be 'all', 'train' or 'out_of_fold'")
    drop = [bucket] if bucket else []
    if fit_on == "all":
        train, test = hash_split(enrich_routes(silver_bookings, None, keys, **columns), *split_key, bucket=bucket)
        return train.drop(*drop), test.drop(*drop)
    train, test = hash_split(silver_bookings, *split_key, bucket=bucket)
    if fit_on == "out_of_fold":
        train = train.withColumn(FOLD, ((F.col(bucket) if bucket else hash_bucket(*split_key)) % folds).cast("int"))
    train, test = train.drop(*drop), test.drop(*drop)
    stats = route_stats(train, keys, **columns)
    if fit_on == "out_of_fold":
        return enrich_out_of_fold(train, FOLD, keys, **columns), enrich_routes(test, stats, keys)
    return enrich_routes(train, stats, keys), enrich_routes(test, stats, keys)


def request_inputs(
    requests: DataFrame, stats: DataFrame, overall: DataFrame, constants: dict | None = None, weighted: bool = False
) -> DataFrame:
    """Model inputs for requests ``(train_no, booking_status, waitlist_number, travel_class,
    from_station, to_station, travel_date)`` in the column names of the path layout.

    Columns a request does not carry come from ``constants``, over the fixed defaults. ``stats`` and
    ``overall`` are the route table and its one-row summary.
    """
    waiting = F.col("waitlist_number")
    defaults = {**BOOKING_REQUEST_DEFAULTS, **(constants or {})}
    named = requests.withColumns(
        {
            "TrainNo": F.col("train_no"),
            "Class": F.col("travel_class"),
            "FromStation": F.col("from_station"),
            "ToStation": F.col("to_station"),
            "BookingStatus": F.col("booking_status"),
            "Waitlist No": fb.waitlist_text(waiting),
            "IsWaitlisted": F.when(waiting > 0, 1).otherwise(0),
            "WaitlistRank": waiting,
            "IsHoliday": fb.is_holiday(F.lit(defaults["Holiday Season"])),
            "HasConcession": fb.has_concession(F.lit(defaults["Concession"])),
            "IsConfirmed_AtBooking": fb.is_confirmed(F.col("booking_status")),
            **{c: F.lit(v) for c, v in defaults.items()},
        }
    )
    enriched = lookup_route_stats(named, stats, overall, weighted=weighted)
    return enriched.withColumns(
        {
            "Distance": F.col("avg_distance").cast("int"),
            "Fare": F.col("fare_estimate"),
            "avg_fare_on_route": F.col("fare_estimate"),
        }
    )


def score_bookings(inputs: DataFrame, model, keep: Sequence[str] = REQUEST_COLUMNS) -> DataFrame:
    """Probability of confirmation, prediction and confidence for every request, in one plan."""
    scored = model.transform(inputs).withColumn("__p", vector_to_array("probability"))
    confirmed = F.col("__p")[1]
    return scored.select(
        *keep,
        report_round(confirmed, 4).alias("confirmed_probability"),
        report_round(F.col("__p")[0], 4).alias("not_confirmed_probability"),
        F.when(F.col("prediction") == 1, fb.CONFIRMED).otherwise(fb.NOT_CONFIRMED).alias("predicted_status"),
        fb.confidence_band(confirmed).alias("confidence"),
        (F.col("IsWaitlisted") == 1).alias("is_waitlisted"),
        report_round(F.col("route_confirmation_rate"), 4).alias("route_conf_rate"),
    )

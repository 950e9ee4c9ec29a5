"""Table schemas."""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "date": DateType(),
    "timestamp": TimestampType(),
}


def struct(**fields: str) -> StructType:
    """Field names to type names; a trailing ``!`` means not nullable. Needs no session."""
    return StructType([StructField(n, _TYPES[t.rstrip("!")], not t.endswith("!")) for n, t in fields.items()])


# One document per train; row 0 of ``data`` is the header, later rows start with the date text.
# Header cells may be objects, so every cell is read as text.
DELAY_DOCUMENT = StructType(
    [
        StructField("Number", StringType()),
        StructField("Name", StringType()),
        StructField("data", ArrayType(ArrayType(StringType()))),
    ]
)

DELAY_FACTS = struct(
    train_number="int!",
    train_name="string!",
    station="string!",
    delay_min="int",
    travel_date="date",
    ingested_at="timestamp",
)

WEATHER_CSV = struct(
    **{
        "Date": "string",
        "Latitude": "double",
        "Longitude": "double",
        "weather_code (wmo code)": "int",
        "precipitation_sum (mm)": "double",
    }
)

STATION_MASTER = struct(station_code="string", station_name="string", latitude="double", longitude="double")

BOOKINGS = struct(
    **{
        "PNR": "string",
        "TrainNo": "int",
        "BookingDate": "string",
        "Class": "string",
        "Quota": "string",
        "FromStation": "string",
        "ToStation": "string",
        "TravelDate": "string",
        "BookingStatus": "string",
        "Passengers": "int",
        "PassengerType": "string",
        "BookingChannel": "string",
        "Distance": "int",
        "No of Stations": "int",
        "Travel Time": "int",
        "TrainType": "string",
        "Fare": "int",
        "Concession": "string",
        "Holiday Season": "string",
        "Waitlist No": "string",
        "FinalStatus": "string",
    }
)

STATION_PAIRS = struct(train_number="int", station="string")

SCRAPED_DELAYS = struct(**{"Train Number": "string", "Station Name": "string", "Delay": "string"})

DELAY_REQUESTS = struct(train_number="int", travel_date="date")

BOOKING_REQUESTS = struct(
    train_no="int",
    booking_status="string",
    waitlist_number="int",
    travel_class="string",
    from_station="string",
    to_station="string",
    travel_date="string",
)

SCHEDULE = struct(
    train_number="string", source_station="string", destination_station="string", scheduled_departure="string"
)

WAITING_LIST = struct(source_station="string", train_number="string", waiting_list="int")

PUBLISH_LOG = struct(version="bigint", timestamp="timestamp", operation="string", path="string")

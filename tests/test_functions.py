import datetime as dt

from pyspark.sql import functions as F

from transit_spark.functions import bookings as fb, messages
from transit_spark.functions.calendar import calendar_parts, date_from_day_first, date_from_parts, day_type
from transit_spark.functions.delays import delay_category, delay_minutes, maintenance_flag
from transit_spark.functions.numbers import key_round, report_round
from transit_spark.functions.weather import weather_risk


def values(spark, inputs, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i INT, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_dates_from_parts(spark):
    texts = ["2025,2,3", "2025,2,30", "2025,0,1", "2025,13,1", "2025,1,0", "2025,1", "soon", None, "2025, 02 ,03", "2024,2,29", "2025,2,3,9"]
    good = dt.date(2025, 2, 3)
    assert values(spark, texts, "STRING", date_from_parts) == [
        good, None, None, None, None, None, None, None, good, dt.date(2024, 2, 29), good,
    ]


def test_day_first_dates(spark):
    assert values(spark, ["01-02-2025", "31-04-2025", "x"], "STRING", date_from_day_first) == [dt.date(2025, 2, 1), None, None]


def test_day_type(spark):
    days = [dt.date(2025, 1, 26), dt.date(2025, 1, 25), dt.date(2025, 1, 27), dt.date(2025, 8, 15)]
    assert values(spark, days, "DATE", day_type) == [2, 1, 0, 2]
    assert values(spark, days, "DATE", lambda c: day_type(c, [])) == [1, 1, 0, 0]


def test_calendar_parts(spark):
    parts = calendar_parts(F.lit(dt.date(2026, 4, 5)))
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert row.asDict() == {"month": 4, "day": 5, "day_of_week": 6, "week": 14}


def test_weather_risk(spark):
    codes = [0, 2, 53, 61, 81, 45, 95, 71, None]
    assert values(spark, codes, "INT", weather_risk) == [0, 1, 2, 3, 3, 3, 4, 1, 1]


def test_waitlist_policies(spark):
    texts = ["null", None, "WL12", "RAC3", "WL007"]
    assert values(spark, texts, "STRING", fb.is_waitlisted) == [0, 0, 1, 1, 1]
    assert values(spark, texts, "STRING", fb.waitlist_rank) == [0, 0, 12, None, 7]
    assert values(spark, texts, "STRING", lambda c: fb.is_waitlisted(c, "present")) == [0, 1, 1, 1, 1]
    assert values(spark, texts, "STRING", lambda c: fb.waitlist_rank(c, "present")) == [0, None, 12, None, 7]


def test_concession_policies(spark):
    texts = ["None", None, "Senior"]
    assert values(spark, texts, "STRING", fb.has_concession) == [0, 0, 1]
    assert values(spark, texts, "STRING", lambda c: fb.has_concession(c, "present")) == [0, 1, 1]


def test_other_booking_flags(spark):
    assert values(spark, ["Yes", "No", None], "STRING", fb.is_holiday) == [1, 0, 0]
    assert values(spark, ["Confirmed", "WL", None], "STRING", fb.confirmation_label) == [1.0, 0.0, 0.0]
    assert values(spark, [7, 0, 1234], "INT", fb.waitlist_text) == ["WL007", None, "WL1234"]


def test_confidence_band(spark):
    assert values(spark, [0.75, 0.25, 0.60, 0.40, 0.59, 0.50, None], "DOUBLE", fb.confidence_band) == [
        "High", "High", "Medium", "Medium", "Low", "Low", None,
    ]


def test_delay_category_and_flag(spark):
    assert values(spark, [15.0, 15.1, 60.0, 60.1, None], "DOUBLE", delay_category) == [
        "On Time", "Slight Delay", "Slight Delay", "Significant Delay", None,
    ]
    assert values(spark, [15.0, 15.01, None], "DOUBLE", maintenance_flag) == [0, 1, 0]


def test_delay_minutes(spark):
    texts = ["On Time", "On Time / 0 Min", "13 Min", "02:38 Hr", "15:40 Hr", "N/A", " 60 Min ", None]
    assert values(spark, texts, "STRING", delay_minutes) == [0, 0, 13, 158, 940, None, 60, None]


def test_delay_minutes_of_other_text(spark):
    texts = ["13 foo Min", "1:99 Hr", "5:30:10 Hr", "-5 Min", "On Timetable", "Min", " Min", "1 Hr", "13 Min\n", "", "١ Min", "1.5 Min", "9999999 Min"]
    assert values(spark, texts, "STRING", delay_minutes) == [None] * len(texts)


def test_rounding(spark):
    assert values(spark, [0.25], "DOUBLE", lambda c: report_round(c, 1)) == [0.2]
    assert values(spark, [0.25], "DOUBLE", lambda c: key_round(c, 1)) == [0.3]
    assert [str(v) for v in values(spark, [-0.001], "DOUBLE", key_round)] == ["0.0"]


def test_messages(spark):
    assert values(spark, [2.5, 3.5, None], "DOUBLE", messages.waiting_list) == [
        "Predicted Waiting List: 2", "Predicted Waiting List: 4", "Predicted Waiting List: N/A",
    ]
    assert values(spark, [7.0], "DOUBLE", lambda c: messages.stop_delay(F.lit("MAS"), c)) == [
        "Predicted Delay at MAS: 7.00 minutes"
    ]

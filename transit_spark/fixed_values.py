"""Fixed values that results depend on."""

import datetime as dt

# Public holidays of the calendar the delay features use.
HOLIDAYS = [
    dt.date(2025, 1, 26),
    dt.date(2025, 3, 17),
    dt.date(2025, 4, 14),
    dt.date(2025, 4, 18),
    dt.date(2025, 8, 15),
    dt.date(2025, 10, 2),
    dt.date(2025, 10, 20),
    dt.date(2025, 11, 5),
    dt.date(2025, 12, 25),
]

# Day types.
WEEKDAY, WEEKEND, HOLIDAY = 0, 1, 2

# WMO weather codes by risk score; every other code scores DEFAULT_WEATHER_RISK.
WEATHER_RISK = {
    0: [0],
    1: [1, 2, 3],
    2: [51, 53, 55],
    3: [45, 48, 61, 63, 65, 80, 81, 82],
    4: [95, 96, 99],
}
DEFAULT_WEATHER_RISK = 1

# Rolling history in days and the average, in minutes, above which maintenance is likely.
HISTORY_DAYS = 3
MAINTENANCE_MINUTES = 15

# Upper ends, in minutes, of the delay categories and their names.
ON_TIME_MINUTES, SLIGHT_DELAY_MINUTES = 15, 60
ON_TIME, SLIGHT_DELAY, SIGNIFICANT_DELAY = "On Time", "Slight Delay", "Significant Delay"

# Confidence bands, as distance of the probability from 0 or 1.
HIGH_CONFIDENCE = (0.75, 0.25)
MEDIUM_CONFIDENCE = (0.60, 0.40)

# Features of a stop for which only the train and station are known.
BARE_STOP_DEFAULTS = {"rolling_72hr_avg_delay": 15.0, "is_maintenance_likely": 0}

# Text shown for missing parts of a scraped card.
MISSING_TEXT = "N/A"
NO_DELAY_TEXT = "On Time / 0 Min"

# Run blocks that hold complete days.
COMPLETE_BLOCKS = [1, 2, 3]

# Stations of the route whose weather coverage is reported.
COVERAGE_STATIONS = ["CBE", "MAS", "AJJ", "KPD", "JTJ", "SA", "ED", "TUP", "CBF"]

# Fare estimate per distance unit.
FARE_PER_DISTANCE = 0.5

# Request fields the booking scorer fills in when a request does not carry them.
BOOKING_REQUEST_DEFAULTS = {
    "Quota": "General",
    "Passengers": 1,
    "PassengerType": "Adult",
    "BookingChannel": "IRCTC Website",
    "TrainType": "Express",
    "Seat_Availability": 100,
    "Concession": "None",
    "Holiday Season": "No",
}

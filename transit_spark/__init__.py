"""Spark-native analytics for transport delays and bookings.

Every operator takes DataFrames and returns DataFrames; column names are
parameters, so the same operator runs on any table with the right shape.
"""

__version__ = "0.1.0"

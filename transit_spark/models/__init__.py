"""Spark ML pipelines for delays, confirmations and fares."""

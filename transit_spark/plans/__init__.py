"""Operators put together into the delay and booking flows."""

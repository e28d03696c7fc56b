"""Dates and clock times as text, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def clock(c: Column) -> Column:
    return F.date_format(c, "HH:mm")


def parse_iso(c: Column) -> Column:
    """ISO date or timestamp text; anything else is NULL."""
    return F.try_to_timestamp(c)

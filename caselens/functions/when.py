"""Timestamp expressions. Everything is wall-clock UTC in TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text formats, tried in this order.
TEXT_FORMATS = [
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "M/d/yyyy H:m:s",
]
MICROS_1601_TO_1970 = 11644473600000000


def parse_ts(col: Column, default: Column | None = None) -> Column:
    text = F.trim(col)
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TEXT_FORMATS]
    return F.coalesce(*tries, *([default] if default is not None else []))


def from_chrome_micros(col: Column) -> Column:
    return F.timestamp_micros(col - F.lit(MICROS_1601_TO_1970)).cast("timestamp_ntz")


def from_firefox_micros(col: Column) -> Column:
    return F.timestamp_micros(col).cast("timestamp_ntz")


def hour_or_noon(col: Column) -> Column:
    return F.coalesce(F.hour(col), F.lit(12)).cast("double")


def is_weekend(col: Column) -> Column:
    return F.when(F.weekday(col) >= 5, 1.0).otherwise(0.0)


def micros(col: Column) -> Column:
    """Microseconds since 1970, exact, for bucketing and gap tests."""
    return F.unix_micros(col.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)

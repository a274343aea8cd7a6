"""Heuristic alerts over batch tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.when import micros


def brute_force(failures: DataFrame, threshold: int = 10, seconds: int = 60) -> DataFrame:
    """Rows that complete ``threshold`` failures from one ip within ``seconds``.

    An ip is first cut into time slots as wide as the window. A slot needs only
    itself and the end of the slot before it, so every row is sent to its own
    slot and, as history, to the next one: a busy ip is spread over its slots.
    """
    width = seconds * 1_000_000
    us = micros(F.col("ts"))
    slots = failures.withColumn("_us", us).withColumn(
        "_copy", F.explode(F.array(F.lit(0), F.lit(1)))
    ).withColumn("_slot", F.floor(F.col("_us") / width) + F.col("_copy"))
    w = Window.partitionBy("ip", "_slot").orderBy("_us").rangeBetween(-width, 0)
    return (
        slots.withColumn("failures", F.count("*").over(w))
        .filter((F.col("_copy") == 0) & (F.col("failures") >= threshold))
        .drop("_us", "_copy", "_slot")
    )


def log_cleared(events: DataFrame) -> DataFrame:
    return events.filter(F.col("win_event_id") == 1102)


def admin_after_hours(events: DataFrame, start: int = 8, end: int = 18) -> DataFrame:
    """Special privileges assigned outside working hours."""
    h = F.hour("ts")
    return events.filter((F.col("win_event_id") == 4672) & ((h < start) | (h >= end)))


def long_dns(events: DataFrame, limit: int = 45) -> DataFrame:
    return events.filter(F.length("dns_query") > limit)

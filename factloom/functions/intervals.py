"""Half-open intervals with null as unbounded, on both time axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def holds_at(start: Column, end: Column, at: Column) -> Column:
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def known_at(recorded: Column, at: Column) -> Column:
    return recorded <= at


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether the later start lies before the earlier end; an interval without length overlaps nothing."""
    start, end = F.greatest(start_a, start_b), F.least(end_a, end_b)  # nulls are skipped
    return start.isNull() | end.isNull() | (start < end)


def lives(created: Column, ttl_seconds: Column, at: Column) -> Column:
    return ttl_seconds.isNull() | (created + F.make_dt_interval(secs=ttl_seconds.cast("decimal(18,6)")) > at)


def age_days(since: Column, at: Column) -> Column:
    """Days from since to at, not below zero."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0.0), (micros(at) - micros(since)) / 86_400_000_000.0)

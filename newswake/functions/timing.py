"""Dates and times as Column expressions, in UTC and without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_ntz(instant: Column) -> Column:
    """The UTC wall-clock time of a timestamp, whatever the session zone."""
    return _from_micros(F.unix_micros(instant))


def _from_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def parse_created_at(text: Column) -> Column:
    """``Wed Nov 16 08:15:00 +0000 2016``; null when malformed. The weekday is not needed."""
    return utc_ntz(F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy")))


def parse_timestamp_ms(text: Column) -> Column:
    """Epoch milliseconds; null when missing or malformed."""
    return _from_micros(text.try_cast("bigint") * F.lit(1000))


def parse_compact(text: Column) -> Column:
    """``20161115T181832``; null when malformed."""
    return utc_ntz(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit("yyyyMMdd'T'HHmmss Z")))


def date_shift(time: Column, *, days=0, hours=0, minutes=0, seconds=0) -> Column:
    """Time plus the given amounts (each may be a fraction or negative) as ``YYYY-MM-DDThh:mm:ss``."""
    shift = float(((days * 24 + hours) * 60 + minutes) * 60 + seconds)
    micros = F.lit(round(shift * 1_000_000)).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)")
    zero = F.lit(0)
    shifted = time + F.make_dt_interval(zero, zero, zero, micros.cast("decimal(18,6)"))
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss")


def day_noon(day: str) -> Column:
    """Noon of a ``YYYYMMDD`` day."""
    return parse_compact(F.concat(F.lit(day), F.lit("T120000")))


def event_window(day: str, n_days: float = 3) -> tuple[Column, Column]:
    """From ``n_days`` before noon of the day until one day after it."""
    noon = day_noon(day)
    return noon - F.expr(f"make_dt_interval(0, 0, 0, {n_days * 86400:.6f})"), noon + F.expr("INTERVAL '1' DAY")


def day_window(day: str) -> tuple[Column, Column]:
    noon = day_noon(day)
    return noon - F.expr("INTERVAL '12' HOUR"), noon + F.expr("INTERVAL '12' HOUR")


def elapsed_steps(start: Column, end: Column, unit: str = "HOUR") -> Column:
    """Whole hours or days from start to end."""
    return F.timestamp_diff(unit, start, end)


def epoch_seconds(time: Column) -> Column:
    """Seconds since 1970, rounded half to even."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, time)
    return F.bround(micros.cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)"), 0).cast("bigint")


def epoch_millis(time: Column) -> Column:
    """Milliseconds since 1970."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)

"""Date/time functions (Column -> Column) on TIMESTAMP_NTZ columns.

All differences are taken in microseconds with ``timestamp_diff`` so that
whole-day counts can be *floored* (``-1 h`` is day ``-1``), which neither
``datediff`` (counts midnights) nor ``timestampdiff(DAY)`` (truncates) does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(a: Column | str, b: Column | str) -> Column:
    """``b - a`` in microseconds (BIGINT)."""
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b))


def whole_days_between(a: Column | str, b: Column | str) -> Column:
    """floor((b - a) / 1 day) as BIGINT; null if either side is null."""
    return F.floor(micros_between(a, b) / F.lit(MICROS_PER_DAY)).cast("long")


def age_years(dob: Column | str, at: Column | str) -> Column:
    """Whole days from ``dob`` to ``at`` divided by 365.0."""
    return whole_days_between(dob, at) / F.lit(365.0)


def clamp_negative(x: Column) -> Column:
    """Negative -> 0, null stays null (``greatest`` would turn null into 0)."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def fractional_days(a: Column | str, b: Column | str, clamp: bool = True) -> Column:
    """(b - a) in fractional days, optionally clamped at 0."""
    return days_of_micros(micros_between(a, b), clamp)


def days_of_micros(x: Column, clamp: bool = True) -> Column:
    """Microseconds (BIGINT) as fractional days: what ``fractional_days`` gives for two times that far apart."""
    x = x / F.lit(float(MICROS_PER_DAY))
    return clamp_negative(x) if clamp else x


def fractional_hours(a: Column | str, b: Column | str, clamp: bool = True) -> Column:
    """(b - a) in fractional hours, optionally clamped at 0."""
    x = micros_between(a, b) / F.lit(float(MICROS_PER_HOUR))
    return clamp_negative(x) if clamp else x


def shift_obscured_birthdate(c: Column | str, cutoff_year: int, years: int, days: int) -> Column:
    """Dates before ``cutoff_year`` move forward ``years`` years (a 29 February
    clips to 28 February) and then back ``days`` days."""
    c = _c(c)
    shifted = F.timestamp_add("DAY", F.lit(-days), F.timestamp_add("YEAR", F.lit(years), c))
    return F.when(F.year(c) < cutoff_year, shifted).otherwise(c)


def day_of(c: Column | str) -> Column:
    """Calendar day (DATE)."""
    return F.to_date(_c(c))


def midday(c: Column | str) -> Column:
    """Calendar day of ``c`` at 12:00 (TIMESTAMP_NTZ)."""
    return F.timestamp_add("HOUR", F.lit(12), F.to_date(_c(c)).cast("timestamp_ntz"))


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (timezone free)."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(c))

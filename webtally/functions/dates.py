"""Date parts taken from epoch microseconds by arithmetic, so they do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS


def floor_div(number: Column, size: int) -> Column:
    """Floor division of whole numbers (exact below 2**53, far beyond any event time in microseconds)."""
    return ((number - F.pmod(number, F.lit(size).cast("bigint"))) / F.lit(size)).cast("bigint")


def between_dates(column: str, start, end) -> Column:
    return F.col(column).between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))


def utc_date(micros: Column) -> Column:
    return F.date_from_unix_date(floor_div(micros, DAY_MICROS).cast("int"))


def utc_hour(micros: Column) -> Column:
    """Hour of day as two digits."""
    hour = floor_div(F.pmod(micros, F.lit(DAY_MICROS).cast("bigint")), HOUR_MICROS)
    return F.lpad(hour.cast("string"), 2, "0")


def local_second(micros: Column, zone: str) -> Column:
    """Wall-clock second in a zone, as seconds since 1970-01-01 00:00:00 of that wall clock."""
    return floor_div(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone)), 1_000_000)


def week_of_year(day: Column) -> Column:
    """Two-digit week number of weeks that start on Monday; days before the first Monday are in week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.lpad(week.cast("string"), 2, "0")


def weekday_label(day: Column) -> Column:
    """``0 - Sunday`` to ``6 - Saturday``."""
    return F.concat((F.dayofweek(day) - 1).cast("string"), F.lit(" - "), F.date_format(day, "EEEE"))


def week_start(day: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_sub(day, F.weekday(day))


def iso_week_label(day: Column) -> Column:
    """ISO year and two-digit ISO week, ``2024-01``."""
    year = F.extract(F.lit("YEAROFWEEK"), day)
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))

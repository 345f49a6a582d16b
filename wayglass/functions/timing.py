"""Dates, instants and buckets as column expressions. The clock is always a parameter (milliseconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Sao_Paulo"
OFFSET = "-03:00"


def instant(value: Column) -> Column:
    """Milliseconds of a timestamp that names its zone; null without a zone, as such a time is ambiguous."""
    zoned = value.rlike(r"(?i)(Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.unix_millis(F.when(zoned, F.try_to_timestamp(value))))


def valid_date(date: Column) -> Column:
    """Whether text is a day of the calendar, as yyyy-mm-dd."""
    shaped = date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.coalesce(shaped & F.when(shaped, F.try_to_date(date, "yyyy-MM-dd")).isNotNull(), F.lit(False))


def local_date(millis: Column) -> Column:
    """The local day of an instant (date), for a session in UTC."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(millis), ZONE))


def at_local(date: Column, time: Column) -> Column:
    """Milliseconds of a day and time (noon where the time is missing) at the fixed offset; null if there is no such day."""
    clock = F.when(F.coalesce(time, F.lit("")) == "", "12:00").otherwise(time)
    return F.unix_millis(F.try_to_timestamp(F.concat(date, F.lit("T"), clock, F.lit(":00" + OFFSET))))


def day_month_year(text: Column) -> Column:
    """The day (date) with which text begins, as dd/mm/yyyy."""
    return F.try_to_date(F.regexp_extract(text, r"^(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy")


def hour_bucket(hour: Column, width: int = 3) -> Column:
    """Number of the block of hours."""
    return F.floor(hour / width).cast("int")

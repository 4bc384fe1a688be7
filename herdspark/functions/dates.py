"""Date parsing and age functions as columns; *today* is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdspark.functions.text import first_text
from herdspark.functions.values import first_number, stripped


# The last millisecond and second that a four-digit year can show.
LAST_MILLISECOND = 253_402_300_799_999
LAST_SECOND = LAST_MILLISECOND // 1000


def parsed_time(text: Column) -> Column:
    """A plain date, an ISO timestamp or an epoch in milliseconds, all as text.

    An epoch beyond the years that can be shown is no time.
    """
    clean = stripped(text.cast("string"))
    plain = F.try_to_timestamp(F.regexp_extract(clean, r"^(\d{4}-\d{2}-\d{2})$", 1), F.lit("yyyy-MM-dd"))
    millis = F.regexp_extract(clean, r"^(-?\d{5,18})$", 1).try_cast("bigint")
    epoch = F.timestamp_millis(F.when(millis.between(-LAST_MILLISECOND, LAST_MILLISECOND), millis))
    iso = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(clean))
    return F.coalesce(plain, epoch, iso)


def seconds_time(seconds: Column) -> Column:
    """The seconds field of a stored timestamp record."""
    return F.timestamp_seconds(F.when(seconds.between(-LAST_SECOND, LAST_SECOND), seconds))


def parsed_date(text: Column) -> Column:
    return F.to_date(parsed_time(text))


def age_months(birth: Column, as_of: Column) -> Column:
    """Whole months between two dates, never below zero."""
    months = (F.year(as_of) - F.year(birth)) * 12 + (F.month(as_of) - F.month(birth))
    short = F.when(F.dayofmonth(as_of) < F.dayofmonth(birth), 1).otherwise(0)
    return F.when(birth.isNotNull() & as_of.isNotNull(), F.greatest(F.lit(0), months - short))


def _half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def resolved_age_months(
    as_of: Column,
    birth_texts: Sequence[Column],
    month_values: Sequence[Column],
    year_values: Sequence[Column],
    free_age: Column,
) -> Column:
    """Birth date, then months, then years, then free text naming a unit."""
    from_birth = age_months(parsed_date(first_text(birth_texts)), as_of).cast("bigint")
    free = first_number([free_age])
    in_years = F.lower(free_age.cast("string")).contains("year")
    return F.coalesce(
        from_birth,
        _half_up(first_number(month_values)),
        _half_up(first_number(year_values) * 12),
        F.when(in_years, _half_up(free * 12)).otherwise(_half_up(free)),
    )

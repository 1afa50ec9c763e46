"""Event times, elapsed seconds, and durations written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per unit, calendar months per unit, number words.
SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800}
MONTHS = {"month": 1, "year": 12}
WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
DAYS_OF_FIRST_MONTH = 31


def with_event_time(df: DataFrame, seconds: str = "TIMESTAMP", ts: str = "TS") -> DataFrame:
    """Adds the event time for a column of epoch seconds."""
    return df.withColumn(ts, F.timestamp_seconds(seconds))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, fractions cut off."""
    return F.timestamp_diff("SECOND", start, end)


def duration_seconds(text: Column) -> Column:
    """Seconds in a duration such as ``1 day``, ``two weeks`` or ``0.5 days``.

    Months and years are counted on the calendar from the first day of year 1,
    so one month is 31 days and one year 365. Parts add up; null if none fits.
    """
    units = "|".join([*SECONDS, *MONTHS])
    part = rf"(\d+(?:\.\d+)?|\b(?:{'|'.join(WORDS)}))\s*({units})s?\b"
    clean = F.lower(text)
    amounts = F.regexp_extract_all(clean, F.lit(part), F.lit(1))
    names = F.regexp_extract_all(clean, F.lit(part), F.lit(2))
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    seconds = F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair])
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def value(amount: Column, unit: Column) -> Column:
        number = F.coalesce(F.try_element_at(words, amount).cast("double"), amount.try_cast("double"))
        calendar = number * F.try_element_at(months, unit)
        return F.coalesce(number * F.try_element_at(seconds, unit), _calendar_seconds(calendar))

    total = F.aggregate(F.zip_with(amounts, names, value), F.lit(0.0), lambda sofar, x: sofar + x)
    return F.when(F.size(amounts) > 0, F.floor(total).cast("long"))


def _calendar_seconds(months: Column) -> Column:
    start = F.lit("0001-01-01").cast("date")
    whole = F.floor(months)
    days = F.date_diff(F.add_months(start, whole.cast("int")), start) + (months - whole) * DAYS_OF_FIRST_MONTH
    return days * SECONDS["day"]

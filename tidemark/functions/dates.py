"""Dates. Nothing here depends on the session time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bind

# Layouts of a day, tried in this order. A day comes first only where the month-first layout can't be.
FEED_FORMATS = (
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyyMMdd",
    "M/d/yyyy",
    "M-d-yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "MMMM d yyyy",
    "MMM d yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
)

# A weekday in front, the dot of a shortened month, and a time with or without an offset behind.
WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
MONTH_DOT = r"(?i)\b(jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\."
TIME_BEHIND = r"(?i)(?:,?\s+(?:at\s+)?|T)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\.?)?(?:\s*(?:Z|[A-Z]{2,5}|(?:GMT|UTC)?[+-]\d{2}:?\d{2}))?$"

OFFSET_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})$"


def epoch_date(seconds: Column) -> Column:
    """UTC calendar day of an epoch in seconds."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def epoch_day_text(seconds: Column) -> Column:
    return F.date_format(epoch_date(seconds), "yyyy-MM-dd")


def day_epoch(day: Column) -> Column:
    """Epoch seconds of midnight UTC."""
    return F.unix_date(day).cast("long") * 86400


def stamp_epoch(stamp: Column) -> Column:
    """Epoch seconds, rounded down, of a timestamp without zone that is meant in UTC."""
    return F.unix_date(F.to_date(stamp)).cast("long") * 86400 + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)


def offset_day(stamp: Column) -> Column:
    """Day of an ISO stamp in the offset it carries; '' for a missing one, NULL for a malformed one."""
    return F.when(F.coalesce(stamp, F.lit("")) == "", F.lit("")).when(
        stamp.rlike(OFFSET_STAMP) & F.try_to_date(F.substring(stamp, 1, 10)).isNotNull(),
        F.substring(stamp, 1, 10),
    )


def lenient_day(text: Column, formats: Sequence[str] = FEED_FORMATS) -> Column:
    """The day as it is written, by the first layout that fits, else NULL.

    A weekday in front and a time or offset behind are cut off first, so that an offset never moves the day.
    """
    day = F.regexp_replace(F.regexp_replace(F.trim(text), WEEKDAY, ""), TIME_BEHIND, "")
    day = F.regexp_replace(F.regexp_replace(day, r"(?i)\bsept\.? ", "Sep "), MONTH_DOT, "$1")
    return bind(day, lambda d: F.coalesce(*(F.try_to_date(d, fmt) for fmt in formats)))


def strict_day(text: Column) -> Column:
    """``yyyy-MM-dd`` or an error."""
    return F.to_date(text, "yyyy-MM-dd")

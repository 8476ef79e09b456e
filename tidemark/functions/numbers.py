"""Arithmetic that neither raises nor invents values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(total: Column, count: Column) -> Column:
    """Quotient, NULL where the divisor is 0."""
    return F.try_divide(total, count)


def half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest integer with ties to even, scale back, as numeric libraries do.

    ``bround`` works on the decimal digits instead and differs there, as on 0.575.
    """
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def to_number(text: Column) -> Column:
    """Double or NULL."""
    return text.try_cast("double")


def polarity(label: Column) -> Column:
    """Positive 1, Negative -1, anything else 0."""
    return F.when(label == "Positive", 1).when(label == "Negative", -1).otherwise(0)

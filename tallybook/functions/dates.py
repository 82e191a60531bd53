"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short day names, Monday first.
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def month_start(timestamp: str = "invoice_date") -> Column:
    """First day of the month, as DATE."""
    return F.trunc(F.col(timestamp), "month")


def iso_weekday(timestamp: str = "invoice_date") -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(F.col(timestamp)) + 1


def day_short_name(iso_day: str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col(iso_day).cast("int"))


def month_index(column: str) -> Column:
    """Months since January of the year 0."""
    return F.year(column) * 12 + F.month(column) - 1

"""Aggregates used all over."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.money import money_sum


def rows(name: str) -> Column:
    """Number of rows of the group."""
    return F.count(F.lit(1)).alias(name)


def revenue(amount: str = "order_total") -> Column:
    return money_sum(amount).alias("revenue")

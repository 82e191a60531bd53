"""Money as column expressions.

Lines are summed as whole cents in BIGINT: a long add stays in generated code,
while a sum of wide decimals allocates an object per line. Results are decimals
again, so nothing is ever rounded through a floating point number.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def line_cents(quantity: str = "quantity", unit_price: str = "unit_price") -> Column:
    """quantity * unit_price of one line, in cents.

    A DECIMAL(10,2) has ten digits and a double holds fifteen, so the nearest whole
    cent is the exact one; multiplying decimals costs several times as much.
    """
    cents = F.rint(F.col(unit_price).cast("double") * 100).cast("bigint")
    return F.col(quantity).cast("bigint") * cents


def cents_to_money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def money_sum(amount: str | Column) -> Column:
    """Sum of a MONEY column, as MONEY."""
    return F.sum(amount).cast(MONEY)


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole rounded half away from zero; null when whole is zero.

    The operand types leave 16 digits after the point for the quotient, so the
    rounding to ``digits`` is the only one that matters.
    """
    return F.round(part.cast("decimal(22,2)") / F.nullif(whole.cast(MONEY), F.lit(0).cast(MONEY)), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return ratio(part.cast(MONEY) * 100, whole, digits)


def percent_unrounded(part: Column, whole: Column) -> Column:
    """100 * part / whole in floating point; null when whole is zero."""
    return 100 * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))

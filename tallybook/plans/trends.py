"""Sales over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.aggregates import revenue, rows
from tallybook.functions.dates import iso_weekday
from tallybook.functions.money import percent
from tallybook.model import RetailTables
from tallybook.plans.views import monthly_revenue, order_totals, sales_invoices


def revenue_by_month(tables: RetailTables) -> DataFrame:
    return monthly_revenue(tables).orderBy("month")


def revenue_by_weekday(tables: RetailTables, padded: bool = False) -> DataFrame:
    """Monday first. ``padded`` fills the day name up to nine characters."""
    day = F.date_format("invoice_date", "EEEE")
    return (
        order_totals(tables)
        .groupBy((F.rpad(day, 9, " ") if padded else day).alias("day_name"), iso_weekday().alias("dow"))
        .agg(rows("orders"), revenue())
        .orderBy("dow")
    )


def hourly_revenue(tables: RetailTables) -> DataFrame:
    return order_totals(tables).groupBy(F.hour("invoice_date").alias("hour")).agg(rows("orders"), revenue())


def revenue_by_hour(tables: RetailTables) -> DataFrame:
    return hourly_revenue(tables).orderBy("hour")


def weekday_hour_orders(tables: RetailTables) -> DataFrame:
    """Counts invoices only, so an invoice without lines is an order too."""
    return (
        sales_invoices(tables)
        .groupBy(iso_weekday().alias("dow"), F.hour("invoice_date").alias("hour"))
        .agg(rows("orders"))
        .orderBy("dow", "hour")
    )


def previous_month(column: str) -> Column:
    """Value of the previous month that has sales. The window holds one row per month."""
    return F.lag(column).over(Window.orderBy("month"))


def month_over_month(tables: RetailTables) -> DataFrame:
    months = monthly_revenue(tables).select("month", "revenue", previous_month("revenue").alias("prev_month"))
    growth = percent(F.col("revenue") - F.col("prev_month"), F.col("prev_month"))
    return months.withColumn("mom_growth_pct", growth).orderBy("month")

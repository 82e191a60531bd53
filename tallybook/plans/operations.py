"""Order values, cancellations, basket sizes, busy hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.aggregates import revenue, rows
from tallybook.functions.dates import month_start
from tallybook.functions.money import MONEY, money_sum, percent, ratio
from tallybook.model import RetailTables
from tallybook.operators.ranking import percentile_of_counts, sorted_counts
from tallybook.plans.trends import hourly_revenue
from tallybook.plans.views import order_totals, sales_invoices


def order_value_stats(tables: RetailTables, exact: bool = True) -> DataFrame:
    """Average and median order value.

    Both come from the written counts of distinct order values, so the lines are
    read once. ``exact=False`` takes Spark's approximate percentile, which does not
    interpolate, and saves the sort. Runs jobs while the frame is built.
    """
    orders = order_totals(tables).select("order_total")
    if exact:
        counts = sorted_counts(orders, "order_total")
        totals = counts.agg(money_sum(F.col("order_total") * F.col("n")).alias("revenue"), F.sum("n").alias("orders"))
        middle = percentile_of_counts(counts, "order_total", 0.5, "median")
        totals = totals.withColumn("median", middle.scalar())
    else:
        totals = orders.agg(revenue(), rows("orders"), F.percentile_approx("order_total", 0.5).alias("median"))
    return totals.select(
        ratio(F.col("revenue"), F.col("orders"), 2).alias("avg_order_value"),
        F.round("median", 2).cast(MONEY).alias("median_order_value"),
    )


def monthly_cancellations(tables: RetailTables) -> DataFrame:
    """All invoices count, those without lines too."""
    return tables.invoices.groupBy(month_start().alias("month")).agg(
        F.count_if(~F.col("is_cancellation")).alias("orders"),
        F.count_if(F.col("is_cancellation")).alias("cancellations"),
    )


def cancellation_rate(tables: RetailTables) -> DataFrame:
    rate = percent(F.col("cancellations"), F.col("orders") + F.col("cancellations"))
    return monthly_cancellations(tables).withColumn("cancellation_rate_pct", rate).orderBy("month")


def basket_size_distribution(tables: RetailTables) -> DataFrame:
    """Number of lines per order, and how many orders have that many."""
    per_invoice = tables.invoice_items.groupBy("invoice_no").agg(rows("items_per_order"))
    return (
        per_invoice.join(sales_invoices(tables).select("invoice_no"), "invoice_no", "left_semi")
        .groupBy("items_per_order")
        .agg(rows("orders"))
        .orderBy("items_per_order")
    )


def peak_hours(tables: RetailTables, n: int = 5) -> DataFrame:
    return hourly_revenue(tables).orderBy(F.desc("revenue"), "hour").limit(n)

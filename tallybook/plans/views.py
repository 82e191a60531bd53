"""The five shared views: order totals, months, countries, products, customers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.aggregates import revenue, rows
from tallybook.functions.dates import month_start
from tallybook.functions.money import cents_to_money, line_cents, money_sum
from tallybook.model import RetailTables
from tallybook.operators.scratch import materialize


def sales_invoices(tables: RetailTables) -> DataFrame:
    """Invoices that are not cancellations."""
    return tables.invoices.filter(~F.col("is_cancellation"))


def lines_of(invoices: DataFrame, tables: RetailTables, *invoice_columns: str) -> DataFrame:
    """Lines of the given invoices.

    The results are grouped by another key next, so adaptive execution is free to
    split an invoice that holds a large part of all lines.
    """
    return tables.invoice_items.join(invoices.select("invoice_no", *invoice_columns), "invoice_no")


def order_totals(tables: RetailTables) -> DataFrame:
    """One row per invoice that is not a cancellation and has at least one line.

    Lines are summed per invoice before the join: a huge invoice shrinks to one
    row on the map side, and the join moves one row per invoice, not per line.
    """
    if tables.totals is not None:
        return tables.totals
    per_invoice = tables.invoice_items.groupBy("invoice_no").agg(
        F.sum(line_cents()).alias("_cents"), F.sum("quantity").alias("units")
    )
    return (
        sales_invoices(tables)
        .join(per_invoice, "invoice_no")
        .select(
            "invoice_no",
            "invoice_date",
            "customer_id",
            "country_id",
            cents_to_money(F.col("_cents")).alias("order_total"),
            "units",
        )
    )


def monthly_revenue(tables: RetailTables) -> DataFrame:
    return order_totals(tables).groupBy(month_start().alias("month")).agg(rows("orders"), revenue())


def revenue_per_country_id(tables: RetailTables) -> DataFrame:
    """Orders, customers and revenue per invoice country.

    Grouping by (country, customer) first turns the distinct count into a plain
    one and spreads a country that has most of the orders over all tasks.
    """
    per_customer = order_totals(tables).groupBy("country_id", "customer_id").agg(rows("orders"), revenue())
    return per_customer.groupBy("country_id").agg(
        F.sum("orders").alias("orders"),
        F.count("customer_id").alias("customers"),
        revenue("revenue"),
    )


def country_revenue(tables: RetailTables) -> DataFrame:
    """Names join one row per country, after the aggregation."""
    return (
        revenue_per_country_id(tables)
        .join(tables.countries, "country_id")
        .select(F.col("name").alias("country"), "orders", "customers", "revenue")
    )


def sales_per_product(tables: RetailTables) -> DataFrame:
    if tables.product_sales is not None:
        return tables.product_sales
    return (
        lines_of(sales_invoices(tables), tables)
        .groupBy("stock_code")
        .agg(F.sum("quantity").alias("units_sold"), cents_to_money(F.sum(line_cents())).alias("revenue"))
    )


def with_description(df: DataFrame, tables: RetailTables, *columns: str | Column) -> DataFrame:
    return df.join(tables.products, "stock_code").select("stock_code", "description", *columns)


def product_performance(tables: RetailTables) -> DataFrame:
    return with_description(sales_per_product(tables), tables, "units_sold", "revenue")


def customer_rfm(tables: RetailTables) -> DataFrame:
    """Recency, frequency and spend of every named customer.

    The reference day is that of the last invoice of all, cancellations included.
    """
    last_day = tables.invoices.agg(F.to_date(F.max("invoice_date"))).scalar()
    return (
        order_totals(tables)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.max("invoice_date").alias("_last"), rows("frequency"), money_sum("order_total").alias("monetary"))
        .select(
            "customer_id",
            F.date_diff(last_day, F.to_date("_last")).alias("recency_days"),
            "frequency",
            "monetary",
        )
    )


def with_shared_views(tables: RetailTables) -> RetailTables:
    """Compute the two views that go over all lines once, for several reports to share."""
    return replace(
        tables,
        totals=materialize(order_totals(tables), "order-totals"),
        product_sales=materialize(sales_per_product(tables), "product-sales"),
    )


VIEWS = {
    "v_order_totals": order_totals,
    "v_monthly_revenue": monthly_revenue,
    "v_country_revenue": country_revenue,
    "v_product_performance": product_performance,
    "v_customer_rfm": customer_rfm,
}


def register_views(tables: RetailTables) -> list[str]:
    """Make the tables and the five views known to SQL text under their names."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    for name, view in VIEWS.items():
        view(tables).createOrReplaceTempView(name)
    return [*(name for name, _ in tables.items()), *VIEWS]


def run_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """Run SQL text; parameters are written :name and passed by name."""
    return spark.sql(sql, args=params or {})

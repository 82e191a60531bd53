"""Frames behind the five report pages. Drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.aggregates import revenue, rows
from tallybook.functions.dates import day_short_name
from tallybook.functions.money import money_sum, percent_unrounded
from tallybook.model import HOME_COUNTRY, RetailTables
from tallybook.plans.customers import rfm_labelled
from tallybook.plans.markets import revenue_by_country
from tallybook.plans.operations import monthly_cancellations
from tallybook.plans.products import listed_products, top_products_revenue
from tallybook.plans.trends import previous_month, revenue_by_month, weekday_hour_orders
from tallybook.plans.views import (
    country_revenue,
    customer_rfm,
    monthly_revenue,
    order_totals,
    sales_per_product,
    with_description,
)

# -- overview


def overview_kpis(tables: RetailTables) -> DataFrame:
    """Revenue, orders, customers and average order value.

    Orders are summed per customer first, so no task sees all customer ids.
    """
    per_customer = order_totals(tables).groupBy("customer_id").agg(revenue(), rows("orders"))
    totals = per_customer.agg(
        money_sum("revenue").alias("revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.count("customer_id").alias("customers"),
    )
    aov = F.col("revenue").cast("double") / F.nullif(F.col("orders"), F.lit(0).cast("bigint"))
    return totals.withColumn("aov", aov)


def overview_monthly(tables: RetailTables) -> DataFrame:
    return revenue_by_month(tables)


def overview_top_countries(tables: RetailTables, n: int = 5) -> DataFrame:
    return country_revenue(tables).select("country", "revenue").orderBy(F.desc("revenue"), "country").limit(n)


# -- customers; ``labelled`` lets several frames of one page share one RFM run


def rfm_kpis(tables: RetailTables, labelled: DataFrame | None = None) -> DataFrame:
    """Averages over customers; no scores are needed for them."""
    customers = F.count(F.lit(1)).cast("double")
    return (labelled or customer_rfm(tables)).agg(
        rows("customers"),
        (F.sum("recency_days") / customers).alias("avg_recency_days"),
        (F.sum("monetary").cast("double") / customers).alias("avg_spend"),
    )


def rfm_segment_summary(tables: RetailTables, labelled: DataFrame | None = None) -> DataFrame:
    """Customers and revenue per segment, the revenue rounded half to even."""
    return (
        (labelled or rfm_labelled(tables))
        .groupBy("segment")
        .agg(F.count("customer_id").alias("customers"), revenue("monetary").alias("_exact"))
        .orderBy(F.desc("_exact"), "segment")
        .select("segment", "customers", F.bround("_exact", 0).alias("revenue"))
    )


def rfm_scatter_points(tables: RetailTables, labelled: DataFrame | None = None) -> DataFrame:
    return (labelled or rfm_labelled(tables)).select("recency_days", "monetary", "frequency", "segment", "customer_id")


def rfm_top_customers(tables: RetailTables, n: int = 10, labelled: DataFrame | None = None) -> DataFrame:
    return (
        (labelled or rfm_labelled(tables))
        .orderBy(F.desc("monetary"), "customer_id")
        .limit(n)
        .select("customer_id", "frequency", "recency_days", "monetary", "segment")
    )


# -- products


def products_top(tables: RetailTables, n: int = 20) -> DataFrame:
    return top_products_revenue(tables, n)


def products_kpis(tables: RetailTables) -> DataFrame:
    """How many products sold, and the revenue of the best one."""
    sold = listed_products(sales_per_product(tables), tables)
    return sold.agg(rows("products_sold"), F.max("revenue").alias("top_product_revenue"))


def products_slow(tables: RetailTables, lo: int = 0, hi: int = 10, n: int = 25) -> DataFrame:
    """Products with more than lo and fewer than hi units; unlike slow_movers, returns
    that outweigh sales do not show."""
    units = F.col("units_sold")
    order = ["units_sold", "stock_code"]
    sold = sales_per_product(tables).filter((units > lo) & (units < hi))
    slow = listed_products(sold, tables).orderBy(*order).limit(n)
    return with_description(slow, tables, "units_sold", "revenue").orderBy(*order)


# -- geography


def geo_table(tables: RetailTables) -> DataFrame:
    return revenue_by_country(tables)


def geo_kpis(tables: RetailTables, home: str = HOME_COUNTRY) -> DataFrame:
    """Number of countries, share of the home market, revenue elsewhere."""
    at_home = F.col("country") == home
    none = F.lit(0).cast("decimal(20,2)")
    totals = country_revenue(tables).agg(
        rows("countries"),
        F.coalesce(money_sum("revenue"), none).alias("_all"),
        F.coalesce(F.sum(F.when(at_home, F.col("revenue"))).cast("decimal(20,2)"), none).alias("_home"),
    )
    return totals.select(
        "countries",
        percent_unrounded(F.col("_home"), F.col("_all")).alias("home_share_pct"),
        (F.col("_all") - F.col("_home")).alias("foreign_revenue"),
    )


def geo_top_foreign(tables: RetailTables, home: str = HOME_COUNTRY, n: int = 15) -> DataFrame:
    return (
        country_revenue(tables).filter(F.col("country") != home).orderBy(F.desc("revenue"), "country").limit(n)
    )


# -- trends


def trend_mom(tables: RetailTables) -> DataFrame:
    """Monthly growth, unrounded; the first month has none and is left out."""
    months = monthly_revenue(tables).select("month", "revenue", previous_month("revenue").alias("prev_month"))
    change = F.col("revenue").cast("double") - F.col("prev_month").cast("double")
    return (
        months.withColumn("mom_growth_pct", percent_unrounded(change, F.col("prev_month")))
        .filter(F.col("prev_month").isNotNull())
        .orderBy("month")
    )


def weekday_hour_matrix(tables: RetailTables) -> DataFrame:
    """Seven rows Mon…Sun, one column per hour h0…h23; a cell without orders is null.

    The fixed list of hours spares a job that looks for the hours seen.
    """
    hours = list(range(24))
    cells = weekday_hour_orders(tables).groupBy("dow").pivot("hour", hours).agg(F.first("orders"))
    cells = cells.select("dow", *[F.col(str(h)).alias(f"h{h}") for h in hours])
    week = tables.invoices.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("dow"))
    return (
        week.join(cells, "dow", "left")
        .orderBy("dow")
        .select(day_short_name("dow").alias("day"), *[f"h{h}" for h in hours])
    )


def trend_cancellation(tables: RetailTables) -> DataFrame:
    rate = percent_unrounded(F.col("cancellations"), F.col("orders") + F.col("cancellations"))
    return (
        monthly_cancellations(tables)
        .select("month", "cancellations", "orders", rate.alias("rate_pct"))
        .orderBy("month")
    )

"""Sales by country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import money_sum, percent, ratio
from tallybook.model import HOME_COUNTRY, RetailTables
from tallybook.plans.views import country_revenue


def revenue_by_country(tables: RetailTables) -> DataFrame:
    return country_revenue(tables).orderBy(F.desc("revenue"), "country")


def top_foreign_markets(tables: RetailTables, home: str = HOME_COUNTRY, n: int = 15) -> DataFrame:
    return (
        country_revenue(tables)
        .filter(F.col("country") != home)
        .select("country", "customers", "revenue")
        .orderBy(F.desc("revenue"), "country")
        .limit(n)
    )


def aov_by_country(tables: RetailTables, min_orders: int = 20, n: int = 15) -> DataFrame:
    """Average order value of the countries with the most orders."""
    average = ratio(F.col("revenue"), F.col("orders"), 2).alias("avg_order_value")
    return (
        country_revenue(tables)
        .filter(F.col("orders") >= min_orders)
        .select("country", "orders", average)
        .orderBy(F.desc("orders"), "country")
        .limit(n)
    )


def country_share(tables: RetailTables) -> DataFrame:
    countries = country_revenue(tables)
    total = countries.agg(money_sum("revenue")).scalar()
    return countries.select("country", "revenue", percent(F.col("revenue"), total).alias("share_pct")).orderBy(
        F.desc("revenue"), "country"
    )

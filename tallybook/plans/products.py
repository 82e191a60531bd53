"""Product analyses: best sellers, slow movers, returns, products bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.aggregates import rows
from tallybook.functions.money import percent
from tallybook.model import RetailTables
from tallybook.operators.pairs import top_pairs
from tallybook.plans.views import lines_of, sales_invoices, sales_per_product, with_description


def listed_products(df: DataFrame, tables: RetailTables) -> DataFrame:
    """Rows per product whose code is in the product table."""
    return df.join(tables.products.select("stock_code"), "stock_code", "left_semi")


def _top(df: DataFrame, by: str, n: int, tables: RetailTables, *columns: str) -> DataFrame:
    """The n best codes; only these fetch their descriptions."""
    best = listed_products(df, tables).orderBy(F.desc(by), "stock_code").limit(n)
    return with_description(best, tables, *columns).orderBy(F.desc(by), "stock_code")


def top_products_revenue(tables: RetailTables, n: int = 20) -> DataFrame:
    return _top(sales_per_product(tables), "revenue", n, tables, "units_sold", "revenue")


def top_products_units(tables: RetailTables, n: int = 20) -> DataFrame:
    return _top(sales_per_product(tables), "units_sold", n, tables, "units_sold")


def slow_movers(tables: RetailTables, max_units: int = 10, n: int = 30) -> DataFrame:
    """Products that sold fewer than max_units, with the number of invoices they are on.

    Counting per (code, invoice) first makes the distinct count a plain one.
    """
    per_invoice = tables.invoice_items.groupBy("invoice_no", "stock_code").agg(F.sum("quantity").alias("_units"))
    slow = (
        per_invoice.join(sales_invoices(tables).select("invoice_no"), "invoice_no", "left_semi")
        .groupBy("stock_code")
        .agg(F.sum("_units").alias("units_sold"), rows("appearances"))
        .filter(F.col("units_sold") < max_units)
    )
    slow = listed_products(slow, tables).orderBy("units_sold", "stock_code").limit(n)
    return with_description(slow, tables, "units_sold", "appearances").orderBy("units_sold", "stock_code")


def return_rate(tables: RetailTables, min_sold: int = 50, n: int = 20) -> DataFrame:
    """Returned units per hundred sold, for products that sold at least min_sold.

    Sold and returned units come from one pass over the lines.
    """
    quantity, cancelled = F.col("quantity"), F.col("is_cancellation")
    units = (
        lines_of(tables.invoices, tables, "is_cancellation")
        .groupBy("stock_code")
        .agg(
            F.sum(F.when(~cancelled, quantity)).alias("sold"),
            F.coalesce(F.sum(F.when(cancelled, F.abs(quantity))), F.lit(0)).alias("returned"),
        )
        .filter(F.col("sold") >= min_sold)
    )
    rate = percent(F.col("returned"), F.col("sold")).alias("return_rate_pct")
    order = [F.desc_nulls_last("return_rate_pct"), F.col("stock_code")]
    rates = listed_products(units, tables).select("stock_code", "sold", "returned", rate)
    worst = rates.orderBy(*order).limit(n)
    return with_description(worst, tables, "sold", "returned", "return_rate_pct").orderBy(*order)


def basket_lines(tables: RetailTables) -> DataFrame:
    """(basket, item, n) over sales: how many lines of the invoice name the product.

    Lines are folded per (invoice, product) before the join, so a huge invoice
    brings one row per distinct product into it.
    """
    folded = tables.invoice_items.groupBy("invoice_no", "stock_code").agg(rows("n"))
    kept = folded.join(sales_invoices(tables).select("invoice_no"), "invoice_no", "left_semi")
    return kept.select(F.col("invoice_no").alias("basket"), F.col("stock_code").alias("item"), "n")


def bought_together(tables: RetailTables, n: int = 25) -> DataFrame:
    """Product pairs that share the most invoices, counted in pairs of lines. Runs jobs
    while the frame is built."""
    pairs = top_pairs(basket_lines(tables), n)
    first = tables.products.select(F.col("stock_code").alias("a"), F.col("description").alias("desc_a"))
    second = tables.products.select(F.col("stock_code").alias("b"), F.col("description").alias("desc_b"))
    return (
        pairs.join(first, "a")
        .join(second, "b")
        .select(F.col("a").alias("product_a"), F.col("b").alias("product_b"), "desc_a", "desc_b", "pair_count")
        .orderBy(F.desc("pair_count"), "product_a", "product_b")
    )

"""From cleaned lines to the five tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.model import SOURCE_ORDER, TABLE_SCHEMAS, RetailTables
from tallybook.operators.ranking import global_row_number, numbered_by

DESCRIPTION_LENGTH = 255


def most_frequent(lines: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the most frequent value; the smallest one on a tie.

    Counting (key, value) first leaves one row per distinct value, so a key with
    very many lines, or very many values, never meets in one task as raw lines.
    """
    counts = lines.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_order"), F.col(value)))
    return counts.groupBy(key).agg(best[value].alias(value))


def build_countries(clean: DataFrame) -> DataFrame:
    """Distinct names numbered 1..n in code-point order."""
    names = clean.select(F.col("Country").alias("name")).distinct()
    numbered = global_row_number(names, [F.col("name")], "country_id")
    return numbered.select(F.col("country_id").cast("int").alias("country_id"), "name")


def lookup_country(df: DataFrame, countries: DataFrame, column: str = "Country") -> DataFrame:
    """Replace a country name by its id. Spark broadcasts the names while they are few."""
    return df.join(countries, F.col(column) == F.col("name")).drop(column, "name")


def build_customers(clean: DataFrame, countries: DataFrame) -> DataFrame:
    """Named customers with the country on most of their lines."""
    named = clean.filter(F.col("CustomerID").isNotNull())
    main = most_frequent(named, "CustomerID", "Country")
    return lookup_country(main, countries).select(F.col("CustomerID").alias("customer_id"), "country_id")


def build_products(clean: DataFrame) -> DataFrame:
    """Stock codes with their most common description, cut to 255 characters."""
    usual = most_frequent(clean, "StockCode", "Description")
    return usual.select(
        F.col("StockCode").alias("stock_code"),
        F.substring("Description", 1, DESCRIPTION_LENGTH).alias("description"),
    )


def build_invoices(clean: DataFrame, countries: DataFrame) -> DataFrame:
    """Per invoice the earliest time, and the first customer and country in source order.

    The country is an id before the aggregation, so all buffers are plain numbers
    and Spark hashes instead of sorting.
    """
    order = F.col(SOURCE_ORDER)
    lines = lookup_country(clean.select("InvoiceNo", "InvoiceDate", "CustomerID", "Country", SOURCE_ORDER), countries)
    return (
        lines.groupBy("InvoiceNo")
        .agg(
            F.min("InvoiceDate").alias("invoice_date"),
            F.min_by("CustomerID", F.when(F.col("CustomerID").isNotNull(), order)).alias("customer_id"),
            F.min_by("country_id", order).alias("country_id"),
        )
        .select(
            F.col("InvoiceNo").alias("invoice_no"),
            "invoice_date",
            "customer_id",
            "country_id",
            F.startswith(F.col("InvoiceNo"), F.lit("C")).alias("is_cancellation"),
        )
    )


def build_items(clean: DataFrame, contiguous_ids: bool = False) -> DataFrame:
    """One item per cleaned line, the price rounded to cents.

    The source-order number already is a unique id that grows with insertion, with
    gaps; ``contiguous_ids`` closes the gaps. Runs jobs then.
    """
    order = F.col(SOURCE_ORDER)
    lines = clean.select(
        F.col("InvoiceNo").alias("invoice_no"),
        F.col("StockCode").alias("stock_code"),
        F.col("Quantity").alias("quantity"),
        F.col("UnitPrice").cast("decimal(10,2)").alias("unit_price"),
        order,
    )
    if contiguous_ids:
        numbered = numbered_by(lines, SOURCE_ORDER, "item_id")
    else:
        numbered = lines.withColumn("item_id", order + 1)
    return numbered.select(*TABLE_SCHEMAS["invoice_items"].fieldNames())


def normalize(clean: DataFrame, contiguous_ids: bool = False, countries: DataFrame | None = None) -> RetailTables:
    """All five tables. ``clean`` is read five times: pass a written table.

    Pass ``countries`` when they are written already, so the ids are read back.
    """
    if countries is None:
        countries = build_countries(clean)
    return RetailTables(
        countries=countries,
        customers=build_customers(clean, countries),
        products=build_products(clean),
        invoices=build_invoices(clean, countries),
        invoice_items=build_items(clean, contiguous_ids),
    )

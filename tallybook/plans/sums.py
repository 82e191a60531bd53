"""Sums of lines, kept with each load, so that views do not read the lines again.

A load writes what its own lines add up to: cents and units per invoice, and per
product over the invoices that are no cancellations. Sums of several loads merge by
adding, also where a later load brings more lines of a known invoice. Whether an
invoice is a cancellation is looked up when its lines are loaded: among the load's own
invoices, or in the tables before it for the few that are known already. Lines whose
invoice is not there (yet) are kept as they are, summed per invoice and product, and
are looked up when the sums are read.

``with_sums`` gives the tables with order totals and sales per product made from the
sums. All views and analyses take these where they are given, so after a load of one
in a hundred lines only that one is read.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.money import cents_to_money, line_cents
from tallybook.model import RetailTables
from tallybook.operators.scratch import COMPRESSION, materialize
from tallybook.plans.views import sales_invoices
from tallybook.sources.log import State, read_state
from tallybook.sources.tables import load_path, read_load, read_tables, table_scan

_NO, _CODE = (T.StructField(n, T.StringType()) for n in ("invoice_no", "stock_code"))
_SUMS = [T.StructField(n, T.LongType()) for n in ("cents", "units")]
#: What a load writes besides its tables.
SUM_TABLES = {
    "invoice_sums": T.StructType([_NO, *_SUMS]),
    "product_sums": T.StructType([_CODE, *_SUMS]),
    "open_sums": T.StructType([_NO, _CODE, *_SUMS]),
}


def _added() -> list[Column]:
    return [F.sum("cents").alias("cents"), F.sum("units").alias("units")]


def _status(own: RetailTables, numbers: DataFrame, known: DataFrame | None) -> DataFrame:
    """(invoice_no, is_cancellation) of the numbers that are invoices; a load's own rows are new ones."""
    columns = ["invoice_no", "is_cancellation"]
    if known is None:
        return own.invoices.select(columns)
    others = numbers.join(own.invoices.select("invoice_no"), "invoice_no", "left_anti")
    return own.invoices.select(columns).union(known.select(columns).join(others, "invoice_no", "left_semi"))


def write_sums(spark: SparkSession, folder: str, load_id: str, seen: State | None) -> None:
    """Write the sums of a written load that is to count on top of ``seen`` (None: by itself)."""

    def write(name: str, sums: DataFrame) -> None:
        writer = sums.select(SUM_TABLES[name].fieldNames()).write.mode("overwrite").option("compression", COMPRESSION)
        writer.parquet(load_path(folder, name, load_id))

    own = read_load(spark, folder, load_id)
    lines = own.invoice_items.select("invoice_no", "stock_code", line_cents().alias("cents"), F.col("quantity").alias("units"))
    write("invoice_sums", lines.groupBy("invoice_no").agg(*_added()))
    numbers = _stored(spark, folder, "invoice_sums", load_id).select("invoice_no")
    known = table_scan(spark, folder, "invoices", state=seen) if seen is not None and seen.live else None
    # Lines meet their invoice as they are and are added up by product next, which leaves adaptive execution
    # free to split a huge invoice. Both tables come from one pass.
    told, is_open = lines.join(_status(own, numbers, known), "invoice_no", "left"), F.col("is_cancellation").isNull()
    kept = told.filter(is_open | ~F.col("is_cancellation"))
    number = F.when(is_open, F.col("invoice_no")).alias("invoice_no")
    both = materialize(kept.groupBy(is_open.alias("_open"), number, "stock_code").agg(*_added()), "sums")
    write("product_sums", both.filter(~F.col("_open")))
    write("open_sums", both.filter("_open"))


def _stored(spark: SparkSession, folder: str, name: str, load_id: str) -> DataFrame:
    return spark.read.schema(SUM_TABLES[name]).parquet(load_path(folder, name, load_id))


def with_sums(spark: SparkSession, folder: str, state: State | None = None) -> RetailTables:
    """The tables of a folder of loads, with totals and sales per product from the sums of the loads.

    Every load of the folder must have written its sums, as load_sales and append_sales do.
    """
    state = state or read_state(spark, folder)
    tables = read_tables(spark, folder, state)
    merged = {name: table_scan(spark, folder, name, schema, state) for name, schema in SUM_TABLES.items()}
    per_invoice = merged["invoice_sums"].groupBy("invoice_no").agg(*_added())
    sales = sales_invoices(tables)
    totals = sales.join(per_invoice, "invoice_no").select(
        "invoice_no",
        "invoice_date",
        "customer_id",
        "country_id",
        cents_to_money(F.col("cents")).alias("order_total"),
        "units",
    )
    late = merged["open_sums"].join(sales.select("invoice_no"), "invoice_no", "left_semi")
    sold = merged["product_sums"].union(late.drop("invoice_no")).groupBy("stock_code").agg(*_added())
    sold = sold.select("stock_code", F.col("units").alias("units_sold"), cents_to_money(F.col("cents")).alias("revenue"))
    return replace(tables, totals=totals, product_sales=sold)

"""The order tables of a TPC-H-like schema as retail tables or as a raw sheet.

Hours, cancellations and missing customers are derived by fixed rules, because
those tables do not have them. Keys are turned into text after the joins, so the
shuffles move plain numbers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.model import SOURCE_ORDER, RetailTables
from tallybook.sources.sales import with_source_order


# Columns used here, as stored. Naming them spares the job that reads a file's footer.
COLUMNS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _key(column: str) -> Column:
    return F.col(column).cast("string")


def _price_cents() -> Column:
    """Unit price in cents; integer division leaves nothing to round."""
    line = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return F.call_function("div", line, F.col("l_quantity").cast("bigint"))


def _cents_as_decimal(cents: Column) -> Column:
    return (cents.cast("decimal(10,0)") * F.lit(Decimal("0.01"))).cast("decimal(10,2)")


def _order_time(minutes: Column | None = None) -> Column:
    hours = (6 + F.col("o_orderkey") % 15).cast("int")
    shift = F.make_dt_interval(F.lit(0), hours, F.lit(0) if minutes is None else minutes.cast("int"))
    return F.col("o_orderdate") + shift


def star_tables(spark: SparkSession, folder: str) -> RetailTables:
    """The five tables, straight from the order tables."""
    orders = _read(spark, folder, "orders")
    customer = _read(spark, folder, "customer")
    cancelled = F.col("o_orderstatus") == "F"
    invoices = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        _key("o_orderkey").alias("invoice_no"),
        _order_time().alias("invoice_date"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("customer_id"),
        F.col("c_nationkey").alias("country_id"),
        cancelled.alias("is_cancellation"),
    )
    lines = _read(spark, folder, "lineitem").withColumn("item_id", F.monotonically_increasing_id())
    sold = F.col("l_quantity").cast("int")
    items = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "item_id",
        _key("l_orderkey").alias("invoice_no"),
        _key("l_partkey").alias("stock_code"),
        F.when(cancelled, -sold).otherwise(sold).alias("quantity"),
        _cents_as_decimal(_price_cents()).alias("unit_price"),
    )
    return RetailTables(
        countries=_read(spark, folder, "nation").select(
            F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("name")
        ),
        customers=customer.select(
            F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("country_id")
        ),
        products=_read(spark, folder, "part").select(
            _key("p_partkey").alias("stock_code"), F.col("p_name").alias("description")
        ),
        invoices=invoices,
        invoice_items=items,
    )


def star_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The flat sheet with padding, gaps, bad prices, returns and repeated lines."""
    customer = _read(spark, folder, "customer")
    nation = _read(spark, folder, "nation")
    part = _read(spark, folder, "part")
    moved = F.col("o_orderkey") % 50 == 7
    orders = (
        _read(spark, folder, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("_nation", F.when(moved, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")))
        .join(nation, F.col("_nation") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    # Small plain numbers go through the joins, not the keys and doubles they are made from.
    needed = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", SOURCE_ORDER]
    derived = [F.col("l_quantity").cast("int").alias("_quantity"), _price_cents().alias("_cents")]
    lines = (
        with_source_order(_read(spark, folder, "lineitem"))
        .select(*needed, *derived, (F.col("l_suppkey") % 50 == 0).alias("_nameless"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    returned = F.col("l_returnflag") == "R"
    number = F.concat(F.when(returned, "C").otherwise(""), (500000 + F.col("l_orderkey")).cast("string"))
    quantity = F.col("_quantity")
    spoiled = (F.col("l_orderkey") + F.col("l_linenumber")) % 211
    sheet = lines.select(
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit(" "), number, F.lit(" "))).otherwise(number).alias("InvoiceNo"),
        F.lpad(_key("l_partkey"), 5, "0").alias("StockCode"),
        F.when(F.col("_nameless"), None)
        .when(F.col("l_linenumber") == 7, F.upper("p_name"))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
        .otherwise(F.col("p_name"))
        .alias("Description"),
        F.when(returned, -quantity).otherwise(quantity).alias("Quantity"),
        _order_time((F.col("o_orderkey") * 7 + F.col("l_linenumber")) % 60).alias("InvoiceDate"),
        F.when(spoiled == 0, 0.0)
        .when(spoiled == 1, -1.0)
        .otherwise(F.col("_cents") / 100)
        .alias("UnitPrice"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("double")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
        F.col(SOURCE_ORDER),
        F.when(F.col("l_orderkey") % 100 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_repeats"),
    )
    repeated = sheet.withColumn("_repeat", F.explode("_repeats"))
    order = F.col(SOURCE_ORDER) * 2 + F.col("_repeat")
    return repeated.withColumn(SOURCE_ORDER, order).drop("_repeats", "_repeat")

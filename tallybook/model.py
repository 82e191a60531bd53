"""Data model: the flat sales sheet and the five tables it is split into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lines of the flat sheet as they arrive (one row per invoice line).
RAW_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)
RAW_COLUMNS = RAW_SCHEMA.fieldNames()

#: Holds the text of a CSV line that does not fit RAW_SCHEMA.
CORRUPT = "_corrupt_record"
#: BIGINT, unique and increasing in the row order of the source.
SOURCE_ORDER = "_src"
#: How many identical source lines a cleaned line stands for.
COPIES = "_copies"

COUNTRIES = T.StructType(
    [T.StructField("country_id", T.IntegerType()), T.StructField("name", T.StringType())]
)
# customer_id is BIGINT so that the key space does not end at 2**31.
CUSTOMERS = T.StructType(
    [T.StructField("customer_id", T.LongType()), T.StructField("country_id", T.IntegerType())]
)
PRODUCTS = T.StructType(
    [T.StructField("stock_code", T.StringType()), T.StructField("description", T.StringType())]
)
INVOICES = T.StructType(
    [
        T.StructField("invoice_no", T.StringType()),
        T.StructField("invoice_date", T.TimestampNTZType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("country_id", T.IntegerType()),
        T.StructField("is_cancellation", T.BooleanType()),
    ]
)
INVOICE_ITEMS = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("invoice_no", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DecimalType(10, 2)),
    ]
)

#: Foreign-key order: every table comes after the tables it points to.
TABLE_SCHEMAS = {
    "countries": COUNTRIES,
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "invoices": INVOICES,
    "invoice_items": INVOICE_ITEMS,
}
PRIMARY_KEYS = {
    "countries": "country_id",
    "customers": "customer_id",
    "products": "stock_code",
    "invoices": "invoice_no",
    "invoice_items": "item_id",
}
#: The key on which a repeated load skips rows that are already there.
CONFLICT_KEYS = {
    "countries": "name",
    "customers": "customer_id",
    "products": "stock_code",
    "invoices": "invoice_no",
}

HOME_COUNTRY = "United Kingdom"


@dataclass(frozen=True)
class RetailTables:
    """The five tables every analysis reads.

    The last two fields may hold order totals and sales per product that were
    computed and written before; the analyses then read those instead of the lines.
    """

    countries: DataFrame
    customers: DataFrame
    products: DataFrame
    invoices: DataFrame
    invoice_items: DataFrame
    totals: DataFrame | None = None
    product_sales: DataFrame | None = None

    def items(self) -> list[tuple[str, DataFrame]]:
        """(name, frame) pairs of the five tables, in foreign-key order."""
        return [(name, getattr(self, name)) for name in TABLE_SCHEMAS]

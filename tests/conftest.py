from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from tallybook.model import RAW_SCHEMA, SOURCE_ORDER, TABLE_SCHEMAS, RetailTables
from tallybook.session import local_session
from tallybook.sources.star import star_tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(
        "tests",
        8,
        **{"spark.checkpoint.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse")},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    return star_tables(spark, SMALL)


@pytest.fixture
def make_tables(spark):
    """Tables from short rows: invoices (no, time, customer, country, cancelled) and
    items (invoice, code, quantity, price)."""

    def make(invoices=(), items=(), customers=None, products=None, countries=None) -> RetailTables:
        invoices = [(no, time_of(t), customer, country, c) for no, t, customer, country, c in invoices]
        items = [(i + 1, no, code, quantity, Decimal(str(p))) for i, (no, code, quantity, p) in enumerate(items)]
        if countries is None:
            countries = [(n, f"country {n}") for n in sorted({i[3] for i in invoices})]
        if customers is None:
            customers = sorted({(i[2], i[3]) for i in invoices if i[2] is not None})
        if products is None:
            products = [(code, f"product {code}") for code in sorted({i[2] for i in items})]
        rows = dict(countries=countries, customers=customers, products=products, invoices=invoices, invoice_items=items)
        return RetailTables(**{n: spark.createDataFrame(list(r), TABLE_SCHEMAS[n]) for n, r in rows.items()})

    return make


@pytest.fixture
def make_sheet(spark):
    """A raw sheet; a row gives only what matters and takes the rest from a default."""
    default = dict(
        InvoiceNo="1",
        StockCode="A",
        Description="thing",
        Quantity=1,
        InvoiceDate="2011-01-05 10:00",
        UnitPrice=1.0,
        CustomerID=7.0,
        Country="X",
    )

    def make(*rows: dict):
        schema = RAW_SCHEMA.simpleString()[len("struct<") : -1]
        data = []
        for order, row in enumerate(rows):
            full = {**default, **row}
            full["InvoiceDate"] = time_of(full["InvoiceDate"])
            data.append((*full.values(), order))
        return spark.createDataFrame(data, f"{schema},{SOURCE_ORDER}:bigint")

    return make


def time_of(text: str) -> datetime:
    return datetime.fromisoformat(text) if text else None


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]

"""Views from the sums of loads against views from all lines."""

from __future__ import annotations

import pytest

from tallybook.plans.load import append_sales, compact_sales, load_sales
from tallybook.plans.products import slow_movers, top_products_revenue
from tallybook.plans.sums import _stored, with_sums, write_sums
from tallybook.plans.views import VIEWS, order_totals, sales_per_product
from tallybook.sources.log import read_state
from tallybook.sources.tables import commit_load, read_tables, write_load
from tests.conftest import rows

DAY = "2011-03-06 00:10"


@pytest.fixture
def few_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def equal_views(spark, folder):
    quick, full = with_sums(spark, folder), read_tables(spark, folder)
    for name, view in VIEWS.items():
        assert sorted(rows(view(quick)), key=repr) == sorted(rows(view(full)), key=repr), name
        assert view(quick).schema == view(full).schema
    assert rows(top_products_revenue(quick)) == rows(top_products_revenue(full))
    assert rows(slow_movers(quick, 1000)) == rows(slow_movers(full, 1000))


def test_three_loads_with_more_lines_of_known_invoices(spark, make_sheet, tmp_path, few_tasks):
    def sheet(numbers, code, quantity, **other):
        lines = [dict(InvoiceNo=n, StockCode=code, Quantity=quantity, CustomerID=float(len(n)), **other) for n in numbers]
        return make_sheet(*lines, dict(InvoiceNo=numbers[0], StockCode="extra", UnitPrice=0.37, Quantity=3))

    folder = str(tmp_path / "t")
    load_sales(sheet(["1", "2", "C3", "44"], "a", 2), folder)
    equal_views(spark, folder)
    append_sales(sheet(["2", "C3", "5", "C66"], "b", 5, Country="Y", InvoiceDate="2011-04-01 09:00"), folder)
    append_sales(sheet(["1", "5", "C66", "7"], "a", -1, UnitPrice=2.5, InvoiceDate="2011-05-01 09:00"), folder)
    equal_views(spark, folder)
    quick = with_sums(spark, folder)
    for frame in (order_totals(quick), sales_per_product(quick)):
        assert frame.inputFiles() and not any("/invoice_items/" in file for file in frame.inputFiles())
    compact_sales(spark, folder)
    equal_views(spark, folder)


def test_lines_that_come_before_their_invoice(spark, make_tables, tmp_path, few_tasks):
    folder = str(tmp_path / "t")

    def add(tables, load_id, fresh=False):
        seen = None if fresh else read_state(spark, folder)
        write_load(tables, folder, load_id, seen.buckets if seen else 0)
        write_sums(spark, folder, load_id, seen)
        commit_load(spark, folder, load_id, fresh=fresh, seen=seen)

    one = make_tables([("1", DAY, 7, 1, False)], [("1", "a", 1, "2.00"), ("2", "a", 4, "1.00"), ("C3", "b", 9, "1.00")])
    add(one, "one", fresh=True)
    assert _stored(spark, folder, "open_sums", "one").count() == 2
    equal_views(spark, folder)
    add(make_tables([("2", DAY, 8, 1, False), ("C3", DAY, 8, 1, True)], [("2", "b", 1, "3.00")]), "two")
    equal_views(spark, folder)
    assert sorted(rows(sales_per_product(with_sums(spark, folder)))) == [("a", 5, 6), ("b", 1, 3)]
    add(make_tables(), "three")
    equal_views(spark, folder)

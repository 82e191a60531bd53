import math

import pytest
from pyspark.sql import functions as F

from tallybook.model import COPIES, SOURCE_ORDER
from tallybook.plans.clean import clean_sales, quarantined
from tallybook.plans.normalize import build_items
from tests.conftest import rows


def test_prices(make_sheet):
    prices = [math.nan, None, 0.0, -1.0, 0.001, 1.005, 2.675]
    sheet = make_sheet(*[dict(StockCode=str(i), UnitPrice=p) for i, p in enumerate(prices)])
    items = build_items(clean_sales(sheet))
    got = {r.stock_code: str(r.unit_price) for r in items.collect()}
    assert got == {"4": "0.00", "5": "1.01", "6": "2.68"}


def test_descriptions(make_sheet):
    hard, thin = "\u00a0", "\u2009"
    texts = [None, "nan", " nan ", "", "\ttab\t", f"{hard}hard{thin}", "two  inside", "   "]
    texts += [f"{thin}é", "é", "\x7f", f"a{hard}"]
    sheet = make_sheet(*[dict(StockCode=str(i), Description=t) for i, t in enumerate(texts)])
    got = {r.StockCode: r.Description for r in clean_sales(sheet).collect()}
    assert got == {"3": "", "4": "tab", "5": "hard", "6": "two  inside", "7": "", "8": "é", "9": "é", "10": "\x7f", "11": "a"}


def test_duplicates_are_found_after_trimming_and_nulls_are_equal(make_sheet):
    sheet = make_sheet(
        dict(Description="cup"),
        dict(Description=" cup\n"),
        dict(Description="cup", CustomerID=None),
        dict(Description="cup", CustomerID=None),
        dict(Description="cup", Quantity=2),
        dict(Description="cup"),
    )
    got = clean_sales(sheet).orderBy(SOURCE_ORDER).select("Quantity", "CustomerID", SOURCE_ORDER, COPIES)
    assert rows(got) == [(1, 7, 0, 3), (1, None, 2, 2), (2, 7, 4, 1)]


def test_nan_customer_is_missing(make_sheet):
    got = clean_sales(make_sheet(dict(CustomerID=math.nan), dict(CustomerID=None), dict(CustomerID=12346.0)))
    assert {r.CustomerID for r in got.collect()} == {None, 12346}


def test_cancellation_flag(make_sheet):
    numbers = ["C1", "c2", "A3", " C4", "5C"]
    got = clean_sales(make_sheet(*[dict(InvoiceNo=n) for n in numbers]))
    flags = {r.InvoiceNo: r.is_cancellation for r in got.collect()}
    assert flags == {"C1": True, "c2": False, "A3": False, "C4": True, "5C": False}


def test_rows_that_cannot_be_loaded_are_set_aside(make_sheet):
    sheet = make_sheet(
        dict(StockCode="good"), dict(StockCode=None), dict(Country=None), dict(StockCode="half", CustomerID=7.5)
    )
    assert [r.StockCode for r in clean_sales(sheet).collect()] == ["good"]
    aside = quarantined(sheet).orderBy(SOURCE_ORDER).select(SOURCE_ORDER, "reason")
    assert rows(aside) == [(1, "missing key"), (2, "missing key"), (3, "fractional customer")]


def test_missing_keys_as_text(make_sheet):
    sheet = make_sheet(dict(StockCode=None), dict(InvoiceNo=None, Country=None))
    got = clean_sales(sheet, null_keys="text").orderBy(SOURCE_ORDER).select("InvoiceNo", "StockCode", "Country")
    assert rows(got) == [("1", "nan", "X"), ("nan", "A", "nan")]
    assert quarantined(sheet, null_keys="text").count() == 0


def test_unknown_null_keys(make_sheet):
    with pytest.raises(ValueError):
        clean_sales(make_sheet(dict()), null_keys="drop")


def test_cleaning_twice_changes_nothing(make_sheet):
    sheet = make_sheet(dict(Description=" cup "), dict(Description="cup"), dict(UnitPrice=0.0))
    once = clean_sales(sheet)
    again = clean_sales(once.drop(COPIES, "is_cancellation").withColumn("CustomerID", F.col("CustomerID").cast("double")))
    assert rows(once.drop(COPIES)) == rows(again.drop(COPIES))

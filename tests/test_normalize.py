from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallybook.plans.clean import clean_sales
from tallybook.plans import load
from tallybook.plans.load import append_sales, cleaning_report, load_sales, set_aside_rows
from tallybook.plans.normalize import build_items, build_products, most_frequent, normalize
from tallybook.plans.quality import check_constraints
from tallybook.sources.tables import committed_loads, read_tables, write_tables
from tests.conftest import rows, time_of


def test_ties_take_the_smallest_value(make_sheet):
    sheet = make_sheet(
        *[dict(Country=c, Quantity=i) for i, c in enumerate("bbaa")],
        dict(StockCode="T", Description="late", CustomerID=None),
        dict(StockCode="T", Description="early", CustomerID=None),
    )
    tables = normalize(clean_sales(sheet))
    names = dict(rows(tables.countries))
    assert {(c, names[k]) for c, k in rows(tables.customers)} == {(7, "a")}
    assert dict(rows(tables.products))["T"] == "early"


def test_most_frequent_counts_lines_not_invoices(make_sheet):
    lines = clean_sales(
        make_sheet(
            dict(InvoiceNo="1", Country="b"),
            dict(InvoiceNo="2", Country="b"),
            *[dict(InvoiceNo="3", Country="c", Quantity=q) for q in (1, 2, 3)],
        )
    )
    assert rows(most_frequent(lines, "CustomerID", "Country")) == [(7, "c")]


def test_invoice_takes_first_customer_and_country_and_earliest_time(make_sheet):
    sheet = make_sheet(
        dict(CustomerID=None, Country="z", InvoiceDate="2011-01-05 10:02"),
        dict(CustomerID=7.0, Country="a", InvoiceDate="2011-01-05 10:01"),
        dict(CustomerID=9.0, Country="a", InvoiceDate="2011-01-05 10:00"),
        dict(InvoiceNo="C2", CustomerID=None, Country="a"),
    )
    tables = normalize(clean_sales(sheet))
    ids = {name: key for key, name in rows(tables.countries)}
    got = {r.invoice_no: tuple(r)[1:] for r in tables.invoices.collect()}
    assert got["1"] == (time_of("2011-01-05 10:00"), 7, ids["z"], False)
    assert got["C2"][1:] == (None, ids["a"], True)


def test_countries_are_numbered_in_code_point_order(make_sheet):
    sheet = make_sheet(*[dict(Country=c) for c in ("b", "Z", "é", "a", "USA")])
    assert sorted(rows(normalize(clean_sales(sheet)).countries)) == [(1, "USA"), (2, "Z"), (3, "a"), (4, "b"), (5, "é")]


def test_long_description_is_cut_by_characters(make_sheet):
    text = "é" * 300
    [(code, description)] = rows(build_products(clean_sales(make_sheet(dict(Description=text)))))
    assert description == "é" * 255


def test_item_ids(make_sheet):
    sheet = make_sheet(*[dict(Quantity=q) for q in (5, 5, 4, 3)])
    clean = clean_sales(sheet)
    assert sorted((r.item_id, r.quantity) for r in build_items(clean).collect()) == [(1, 5), (3, 4), (4, 3)]
    contiguous = build_items(clean, contiguous_ids=True)
    assert sorted((r.item_id, r.quantity) for r in contiguous.collect()) == [(1, 5), (2, 4), (3, 3)]


def test_load(spark, make_sheet, tmp_path):
    sheet = make_sheet(
        dict(InvoiceNo="1"),
        dict(InvoiceNo="1"),
        dict(InvoiceNo="C2", Quantity=-1, CustomerID=None),
        dict(InvoiceNo="3", UnitPrice=0.0),
        dict(InvoiceNo="4", Description=None),
        dict(InvoiceNo="5", CustomerID=1.5),
    )
    done = load_sales(sheet, str(tmp_path / "load"))
    counts = {r.step: r.rows for r in done.counts.collect()}
    assert counts == {
        "raw": 6,
        "quarantined": 1,
        "before duplicate removal": 3,
        "duplicates removed": 1,
        "clean": 2,
        "countries": 1,
        "customers": 1,
        "products": 1,
        "invoices": 2,
        "invoice_items": 2,
    }
    assert [r.rows for r in cleaning_report(sheet, done.clean).orderBy("step_no").collect()] == [6, 1, 2, 1, 2]
    again = read_tables(spark, str(tmp_path / "load"))
    assert sorted(rows(again.invoice_items)) == sorted(rows(done.tables.invoice_items))


def test_second_sheet_into_existing_tables(make_sheet, tmp_path):
    folder = str(tmp_path / "load")
    load_sales(make_sheet(dict(InvoiceNo="1", Country="M"), dict(InvoiceNo="2", Country="P")), folder)
    second = make_sheet(
        dict(InvoiceNo="2", Country="A", Quantity=2),
        dict(InvoiceNo="3", Country="P", CustomerID=8.0),
        dict(InvoiceNo="4", Country="A", StockCode="B", CustomerID=9.0),
    )
    tables = append_sales(second, folder).tables
    assert sorted(rows(tables.countries)) == [(1, "M"), (2, "P"), (3, "A")]
    assert sorted(rows(tables.customers)) == [(7, 1), (8, 2), (9, 3)]
    assert {r.invoice_no: r.country_id for r in tables.invoices.collect()} == {"1": 1, "2": 2, "3": 2, "4": 3}
    items = sorted((r.item_id, r.invoice_no, r.quantity) for r in tables.invoice_items.collect())
    assert items == [(1, "1", 1), (2, "2", 1), (3, "2", 2), (4, "3", 1), (5, "4", 1)]
    assert {r.violations for r in check_constraints(tables).collect()} == {0}


def test_a_load_that_fails_half_way_can_be_done_again(spark, make_sheet, tmp_path, monkeypatch):
    folder = str(tmp_path / "load")
    load_sales(make_sheet(dict(InvoiceNo="1")), folder)
    second = make_sheet(dict(InvoiceNo="2", Country="Y", CustomerID=None), dict(InvoiceNo="3", Quantity=None))

    def fails(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(load, "commit_load", fails)
        with pytest.raises(OSError):
            append_sales(second, folder, load_id="march")
    assert [r.invoice_no for r in read_tables(spark, folder).invoices.collect()] == ["1"]
    assert set_aside_rows(spark, folder).count() == 0
    for _ in range(2):
        done = append_sales(second, folder, load_id="march")
        assert {r.step: r.rows for r in done.counts.collect()} == {
            "raw": 2, "quarantined": 1, "before duplicate removal": 1, "duplicates removed": 0, "clean": 1,
            "countries": 1, "customers": 0, "products": 0, "invoices": 1, "invoice_items": 1,
        }
    assert sorted(rows(done.tables.countries)) == [(1, "X"), (2, "Y")]
    assert sorted((r.item_id, r.invoice_no) for r in done.tables.invoice_items.collect()) == [(1, "1"), (2, "2")]
    assert [(r.InvoiceNo, r.reason) for r in set_aside_rows(spark, folder).collect()] == [("3", "missing quantity")]
    assert {r.violations for r in check_constraints(done.tables).collect()} == {0}


def test_items_after_very_large_ids(spark, make_tables, make_sheet, tmp_path):
    folder = str(tmp_path / "load")
    tables = make_tables([("1", "2011-03-06 00:10", 7, 1, False)], [("1", "A", 1, "2.00")], countries=[(1, "X")])
    items = tables.invoice_items.withColumn("item_id", F.lit((1 << 62) + 5))
    write_tables(replace(tables, invoice_items=items), folder)
    done = append_sales(make_sheet(dict(InvoiceNo="2"), dict(InvoiceNo="3")), folder)
    assert sorted(r.item_id - (1 << 62) for r in done.tables.invoice_items.collect()) == [5, 6, 7]


def test_rows_that_break_rules_are_not_published(spark, make_sheet, tmp_path, monkeypatch):
    folder = str(tmp_path / "load")
    monkeypatch.setattr(load, "clean_sales", lambda raw, _: clean_sales(raw.drop("reason")).withColumn("InvoiceDate", F.lit(None).cast("timestamp_ntz")))
    with pytest.raises(ValueError, match=r"not_null\(invoice_date\): 1"):
        load_sales(make_sheet(dict()), folder)
    assert committed_loads(spark, folder) == []


def test_every_rule_of_single_rows_is_a_reason(make_sheet, tmp_path):
    sheet = make_sheet(
        dict(),
        dict(Quantity=None),
        dict(InvoiceDate="2011-01-05 10:00", UnitPrice=99_999_999.995),
        dict(UnitPrice=99_999_999.994),
        dict(InvoiceNo="x" * 21),
        dict(InvoiceNo=" " + "x" * 20 + " "),
        dict(Country="y" * 65),
        dict(UnitPrice=float("nan")),
    )
    done = load_sales(sheet, str(tmp_path / "load"))
    assert {r.step: r.rows for r in done.counts.collect()}["quarantined"] == 4
    assert sorted(r.reason for r in done.set_aside.collect()) == ["key too long"] * 2 + ["missing quantity", "price out of range"]
    assert {r.violations for r in check_constraints(done.tables).collect()} == {0}
    assert done.tables.invoice_items.count() == 3

"""What a load does once and what it does not shuffle or write."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybook.model import COPIES, SOURCE_ORDER
from tallybook.operators import curve, ranking
from tallybook.operators.scratch import materialize
from tallybook.plans import clean, sums
from tallybook.plans.load import load_sales
from tallybook.plans.normalize import build_items
from tallybook.sources.sales import read_sales
from tests.conftest import rows


@pytest.mark.parametrize("bound", [0, 4_000_000])
def test_written_lines_lose_their_copies_without_a_shuffle_of_all_lines(spark, make_sheet, monkeypatch, bound):
    monkeypatch.setattr(clean, "REPEATED_DIGESTS", bound)
    kinds = [{}, {}, {"CustomerID": None}, {"CustomerID": None}, {"Quantity": 2}, {"UnitPrice": 1.5}, {"Country": " X "}, {"Country": "Y"}]
    sheet = materialize(make_sheet(*kinds, *[{"InvoiceNo": str(n)} for n in range(9)]), "raw")
    plain, thrifty = clean.clean_sales(sheet), clean.clean_sales(sheet, written=True)
    assert thrifty.schema == plain.schema
    assert sorted(map(repr, thrifty.collect())) == sorted(map(repr, plain.collect()))
    assert max(r[COPIES] for r in thrifty.collect()) == 4
    unshuffled = "LeftAnti" in thrifty._jdf.queryExecution().executedPlan().toString()
    assert unshuffled == (bound > 0)


def test_different_lines_under_one_digest_stay_apart(spark, make_sheet, monkeypatch):
    monkeypatch.setattr(clean.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
    sheet = materialize(make_sheet({}, {}, {"Quantity": 2}, {"Quantity": 3}), "raw")
    got = sorted((r.Quantity, r[COPIES], r[SOURCE_ORDER]) for r in clean.clean_sales(sheet, written=True).collect())
    assert got == [(1, 2, 0), (2, 1, 2), (3, 1, 3)]


@pytest.mark.parametrize("bits", [0, 3, 17])
def test_numbered_by_a_column_with_gaps(spark, monkeypatch, bits):
    monkeypatch.setattr(ranking, "BLOCK_BITS", bits)
    monkeypatch.setattr(ranking, "MOST_BLOCKS", 20)
    values = [*range(-5, 30, 3), *range(1 << 34, (1 << 34) + 9)]  # block by block, or range-sorted if these are too many
    frame = spark.createDataFrame([(v,) for v in reversed(values)], "v bigint").repartition(3)
    numbered = ranking.numbered_by(frame, "v", "n")
    assert numbered.columns == ["v", "n"]
    assert sorted(rows(numbered)) == [(v, i + 1) for i, v in enumerate(values)]


def test_item_ids_are_numbered_without_writing_the_lines_in_between(spark, make_sheet):
    sheet = make_sheet(*[{"InvoiceNo": str(n), "Quantity": n + 1} for n in range(20)])
    written = materialize(clean.clean_sales(sheet), "clean")
    items = build_items(written, contiguous_ids=True)
    assert sorted(r.item_id for r in items.collect()) == list(range(1, 21))
    assert not any("row-number" in file for file in items.inputFiles())


def test_the_sums_of_a_load_come_from_one_pass(spark, make_sheet, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(sums, "materialize", lambda df, label: made.append(df) or materialize(df, label))
    sheet = make_sheet({}, {"InvoiceNo": "C2", "Quantity": -1}, {"StockCode": "B", "UnitPrice": 0.37}, {"Quantity": 4})
    folder = str(tmp_path / "t")
    load_sales(sheet, folder, load_id="one")
    [frame] = made
    assert any("/invoice_items/" in file for file in frame.inputFiles())
    assert sorted(rows(sums._stored(spark, folder, "product_sums", "one"))) == [("A", 500, 5), ("B", 37, 1)]
    assert rows(sums._stored(spark, folder, "open_sums", "one")) == []


@pytest.mark.parametrize("limits", [[], [2.0], [1.0, 2.0, 5.0, 9.0], [float(n) for n in range(63)]])
def test_a_row_finds_its_cell_by_halving_the_limits(spark, limits):
    values = [n * n + 3 for n in range(64)]
    numbers = [None, float("nan"), *[n / 2 for n in range(-3, 140)]]
    frame = spark.createDataFrame([(n,) for n in numbers], "n double").repartition(3)
    place = curve._by_limits(F.col("n"), limits, values)
    assert frame.select(place.alias("p")).schema["p"].dataType.simpleString() == "bigint"
    for n, p in rows(frame.select("n", place)):
        assert p == values[sum(n is not None and (n != n or n >= limit) for limit in limits)]


def test_a_csv_sheet_is_read_from_text_once(spark, tmp_path):
    """Later jobs read the values that were written, and do not parse the text again."""
    header = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
    lines = ["1,A,x,6,12/1/2010 8:26,2.5,7,X", "2,A,x,6.0,12/1/2010 8:26,2.5,7.0,X", "3,A,x,6.5,12/1/2010 8:26,2.5,7,X"]
    (tmp_path / "sheet.csv").write_text(header + "\n".join(lines) + "\n")
    sheet = read_sales(spark, str(tmp_path / "sheet.csv"), timestamp_format="M/d/yyyy H:mm")
    assert [(r.Quantity, r[SOURCE_ORDER]) for r in sheet.orderBy(SOURCE_ORDER).collect()] == [(6, 0), (6, 1), (None, 2)]
    assert "cast(" not in sheet._jdf.queryExecution().executedPlan().toString().lower()

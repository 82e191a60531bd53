from __future__ import annotations

import datetime
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallybook.operators.curve import along_curve, with_place
from tallybook.plans.views import order_totals
from tallybook.sources.tables import write_layout
from tests.conftest import rows

KINDS = "id bigint, name string, day date, at timestamp_ntz, n int"


def files_with(folder: str, column: str, value) -> tuple[int, int]:
    """(files whose minimum and maximum admit the value, all files)."""
    hits = names = 0
    for name in glob.glob(f"{folder}/*.parquet"):
        groups = pq.ParquetFile(name).metadata
        place = groups.schema.names.index(column)
        stats = [groups.row_group(g).column(place).statistics for g in range(groups.num_row_groups)]
        names += 1
        hits += any(s.has_min_max and s.min <= value <= s.max for s in stats)
    return hits, names


def test_a_filter_on_either_column_skips_most_files(spark, tmp_path):
    # A third of all rows has one customer.
    customer = F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)))
    code = F.concat(F.lit("STOCK-"), F.lpad(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9_000)).cast("string"), 5, "0"))
    df = spark.range(40_000).select("id", customer.alias("customer"), code.alias("code"))
    along_curve(df, ["code", "customer"], "id", 64).write.parquet(str(tmp_path / "curve"))
    for column, value in (("customer", 7_123), ("customer", 901), ("code", "STOCK-04321"), ("code", "STOCK-08000")):
        hits, files = files_with(str(tmp_path / "curve"), column, value)
        assert files == 64
        assert hits <= 24
    back = spark.read.parquet(str(tmp_path / "curve"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 3 * 40_000 / 64


def test_places_of_nulls_ties_and_all_types(spark):
    day = datetime.date(2011, 12, 9)
    rows = [(i, f"k{i:02d}", day + datetime.timedelta(i), datetime.datetime(2011, 1, 1 + i), i) for i in range(16)]
    rows += [(16, None, None, None, None), (17, None, None, None, None), (18, "k15é", day, None, -1), (19, "", None, None, 3)]
    df = spark.createDataFrame(rows, KINDS)
    for column in ("name", "day", "at", "n"):
        places = with_place(df, [column], "p", 4).collect()
        known = sorted((r[column], r["p"]) for r in places if r[column] is not None)
        assert [p for _, p in known] == sorted(p for _, p in known)  # grows with the value
        assert len({p for _, p in known}) > 8
        assert {r["p"] for r in places if r[column] is None} <= {0}
    both = with_place(df, ["name", "n"], "p", 4).collect()
    assert all(0 <= r["p"] < 256 for r in both)


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 2)], "id bigint, _place string, n int")
    assert along_curve(df, ["_place", "n"], "id", 2).collect() == df.collect()
    empty = along_curve(df.limit(0), ["_place", "n"], "id", 2)
    assert empty.columns == df.columns
    assert empty.collect() == []
    with pytest.raises(ValueError, match="BIGINT"):
        with_place(df, ["id", "n"], "p", 32)


def test_layout_along_dates_customers_invoices_and_products(spark, star, tmp_path):
    folder = str(tmp_path / "layout")
    tables = write_layout(star, "curved_", folder, 32, by="curve")
    assert sorted(rows(order_totals(tables))) == sorted(rows(order_totals(star)))
    for table, columns in (("invoices", ("invoice_date", "customer_id")), ("invoice_items", ("invoice_no", "stock_code"))):
        for column in columns:
            value = getattr(star, table).filter(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).first()[column]
            hits, files = files_with(f"{folder}/{table}", column, value)
            assert 0 < hits <= files // 2

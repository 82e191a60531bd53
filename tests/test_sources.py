from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallybook.model import CORRUPT, RAW_COLUMNS, SOURCE_ORDER, TABLE_SCHEMAS, RetailTables
from tallybook.operators import scratch
from tallybook.operators.scratch import materialize, owned_scratch, scratch_root
from tallybook.plans.clean import clean_sales, quarantined
from tallybook.plans.customers import rfm_segments
from tallybook.plans.views import VIEWS, order_totals, register_views, run_query, with_shared_views
from tallybook.sources.sales import read_sales, with_source_order
from tallybook.sources.tables import (
    append_new_keys,
    commit_load,
    committed_loads,
    largest_bucket_share,
    new_keys,
    read_tables,
    reset_tables,
    write_layout,
    write_load,
    write_tables,
)
from tests.conftest import rows

CSV = """InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
536365,85123A,"HOLDER, white ",6,2010-12-01T08:26:00,2.55,17850,United Kingdom
C536379,D,Discount,-1,2010-12-01T09:41:00,27.5,,United Kingdom
536370,22728,ALARM,many,2010-12-01T08:45:00,3.75,12583,France
536371,22086,LAMP,80,2010-12-01T09:00:00,2.55,13748,France
"""


def test_csv_lines_that_do_not_fit_are_kept_aside(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text(CSV)
    raw = read_sales(spark, str(tmp_path / "sheet.csv"))
    assert raw.columns == [*RAW_COLUMNS, CORRUPT, SOURCE_ORDER]
    clean = clean_sales(raw).orderBy(SOURCE_ORDER)
    got = [(r.InvoiceNo, r.Description, r.Quantity, r.CustomerID) for r in clean.collect()]
    assert got == [("536365", "HOLDER, white", 6, 17850), ("C536379", "Discount", -1, None), ("536371", "LAMP", 80, 13748)]
    [bad] = quarantined(raw).collect()
    assert bad.reason == "unreadable line" and "many" in bad[CORRUPT]


EXPORT = """InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
536365,85123A,"FLOWER FAIRY,5 SUMMER B""DRAW LINERS""\",6,12/1/2010 8:26,2.55,17850.0,United Kingdom
536366,22728,"say ""hi"", you",1,2/28/2011 23:59,3.75,,France
536367,22729,ALARM,many,12/1/2010 8:45,3.75,12583,France
536368,22730,LAMP,1,12/1/2010 8:45,x,12583,France
536369,22731,LAMP,1,2010-12-01T08:45,1.0,12583,France
536370,22732,SHORT LINE,1
536371,22733,LAMP,,12/1/2010 8:45,1.0,12583,France
536372,22734,LAMP,1,,1.0,12583,France
536373,22735,LAMP,1,3/13/2011 2:30,123456789.0,12583,France
536374,a code of over twenty characters,LAMP,1,3/13/2011 2:30,1.0,12583,France
536375,22736,LAMP,1,3/13/2011 2:30,1.0,12583,France
"""


@pytest.fixture
def exported(spark, tmp_path):
    (tmp_path / "export.csv").write_text(EXPORT.replace('\\"', '"'))
    return read_sales(spark, str(tmp_path / "export.csv"), timestamp_format="M/d/yyyy H:mm")


def test_exported_text_dates_and_reasons(exported):
    got = [(r.InvoiceNo, r.Description, str(r.InvoiceDate)) for r in clean_sales(exported).orderBy(SOURCE_ORDER).collect()]
    assert got == [
        ("536365", 'FLOWER FAIRY,5 SUMMER B"DRAW LINERS"', "2010-12-01 08:26:00"),
        ("536366", 'say "hi", you', "2011-02-28 23:59:00"),
        ("536375", "LAMP", "2011-03-13 02:30:00"),
    ]
    aside = quarantined(exported)
    reasons = [r.reason for r in aside.orderBy(SOURCE_ORDER).collect()]
    assert reasons == ["unreadable line"] * 4 + ["missing quantity", "missing date", "price out of range", "key too long"]
    # The same whatever is asked of it.
    assert aside.count() == 8
    assert len(aside.select("InvoiceNo", "reason").collect()) == 8
    assert exported.filter(F.col(CORRUPT).isNotNull()).select(F.lit(1)).count() == 4
    assert [r[CORRUPT] for r in aside.select(CORRUPT, SOURCE_ORDER).orderBy(SOURCE_ORDER).collect()][:1] == [
        "536367,22729,ALARM,many,12/1/2010 8:45,3.75,12583,France"
    ]


def test_fractions_of_seconds_and_whole_numbers_with_a_point(spark, tmp_path):
    head, times = EXPORT.splitlines()[0], ["8:26:01.5", "8:26:01.25", "8:26:01"]
    numbers = ["6.0", "-12.000", "6.5", "1e2", "3000000000", "", " 7 ", "six"]
    lines = [f"{i},A,x,{q},12/1/2010 {times[i % 3]},1.0,7,X" for i, q in enumerate(numbers)]
    (tmp_path / "s.csv").write_text("\n".join([head, *lines]) + "\n")
    raw = read_sales(spark, str(tmp_path / "s.csv"), timestamp_format="M/d/yyyy H:mm:ss[.SSS][.SS][.S]").orderBy(SOURCE_ORDER)
    got = raw.collect()
    assert [r.Quantity for r in got] == [6, -12, None, 100, None, None, 7, None]
    assert [r[CORRUPT] is not None for r in got] == [False, False, True, False, True, False, False, True]
    assert [r.InvoiceDate.microsecond for r in got[:3]] == [500_000, 250_000, 0]
    assert len({r.InvoiceDate for r in got}) == 3


def test_line_breaks_in_quoted_text(spark, tmp_path):
    head = EXPORT.splitlines()[0]
    (tmp_path / "m.csv").write_text(f'{head}\n1,A,"two\nlines",1,2010-12-01T08:26:00,1.0,7,X\n')
    [row] = read_sales(spark, str(tmp_path / "m.csv"), multi_line=True).collect()
    assert row.Description == "two\nlines" and row[CORRUPT] is None


@pytest.mark.parametrize("most", [1, 3])
def test_order_does_not_depend_on_how_splits_are_packed(spark, tmp_path, most):
    header = CSV.splitlines()[0]
    for part in range(20):
        lines = [f"{part:02}{i:04},A,x,1,2010-12-01T08:26:00,1.0,1,X" for i in range(2000)]
        (tmp_path / f"part-{part:02}.csv").write_text("\n".join([header, *lines]) + "\n")
    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.maxPartitionNum": str(most)}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = read_sales(spark, str(tmp_path)).orderBy(SOURCE_ORDER).select("InvoiceNo", SOURCE_ORDER).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert [r[SOURCE_ORDER] for r in got] == list(range(40_000))
    numbers = [r.InvoiceNo for r in got]
    assert numbers == sorted(numbers)


def test_csv_order_over_splits_and_files(spark, tmp_path):
    header = CSV.splitlines()[0]
    for part in range(3):
        lines = [f"{part}{i:04},A,x,1,2010-12-01T08:26:00,1.0,1,X" for i in range(4000)]
        (tmp_path / f"part {part}.csv").write_text("\n".join([header, *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        raw = read_sales(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 3
        numbers = [r.InvoiceNo for r in raw.orderBy(SOURCE_ORDER).collect()]
        assert raw.select(SOURCE_ORDER).distinct().count() == 12_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers == sorted(numbers) and len(numbers) == 12_000


def test_parquet_order_over_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    numbered = with_source_order(spark.read.parquet(str(tmp_path / "t")))
    assert [r.id for r in numbered.orderBy(SOURCE_ORDER).collect()] == list(range(1000))
    assert numbered.select(SOURCE_ORDER).distinct().count() == 1000


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_sales(spark, "sheet.xlsx", "xlsx")


def test_write_read_reset(spark, star, tmp_path):
    folder = str(tmp_path / "tables")
    written = write_tables(star, folder)
    for name, df in written.items():
        assert [f.dataType for f in df.schema] == [f.dataType for f in TABLE_SCHEMAS[name]]
        assert df.count() == getattr(star, name).count()
    assert [df.count() for _, df in reset_tables(spark, folder).items()] == [0] * 5


def test_append_keeps_existing_rows_and_doubles_lines(spark, make_tables, tmp_path):
    day = "2011-03-06 00:10"
    first = make_tables([("1", day, 7, 1, False)], [("1", "a", 1, "2.00")], countries=[(1, "Here")])
    second = make_tables(
        [("1", day, 7, 2, True), ("2", day, 8, 2, False)],
        [("1", "a", 1, "2.00"), ("2", "b", 1, "3.00")],
        products=[("a", "other name"), ("b", "new")],
        countries=[(2, "Here"), (3, "There")],
    )
    folder = str(tmp_path / "tables")
    write_tables(first, folder)
    got = append_new_keys(second, folder)
    assert sorted(rows(got.countries)) == [(1, "Here"), (3, "There")]
    assert sorted(rows(got.products)) == [("a", "product a"), ("b", "new")]
    assert sorted((r.invoice_no, r.is_cancellation) for r in got.invoices.collect()) == [("1", False), ("2", False)]
    assert sorted(r.invoice_no for r in got.invoice_items.collect()) == ["1", "1", "2"]
    assert sorted(rows(read_tables(spark, folder).customers)) == [(7, 1), (8, 2)]


def test_a_load_counts_only_when_it_is_committed(spark, make_tables, tmp_path):
    day, folder = "2011-03-06 00:10", str(tmp_path / "tables")
    assert committed_loads(spark, folder) == []
    assert read_tables(spark, folder).invoices.collect() == []
    one = make_tables([("1", day, 7, 1, False)], [("1", "a", 1, "2.00")])
    two = make_tables([("2", day, 7, 1, False)], [("2", "a", 1, "2.00")])
    write_tables(one, folder, "first")
    write_load(two, folder, "second")
    assert [r.invoice_no for r in read_tables(spark, folder).invoices.collect()] == ["1"]
    append_new_keys(two, folder, "second")
    append_new_keys(two, folder, "second")
    assert sorted(r.invoice_no for r in read_tables(spark, folder).invoice_items.collect()) == ["1", "2"]
    assert committed_loads(spark, folder) == ["first", "second"]
    commit_load(spark, folder, "second", fresh=True)
    assert [r.invoice_no for r in read_tables(spark, folder).invoices.collect()] == ["2"]


def test_new_keys_take_the_first_incoming_row(spark):
    incoming = spark.createDataFrame([("a", 1, 5), ("b", 2, 9), ("b", 3, 8)], "k string, v int, at int")
    existing = spark.createDataFrame([("a", 0)], "k string, v int")
    assert rows(new_keys(incoming, existing, "k", order="at")) == [("b", 3)]


def test_bucketed_layout_needs_no_shuffle_for_order_totals(spark, star, tmp_path):
    tables = write_layout(star, "flat_", str(tmp_path / "layout"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = order_totals(tables)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert sorted(rows(order_totals(tables))) == sorted(rows(order_totals(star)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layout_splits_an_invoice_with_most_lines(spark, star, tmp_path):
    hot = F.when(F.col("item_id") % 2 == 0, F.lit("1")).otherwise(F.col("invoice_no"))
    skewed = RetailTables(
        star.countries, star.customers, star.products, star.invoices, star.invoice_items.withColumn("invoice_no", hot)
    )
    assert largest_bucket_share(skewed.invoice_items, "invoice_no", 16) > 4
    tables = write_layout(skewed, "hot_", str(tmp_path / "layout"), 16, by="range")
    files = tables.invoice_items.groupBy(F.input_file_name().alias("file")).count()
    sizes = [r["count"] for r in files.collect()]
    assert max(sizes) < 3 * sum(sizes) / 16
    assert sorted(rows(order_totals(tables))) == sorted(rows(order_totals(skewed)))


def test_views_and_parameters_in_sql(spark, star):
    names = register_views(star)
    assert set(VIEWS) < set(names)
    got = run_query(spark, "SELECT count(*) AS n FROM v_order_totals WHERE order_total > :least", {"least": 100_000})
    assert got.first().n == order_totals(star).filter("order_total > 100000").count()
    assert run_query(spark, "SELECT 1 AS one").first().one == 1


def test_shared_views_give_the_same_results(star):
    shared = with_shared_views(star)
    for view in VIEWS.values():
        assert sorted(rows(view(shared)), key=repr) == sorted(rows(view(star)), key=repr)


def test_scratch_tables_live_in_the_named_folder(spark, tmp_path):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    row = spark.createDataFrame([(1, Decimal("1.00"))], "a int, b decimal(10,2)").coalesce(1)
    kept = materialize(row, "sample")
    [file] = kept.inputFiles()
    assert scratch_root(spark) in file
    assert rows(kept) == [(1, Decimal("1.00"))]


def test_owned_scratch_leaves_nothing_and_other_frames_alone(spark, star):
    other = materialize(spark.range(3), "other")
    folder = Path(scratch_root(spark))
    before = set(folder.iterdir())
    with owned_scratch(spark):
        inside = materialize(spark.range(5), "inside")
        assert sum(r.customers for r in rfm_segments(star).collect()) > 0
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before
    assert other.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inside.filter("id > 1").collect()


@pytest.mark.parametrize("folder", ["/tmp/x", "file:/tmp/x", "file:///tmp", "hdfs://store/x", "/shared/x"])
def test_a_temporary_folder_of_one_machine_is_refused_on_a_cluster(monkeypatch, folder):
    monkeypatch.setattr(scratch.tempfile, "gettempdir", lambda: "/tmp")
    if "tmp" in folder:
        with pytest.raises(RuntimeError):
            scratch._refuse_own_disk(folder)
    else:
        assert scratch._refuse_own_disk(folder) == folder

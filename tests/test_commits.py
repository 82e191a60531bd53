"""Writers at the same time, the key registry, compaction, rules across loads."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest

from tallybook.plans import load
from tallybook.plans.load import append_sales, compact_sales, load_sales, set_aside_rows
from tallybook.plans.quality import added_violations, check_constraints
from tallybook.plans.views import order_totals
from tallybook.sources import log, tables
from tallybook.sources.log import CommitConflict, State, read_state, write_state
from tallybook.sources.tables import (
    KEYED,
    append_new_keys,
    committed_loads,
    compact,
    known_among,
    known_keys,
    read_load,
    read_tables,
    unregistered,
    write_tables,
)
from tests.conftest import rows

DAY = "2011-03-06 00:10"


@pytest.fixture(autouse=True)
def few_tasks(spark, monkeypatch):
    """Small loads in few tasks."""
    monkeypatch.setattr(tables, "LEAST_BUCKETS", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def sheet_of(make_sheet, numbers, **other):
    return make_sheet(*({"InvoiceNo": str(n), "StockCode": f"P{n % 7}", "CustomerID": float(n % 5 + 1), **other} for n in numbers))


# -- the log


def test_a_number_is_given_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert read_state(spark, folder) == State()
    first = State(0, "a", ["a"], ["a"], 7, 3, 8)
    write_state(spark, folder, first)
    with pytest.raises(CommitConflict):
        write_state(spark, folder, State(0, "b", ["b"], ["b"], 1, 1, 8))
    assert read_state(spark, folder) == first
    write_state(spark, folder, State(1, "c", ["a", "c"], ["a", "c"], 9, 3, 8))
    assert read_state(spark, folder).live == ["a", "c"]
    assert [p.name for p in sorted(Path(folder, "log").iterdir())] == ["000000000000.json", "000000000001.json"]


def test_many_threads_get_one_number_each(spark, tmp_path):
    won = []

    def run(me):
        for _ in range(10):
            if log.create_once(spark, str(tmp_path / "log"), "000.json", str(me)):
                won.append(me)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and (tmp_path / "log" / "000.json").read_text() == str(won[0])


def test_the_same_through_hadoop(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    assert log._create_once_hadoop(spark, folder, "_draft-1", "000.json", "one")
    assert not log._create_once_hadoop(spark, folder, "_draft-2", "000.json", "two")
    assert (tmp_path / "log" / "000.json").read_text() == "one"
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("_draft")]


# -- two writers


def test_the_second_of_two_writers_loads_on_top_of_the_first(spark, make_sheet, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    load_sales(sheet_of(make_sheet, range(1, 11)), folder, contiguous_ids=True)
    slow = sheet_of(make_sheet, range(8, 16), Country="Y")
    fast = sheet_of(make_sheet, range(12, 20), Country="Z")
    write, tries = load.write_load, []

    def overtaken(*args):
        tries.append(args[2])
        if len(tries) == 1:  # while the slow load writes, another one is committed
            append_sales(fast, folder, contiguous_ids=True, load_id="fast")
        return write(*args)

    monkeypatch.setattr(load, "write_load", overtaken)
    append_sales(slow, folder, contiguous_ids=True, load_id="slow")
    assert tries == ["slow", "fast", "slow"]
    assert committed_loads(spark, folder)[1:] == ["fast", "slow"]
    got = read_tables(spark, folder)
    assert sorted(r.item_id for r in got.invoice_items.collect()) == list(range(1, 27))
    assert sorted(int(r.invoice_no) for r in got.invoices.collect()) == list(range(1, 20))
    names = {r.country_id: r.name for r in got.countries.collect()}
    assert names == {1: "X", 2: "Z", 3: "Y"}
    lands = {int(r.invoice_no): names[r.country_id] for r in got.invoices.collect()}
    assert (lands[9], lands[11], lands[12], lands[15], lands[19]) == ("X", "Y", "Z", "Z", "Z")
    assert {r.violations for r in check_constraints(got).collect()} == {0}


def test_two_threads_load_at_once(spark, make_sheet, tmp_path):
    folder = str(tmp_path / "t")
    load_sales(sheet_of(make_sheet, range(10)), folder, contiguous_ids=True)
    sheets = [sheet_of(make_sheet, range(a, a + 10)) for a in (5, 12)]
    failed = []

    def run(sheet, name):
        try:
            append_sales(sheet, folder, contiguous_ids=True, load_id=name)
        except Exception as error:  # seen by the assertion below
            failed.append(error)

    threads = [threading.Thread(target=run, args=(s, f"load {i}")) for i, s in enumerate(sheets)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = read_tables(spark, folder)
    assert sorted(r.item_id for r in got.invoice_items.collect()) == list(range(1, 31))
    assert sorted(int(r.invoice_no) for r in got.invoices.collect()) == list(range(22))
    assert {r.violations for r in check_constraints(got).collect()} == {0}


def test_a_load_gives_up_after_many_conflicts(spark, make_tables, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    one = make_tables([("1", DAY, 7, 1, False)], [("1", "a", 1, "2.00")])
    write_tables(one, folder)

    def taken(*_):
        raise CommitConflict("always")

    monkeypatch.setattr(tables, "write_state", taken)
    monkeypatch.setattr(tables, "ATTEMPTS", 3)
    with pytest.raises(CommitConflict):
        append_new_keys(one, folder)
    with pytest.raises(CommitConflict):
        write_tables(one, folder)


# -- the registry of keys


def test_an_append_does_not_shuffle_what_is_there(spark, make_tables, tmp_path):
    folder = str(tmp_path / "t")
    numbers = range(50)
    write_tables(make_tables([(str(n), DAY, n, 1, False) for n in numbers], [(str(n), f"P{n}", 1, "2.00") for n in numbers]), folder)
    state = read_state(spark, folder)
    incoming = make_tables([(str(n), DAY, n, 1, False) for n in range(40, 60)])
    for setting, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(setting, value)
    try:
        registry = known_keys(spark, folder, "invoices", state)
        plan = known_among(incoming.invoices, "invoice_no", registry)._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
        above = lines[:scan]  # the registry is the first child, so all above it is its way up
        assert "ShuffledHashJoin" in plan and not any("Exchange" in line or "Sort" in line.split("(")[0] for line in above)
        assert plan.count("Exchange hashpartitioning") == 1  # of the incoming keys
        new = unregistered(incoming.invoices, "invoice_no", known_keys(spark, folder, "invoices", state))
        assert sorted(int(r.invoice_no) for r in new.collect()) == list(range(50, 60))
    finally:
        for setting in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(setting)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tallybook_")]


def test_keys_of_loads_that_do_not_count_are_not_known(spark, make_tables, tmp_path):
    folder = str(tmp_path / "t")
    one = make_tables([("1", DAY, 7, 1, False)], [("1", "a", 1, "2.00")])
    two = make_tables([("2", DAY, 8, 1, False)], [("2", "b", 1, "2.00")])
    write_tables(one, folder, "first")
    tables.write_load(two, folder, "second", read_state(spark, folder).buckets)
    known = {n: [r.key for r in known_keys(spark, folder, n, read_state(spark, folder)).collect()] for n in KEYED}
    assert known == {"customers": [7], "products": ["a"], "invoices": ["1"]}
    append_new_keys(two, folder, "second")
    assert len(read_tables(spark, folder).customers.collect()) == 2


def test_null_keys_and_empty_tables(spark, make_tables, tmp_path):
    folder = str(tmp_path / "t")
    empty = make_tables()
    write_tables(empty, folder)
    assert known_keys(spark, folder, "invoices", read_state(spark, folder)).collect() == []
    one = make_tables([("1", DAY, None, 1, False)], [("1", "a", 1, "2.00")], customers=[(None, 1), (3, 1)])
    assert sorted(rows(append_new_keys(one, folder).customers), key=repr) == [(3, 1), (None, 1)]
    assert append_new_keys(empty, folder).invoices.count() == 1
    assert known_keys(spark, str(tmp_path / "none"), "invoices", State()).collect() == []


def test_the_last_ids_come_from_the_log(spark, make_sheet, tmp_path):
    folder = str(tmp_path / "t")
    load_sales(sheet_of(make_sheet, range(6)), folder, contiguous_ids=True)
    state = read_state(spark, folder)
    assert (state.last_item, state.last_country) == (6, 1)
    append_sales(sheet_of(make_sheet, range(3), Country="W"), folder, contiguous_ids=True)
    state = read_state(spark, folder)
    assert (state.last_item, state.last_country) == (9, 2)


# -- compaction


def test_compaction_keeps_rows_and_later_loads(spark, make_sheet, tmp_path):
    folder = str(tmp_path / "t")
    bad = {"CustomerID": 1.5}
    load_sales(sheet_of(make_sheet, range(10)), folder, contiguous_ids=True, load_id="a")
    append_sales(sheet_of(make_sheet, range(5, 15)).union(make_sheet(bad)), folder, contiguous_ids=True, load_id="b")
    before = {n: sorted(rows(df), key=repr) for n, df in read_tables(spark, folder).items()}
    totals = sorted(rows(order_totals(read_tables(spark, folder))))
    state = compact_sales(spark, folder)
    assert len(state.live) == 1 and committed_loads(spark, folder) == ["a", "b"]
    assert {n: sorted(rows(df), key=repr) for n, df in read_tables(spark, folder).items()} == before
    assert sorted(rows(order_totals(read_tables(spark, folder)))) == totals
    assert set_aside_rows(spark, folder).count() == 1
    again = append_sales(sheet_of(make_sheet, range(5, 15)), folder, load_id="b")  # known to be done
    assert again.clean is None and again.set_aside.count() == 1
    append_sales(sheet_of(make_sheet, range(12, 18)), folder, contiguous_ids=True, load_id="c")
    got = read_tables(spark, folder)
    assert sorted(int(r.invoice_no) for r in got.invoices.collect()) == list(range(18))
    assert sorted(r.item_id for r in got.invoice_items.collect()) == list(range(1, 27))
    assert len(read_state(spark, folder).live) == 2
    assert compact_sales(spark, folder).live != state.live
    assert compact_sales(spark, folder).seq == read_state(spark, folder).seq  # nothing left to do


def test_a_load_during_a_compaction_stays_behind_it(spark, make_tables, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    parts = [make_tables([(str(n), DAY, n, 1, False)], [(str(n), "a", 1, "2.00")]) for n in range(4)]
    write_tables(parts[0], folder, "0")
    append_new_keys(parts[1], folder, "1")
    write, during = tables.write_load, []

    def meanwhile(*args):
        if not during:
            during.append(args[2])
            append_new_keys(parts[2], folder, "2")
        return write(*args)

    monkeypatch.setattr(tables, "write_load", meanwhile)
    state = compact(spark, folder)
    assert state.live == [*during, "2"] and state.done == ["0", "1", "2"]
    assert sorted(r.invoice_no for r in read_tables(spark, folder).invoices.collect()) == ["0", "1", "2"]
    during.clear()
    monkeypatch.setattr(tables, "write_load", lambda *a: (during or (during.append(1), write_tables(parts[3], folder)), write(*a))[1])
    with pytest.raises(CommitConflict):
        compact(spark, folder)
    assert [r.invoice_no for r in read_tables(spark, folder).invoices.collect()] == ["3"]


def test_compaction_can_change_the_number_of_buckets(spark, make_tables, tmp_path):
    folder = str(tmp_path / "t")
    one = make_tables([("1", DAY, 7, 1, False)], [("1", "a", 1, "2.00")])
    write_tables(one, folder)
    assert compact(spark, folder, buckets=3).buckets == 3
    assert append_new_keys(one, folder).invoices.count() == 1
    files = read_load(spark, folder, read_state(spark, folder).live[0]).invoices.inputFiles()
    assert files


# -- rules across loads


def test_added_rows_must_point_to_something(spark, make_tables):
    def keys(*values, kind="bigint"):
        return spark.createDataFrame([(v,) for v in values], f"key {kind}")

    known = {
        "countries": keys(1, kind="int"),
        "customers": keys(7, 8),
        "products": keys("a", kind="string"),
        "invoices": keys("1", kind="string"),
    }
    added = make_tables(
        [("2", DAY, 7, 1, False), ("3", DAY, 9, 1, False), ("4", DAY, None, 5, False), ("1", DAY, 8, 1, False)],
        [("2", "a", 1, "1.00"), ("1", "b", 1, "1.00"), ("99", "zzz", 1, "1.00"), ("99", "a", 1, "1.00")],
        customers=[(8, 1), (11, 6)],
        products=[("b", "new"), ("b", "twice")],
        countries=[(2, "New")],
    )
    got = {(r.table_name, r.rule): r.violations for r in added_violations(added, known).collect()}
    assert {k: v for k, v in got.items() if v} == {
        ("customers", "unique(customer_id)"): 1,
        ("products", "unique(stock_code)"): 1,
        ("invoices", "unique(invoice_no)"): 1,
        ("customers", "exists(country_id in countries)"): 1,
        ("invoices", "exists(customer_id in customers)"): 1,
        ("invoices", "exists(country_id in countries)"): 1,
        ("invoice_items", "exists(invoice_no in invoices)"): 1,
        ("invoice_items", "exists(stock_code in products)"): 1,
    }
    assert len(got) == 11


def test_a_load_that_breaks_a_rule_does_not_count(spark, make_sheet, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    load_sales(sheet_of(make_sheet, range(4)), folder)
    without = lambda *a: load.RetailTables(**{**dict(added(*a).items()), "products": added(*a).products.limit(0)})
    added = load.added_rows
    monkeypatch.setattr(load, "added_rows", without)
    with pytest.raises(ValueError, match="stock_code in products"):
        append_sales(sheet_of(make_sheet, range(4, 8), StockCode="new"), folder)
    assert read_tables(spark, folder).invoices.count() == 4

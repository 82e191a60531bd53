from decimal import Decimal

from tallybook.plans.products import bought_together, return_rate, slow_movers, top_products_units
from tallybook.plans.reports import products_slow
from tests.conftest import rows

DAY = "2011-03-01 10:00"


def test_return_rate(make_tables):
    tables = make_tables(
        invoices=[("1", DAY, 7, 1, False), ("C2", DAY, 7, 1, True)],
        items=[
            ("C2", "only returned", -60, 1),
            ("1", "no return", 50, 1),
            ("1", "more back", 60, 1),
            ("C2", "more back", -90, 1),
            ("1", "few", 49, 1),
            ("C2", "few", -49, 1),
            ("1", "third", 300, 1),
            ("C2", "third", -100, 1),
        ],
    )
    got = [(code, sold, back, rate) for code, _, sold, back, rate in rows(return_rate(tables))]
    assert got == [
        ("more back", 60, 90, Decimal("150.00")),
        ("third", 300, 100, Decimal("33.33")),
        ("no return", 50, 0, Decimal("0.00")),
    ]


def test_pairs_count_lines_and_leave_cancellations_out(make_tables):
    tables = make_tables(
        invoices=[("1", DAY, 7, 1, False), ("2", DAY, 7, 1, False), ("C3", DAY, 7, 1, True)],
        items=[
            ("1", "a", 1, 1),
            ("1", "a", 5, 1),
            ("1", "b", 1, 1),
            ("2", "b", 1, 1),
            ("2", "c", 1, 1),
            ("C3", "b", -1, 1),
            ("C3", "c", -1, 1),
        ],
    )
    assert rows(bought_together(tables)) == [
        ("a", "b", "product a", "product b", 2),
        ("b", "c", "product b", "product c", 1),
    ]


def test_slow_movers_keep_what_the_report_page_leaves_out(make_tables):
    tables = make_tables(
        invoices=[("1", DAY, 7, 1, False), ("2", DAY, 7, 1, False), ("C3", DAY, 7, 1, True)],
        items=[
            ("1", "minus", -3, 1),
            ("1", "few", 4, 1),
            ("1", "few", 1, 1),
            ("2", "few", 1, 1),
            ("1", "ten", 10, 1),
            ("C3", "cancelled only", -1, 1),
        ],
        products=[(c, c) for c in ("minus", "few", "ten", "cancelled only", "never sold")],
    )
    assert rows(slow_movers(tables)) == [("minus", "minus", -3, 1), ("few", "few", 6, 2)]
    assert rows(products_slow(tables)) == [("few", "few", 6, Decimal("6.00"))]


def test_best_sellers_break_ties_by_code(make_tables):
    tables = make_tables(
        invoices=[("1", DAY, 7, 1, False)], items=[("1", "b", 5, 1), ("1", "a", 5, 1), ("1", "c", 6, 1)]
    )
    assert [code for code, _, _ in rows(top_products_units(tables, n=2))] == ["c", "a"]

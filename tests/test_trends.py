from datetime import date
from decimal import Decimal

from tallybook.plans.markets import aov_by_country, country_share, top_foreign_markets
from tallybook.plans.operations import basket_size_distribution, cancellation_rate, order_value_stats
from tallybook.plans.reports import geo_kpis, overview_kpis, trend_mom, weekday_hour_matrix
from tallybook.plans.trends import month_over_month, revenue_by_weekday, weekday_hour_orders
from tallybook.plans.views import order_totals
from tests.conftest import rows


def test_growth_looks_at_the_last_month_with_sales(make_tables):
    tables = make_tables(
        invoices=[
            ("1", "2011-01-10 10:00", 7, 1, False),
            ("2", "2011-03-10 10:00", 7, 1, False),
            ("3", "2011-04-10 10:00", 7, 1, False),
            ("4", "2011-05-10 10:00", 7, 1, False),
        ],
        items=[("1", "a", 3, "1.00"), ("2", "a", 4, "1.00"), ("3", "a", 4, "0.00"), ("4", "a", 1, "5.00")],
    )
    assert [(m.month, p, g) for m, _, p, g in rows(month_over_month(tables))] == [
        (1, None, None),
        (3, Decimal("3.00"), Decimal("33.33")),
        (4, Decimal("4.00"), Decimal("-100.00")),
        (5, Decimal("0.00"), None),
    ]
    got = rows(trend_mom(tables))
    assert [r[0].month for r in got] == [3, 4, 5]
    assert got[0][3] == 100 * (4.0 - 3.0) / 3.0 and got[2][3] is None


def test_invoice_without_lines(make_tables):
    tables = make_tables(
        invoices=[
            ("1", "2011-03-07 09:30", 7, 1, False),
            ("2", "2011-03-07 09:45", 7, 1, False),
            ("C3", "2011-03-08 10:00", 7, 1, True),
        ],
        items=[("1", "a", 3, "1.00"), ("1", "b", 3, "1.00")],
    )
    assert rows(weekday_hour_orders(tables)) == [(1, 9, 2)]
    assert rows(cancellation_rate(tables)) == [(date(2011, 3, 1), 2, 1, Decimal("33.33"))]
    assert [r.invoice_no for r in order_totals(tables).collect()] == ["1"]
    assert rows(basket_size_distribution(tables)) == [(2, 1)]
    assert rows(revenue_by_weekday(tables)) == [("Monday", 1, 1, Decimal("6.00"))]
    assert rows(revenue_by_weekday(tables, padded=True))[0][0] == "Monday   "


def test_week_matrix_has_all_days_and_hours(make_tables):
    tables = make_tables(
        invoices=[("1", "2011-03-06 00:10", 7, 1, False), ("2", "2011-03-06 23:59", None, 1, False)],
        items=[("1", "a", 3, "1.00")],
    )
    got = weekday_hour_matrix(tables)
    assert got.columns == ["day"] + [f"h{h}" for h in range(24)]
    cells = {r.day: [v for v in tuple(r)[1:] if v is not None] for r in got.collect()}
    assert cells == {"Mon": [], "Tue": [], "Wed": [], "Thu": [], "Fri": [], "Sat": [], "Sun": [1, 1]}
    sunday = got.filter("day = 'Sun'").first()
    assert (sunday.h0, sunday.h23) == (1, 1)


def test_median_of_an_even_number_of_orders(make_tables):
    tables = make_tables(
        invoices=[("1", "2011-03-06 00:10", 7, 1, False), ("2", "2011-03-06 23:59", 8, 1, False)],
        items=[("1", "a", 1, "1.00"), ("2", "a", 1, "2.50")],
    )
    assert rows(order_value_stats(tables)) == [(Decimal("1.75"), Decimal("1.75"))]
    assert rows(order_value_stats(tables, exact=False)) == [(Decimal("1.75"), Decimal("1.00"))]


def test_markets(make_tables):
    tables = make_tables(
        invoices=[
            ("1", "2011-03-06 00:10", 7, 1, False),
            ("2", "2011-03-06 23:59", None, 2, False),
            ("3", "2011-03-07 23:59", 7, 2, False),
        ],
        items=[("1", "a", 1, "2.00"), ("2", "a", 1, "0.55"), ("3", "a", 1, "0.46")],
        countries=[(1, "United Kingdom"), (2, "France"), (3, "Unused")],
    )
    assert rows(top_foreign_markets(tables)) == [("France", 1, Decimal("1.01"))]
    assert rows(aov_by_country(tables, min_orders=2)) == [("France", 2, Decimal("0.51"))]
    assert rows(country_share(tables)) == [
        ("United Kingdom", Decimal("2.00"), Decimal("66.45")),
        ("France", Decimal("1.01"), Decimal("33.55")),
    ]
    kpis = geo_kpis(tables).first()
    assert (kpis.countries, kpis.foreign_revenue) == (2, Decimal("1.01"))
    assert kpis.home_share_pct == 100 * 2.0 / 3.01


def test_no_sales_at_all(make_tables):
    tables = make_tables(invoices=[("C1", "2011-03-06 00:10", 7, 1, True)], items=[("C1", "a", -1, "2.00")])
    assert rows(overview_kpis(tables)) == [(None, 0, 0, None)]
    assert rows(order_value_stats(tables)) == [(None, None)]
    assert rows(country_share(tables)) == []

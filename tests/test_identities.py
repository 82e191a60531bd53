"""Results that must agree with each other, on the given tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.plans import customers, markets, operations, reports, trends, views


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_revenue_is_the_same_everywhere(star):
    expected = Decimal("211835114.35")
    assert total(views.order_totals(star), "order_total") == expected
    assert total(views.monthly_revenue(star), "revenue") == expected
    assert total(views.country_revenue(star), "revenue") == expected
    assert total(views.product_performance(star), "revenue") == expected
    assert total(trends.revenue_by_hour(star), "revenue") == expected
    assert total(trends.revenue_by_weekday(star), "revenue") == expected
    assert reports.overview_kpis(star).first().revenue == expected


def test_customers_are_the_same_everywhere(star):
    buyers = views.customer_rfm(star).count()
    assert total(customers.rfm_segments(star), "customers") == buyers
    assert reports.overview_kpis(star).first().customers == buyers
    named = total(customers.one_time_vs_repeat(star), "customers")
    starts = customers.cohort_retention(star).filter("months_since_first = 0")
    assert total(starts, "active_customers") == named == 149


def test_invoices_are_the_same_everywhere(star):
    months = operations.cancellation_rate(star)
    assert total(months, "orders") + total(months, "cancellations") == 1500
    assert total(months, "cancellations") == 493
    assert total(trends.weekday_hour_orders(star), "orders") == 1500 - 493
    assert total(operations.basket_size_distribution(star), "orders") == views.order_totals(star).count()


def test_shares_add_up(star):
    assert abs(total(markets.country_share(star), "share_pct") - 100) < Decimal("0.15")

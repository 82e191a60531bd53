import itertools
from decimal import Decimal

from tallybook.functions.segments import rfm_segment
from tallybook.plans.customers import cohort_retention, one_time_vs_repeat, rfm_scores, top_customers
from tallybook.plans.reports import rfm_kpis, rfm_labelled, rfm_segment_summary, rfm_top_customers
from tallybook.plans.views import customer_rfm
from tests.conftest import rows, time_of


def expected_segment(r, f, m):
    if r >= 4 and f + m >= 8:
        return "Champions"
    if r >= 3 and f + m >= 6:
        return "Loyal"
    if r >= 4 and f + m <= 5:
        return "New / Promising"
    if r <= 2 and f + m >= 7:
        return "At Risk"
    if r <= 2 and f + m <= 4:
        return "Lost"
    return "Regular"


def test_all_segments(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r int, f int, m int")
    got = df.select("r", "f", "m", rfm_segment().alias("segment")).collect()
    assert {tuple(x)[:3]: x.segment for x in got} == {t: expected_segment(*t) for t in triples}


def test_recency_counts_from_the_last_invoice_of_all(make_tables):
    tables = make_tables(
        invoices=[
            ("1", "2011-03-01 23:59", 7, 1, False),
            ("2", "2011-03-03 00:01", 8, 1, False),
            ("C3", "2011-03-09 00:00", 7, 1, True),
            ("4", "2011-03-02 12:00", None, 1, False),
        ],
        items=[("1", "a", 2, "1.25"), ("2", "a", 1, "1.25"), ("C3", "a", -2, "1.25"), ("4", "a", 9, "1.25")],
    )
    assert sorted(rows(customer_rfm(tables))) == [(7, 8, 1, Decimal("2.50")), (8, 6, 1, Decimal("1.25"))]


def test_scores_break_ties_by_customer(make_tables):
    people = range(1, 13)
    tables = make_tables(
        invoices=[(str(p), "2011-03-01 10:00", p, 1, False) for p in people],
        items=[(str(p), "a", 1, "1.00") for p in people],
    )
    got = {r.customer_id: (r.r_score, r.f_score, r.m_score, r.rfm) for r in rfm_scores(tables).collect()}
    buckets = [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]
    assert got == {p: (b, b, b, f"{b}{b}{b}") for p, b in zip(people, buckets, strict=True)}


def test_invoice_without_lines_is_an_order_but_no_purchase(make_tables):
    tables = make_tables(
        invoices=[
            ("1", "2011-03-01 10:00", 7, 1, False),
            ("2", "2011-04-01 10:00", 7, 1, False),
            ("3", "2011-03-01 10:00", 8, 1, False),
        ],
        items=[("1", "a", 1, "1.00"), ("3", "a", 1, "3.00")],
    )
    assert sorted(rows(one_time_vs_repeat(tables))) == [("One-time", 1, Decimal("1.00")), ("Repeat", 1, Decimal("2.00"))]
    assert {c: f for c, _, f, _ in rows(customer_rfm(tables))} == {7: 1, 8: 1}


def test_cohorts_across_the_year_end(make_tables):
    tables = make_tables(
        invoices=[
            ("1", "2010-12-31 23:00", 7, 1, False),
            ("2", "2011-03-01 00:00", 7, 1, False),
            ("3", "2011-03-31 10:00", 7, 1, False),
            ("4", "2011-03-05 10:00", 8, 1, False),
            ("5", "2010-11-05 10:00", 8, 1, True),
        ],
        items=[("1", "a", 1, "1.00")],
    )
    dec, mar = time_of("2010-12-01"), time_of("2011-03-01")
    assert rows(cohort_retention(tables)) == [(dec, dec, 0, 1), (dec, mar, 3, 1), (mar, mar, 0, 1)]


def test_top_customers_take_their_main_country(make_tables):
    tables = make_tables(
        invoices=[("1", "2011-03-01 10:00", 7, 2, False), ("2", "2011-03-01 10:00", 8, 2, False)],
        items=[("1", "a", 1, "1.00"), ("2", "a", 1, "1.00"), ("2", "b", 1, "0.50")],
        customers=[(7, 1), (8, 2)],
        countries=[(1, "Here"), (2, "There")],
    )
    assert rows(top_customers(tables)) == [(8, "There", Decimal("1.50"), 1), (7, "Here", Decimal("1.00"), 1)]
    assert rows(top_customers(tables, n=1))[0][0] == 8


def test_one_rfm_run_serves_a_whole_page(star):
    labelled = rfm_labelled(star).cache()
    kpis = rfm_kpis(star, labelled).first()
    segments = rows(rfm_segment_summary(star, labelled))
    assert sum(customers for _, customers, _ in segments) == kpis.customers == labelled.count()
    top = [r.monetary for r in rfm_top_customers(star, 10, labelled).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 10
    labelled.unpersist()

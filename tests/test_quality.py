from dataclasses import replace
from decimal import Decimal

from tallybook.model import TABLE_SCHEMAS
from tallybook.plans.quality import check_constraints
from tests.conftest import time_of


def test_one_violation_of_each_kind(spark, make_tables):
    good = make_tables(
        invoices=[("1", "2011-03-06 00:10", 7, 1, False), ("2", "2011-03-06 00:10", None, 1, False)],
        items=[("1", "a", 1, "2.00"), ("2", "a", 1, "2.00")],
    )
    assert {r.violations for r in check_constraints(good).collect()} == {0}

    def frame(name, *data):
        return spark.createDataFrame(list(data), TABLE_SCHEMAS[name])

    bad = replace(
        good,
        countries=frame("countries", (1, "x" * 65), (2, "y"), (3, "y")),
        customers=frame("customers", (7, 1), (7, 1), (8, None)),
        invoices=frame(
            "invoices",
            ("1", time_of("2011-03-06 00:10"), 99, 1, False),
            ("2", None, None, 1, False),
        ),
        invoice_items=frame(
            "invoice_items",
            (1, "1", "a", 1, Decimal("-0.01")),
            (2, "1", "unknown", 1, Decimal("1.00")),
            (3, "1", "unknown", None, Decimal("1.00")),
        ),
    )
    found = {(r.table_name, r.rule): r.violations for r in check_constraints(bad).collect() if r.violations}
    assert found == {
        ("countries", "unique(name)"): 1,
        ("countries", "max_length(name, 64)"): 1,
        ("customers", "unique(customer_id)"): 1,
        ("customers", "not_null(country_id)"): 1,
        ("invoices", "exists(customer_id in customers)"): 1,
        ("invoices", "not_null(invoice_date)"): 1,
        ("invoice_items", "check(unit_price >= 0)"): 1,
        ("invoice_items", "exists(stock_code in products)"): 2,
        ("invoice_items", "not_null(quantity)"): 1,
    }


def test_every_declared_rule_is_checked(star):
    checked = check_constraints(star)
    assert checked.count() == 6 + 5 + 14 + 1 + 6

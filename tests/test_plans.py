"""Properties of the physical plans that matter on large tables."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallybook.plans import customers, products, views
from tallybook.sources.tables import write_tables


@pytest.fixture(scope="module")
def written(spark, star, tmp_path_factory):
    tables = write_tables(star, str(tmp_path_factory.mktemp("plans")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield tables
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cancellations_are_filtered_in_the_scan(written):
    plan = plan_of(views.order_totals(written))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(is_cancellation,false\)|Not\(EqualTo\(is_cancellation,true\)\)", plan)


def test_only_needed_columns_are_read(written):
    plan = plan_of(views.monthly_revenue(written))
    assert "description" not in plan and "item_id" not in plan and "stock_code" not in plan


def test_lines_are_summed_before_the_join(written):
    plan = plan_of(views.order_totals(written))
    assert plan.index("Join") < plan.index("partial_sum")
    # invoices once, sums of lines once; the join adds no shuffle of lines
    assert plan.count("Exchange hashpartitioning") == 2


def test_rfm_moves_no_customer_to_a_single_task(written):
    plan = plan_of(customers.rfm_labelled(written))
    for exchange in re.findall(r"Exchange SinglePartition.*?(?=\n\S|\Z)", plan, re.S):
        assert "_slice" in exchange or "partial" in exchange
    assert "ntile" not in plan


def test_best_sellers_are_cut_before_the_product_table(written):
    plan = plan_of(products.top_products_revenue(written))
    assert plan.index("Join") < plan.index("TakeOrderedAndProject")


def test_no_python_and_no_cartesian_product(written):
    for plan in (
        plan_of(views.product_performance(written)),
        plan_of(customers.rfm_segments(written)),
        plan_of(products.bought_together(written)),
        plan_of(products.return_rate(written)),
    ):
        assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_a_hot_invoice_is_split_in_joins_of_lines(spark, written, tmp_path):
    """Half of all lines belong to one invoice; its shuffled partition is read in parts."""
    hot = written.invoices.filter(~F.col("is_cancellation")).agg(F.min("invoice_no")).first()[0]
    moved = F.when(F.col("item_id") % 2 == 0, F.lit(hot)).otherwise(F.col("invoice_no"))
    items = written.invoice_items.withColumn("invoice_no", moved).repartition(8)
    skewed = write_tables(replace(written, invoice_items=items), str(tmp_path / "skewed"))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for plan in (views.sales_per_product, products.return_rate):
            df = plan(skewed)
            df.collect()
            final = plan_of(df)
            assert "skew=true" in final
    finally:
        for key in settings:
            spark.conf.unset(key)

"""Customer analyses: best customers, RFM, loyalty, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.aggregates import revenue, rows
from tallybook.functions.dates import month_index
from tallybook.functions.money import ratio
from tallybook.functions.segments import rfm_segment
from tallybook.model import RetailTables
from tallybook.operators.selection import score_ntiles
from tallybook.plans.views import customer_rfm, order_totals, sales_invoices

SCORES = 5


def top_customers(tables: RetailTables, n: int = 20) -> DataFrame:
    """Customers with the highest spend."""
    spend = (
        order_totals(tables)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(revenue().alias("total_spend"), rows("orders"))
    )
    # One row per customer meets the customers: a limit before could leave too few.
    return (
        spend.join(tables.customers, "customer_id")
        .join(tables.countries, "country_id")
        .select("customer_id", F.col("name").alias("country"), "total_spend", "orders")
        .orderBy(F.desc("total_spend"), "customer_id")
        .limit(n)
    )


def rfm_labelled(tables: RetailTables) -> DataFrame:
    """Every named customer with measures, scores r, f, m (5 is best) and segment.

    Equal measures are ranked by customer_id, so the scores are reproducible. Runs
    jobs while the frame is built, as do all frames made from it.
    """
    measures = {"r": ("recency_days", True), "f": ("frequency", False), "m": ("monetary", False)}
    return score_ntiles(customer_rfm(tables), SCORES, "customer_id", measures).select(
        "customer_id", "recency_days", "frequency", "monetary", "r", "f", "m", rfm_segment().alias("segment")
    )


def rfm_scores(tables: RetailTables) -> DataFrame:
    """Measures and scores of every customer. Runs jobs while the frame is built."""
    return (
        rfm_labelled(tables)
        .select(
            "customer_id",
            "recency_days",
            "frequency",
            "monetary",
            F.col("r").alias("r_score"),
            F.col("f").alias("f_score"),
            F.col("m").alias("m_score"),
            F.concat("r", "f", "m").alias("rfm"),
        )
        .orderBy(F.desc("monetary"), "customer_id")
    )


def rfm_segments(tables: RetailTables) -> DataFrame:
    """Customers and revenue of each segment. Runs jobs while the frame is built."""
    return (
        rfm_labelled(tables)
        .groupBy("segment")
        .agg(rows("customers"), revenue("monetary").alias("segment_revenue"))
        .orderBy(F.desc("segment_revenue"), "segment")
    )


def one_time_vs_repeat(tables: RetailTables) -> DataFrame:
    """Counts invoices only, so an invoice without lines is an order too."""
    per_customer = (
        sales_invoices(tables).filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(rows("_orders"))
    )
    kind = F.when(F.col("_orders") == 1, "One-time").otherwise("Repeat")
    return (
        per_customer.groupBy(kind.alias("type"))
        .agg(rows("customers"), F.sum("_orders").alias("_orders"))
        .select("type", "customers", ratio(F.col("_orders"), F.col("customers"), 2).alias("avg_orders"))
    )


def _active_months(tables: RetailTables, first: int, last: int) -> DataFrame:
    """Per named customer the months of its purchases, as offsets from the first month of all, ascending.

    While they are gathered, a customer's months are the bits of a few plain numbers, 64
    months in each, so a customer's invoices fold into one short row on the map side.
    """
    offset = month_index("invoice_date") - first
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (offset % 64).cast("int"))
    words = [
        F.bit_or(F.when(F.floor(offset / 64) == w, bit)).alias(f"_{w}") for w in range((last - first) // 64 + 1)
    ]
    named = sales_invoices(tables).filter(F.col("customer_id").isNotNull() & F.col("invoice_date").isNotNull())

    def months_of(w: int) -> Column:
        all_of_word = F.sequence(F.lit(64 * w), F.lit(min(64 * w + 63, last - first)))
        return F.filter(all_of_word, lambda m: F.coalesce(F.getbit(F.col(f"_{w}"), m % 64), F.lit(0)) == 1)

    months = [months_of(w) for w in range(len(words))]
    return named.groupBy("customer_id").agg(*words).select("customer_id", F.concat(*months).alias("months"))


def cohort_retention(tables: RetailTables) -> DataFrame:
    """Customers by month of first purchase and month of activity.

    One shuffle of a row per customer; what follows it is one row per pair of months.
    The range of months comes from the data, by a job while the frame is built.
    """
    month = month_index("invoice_date")
    first, last = sales_invoices(tables).agg(F.min(month), F.max(month)).first()
    active = _active_months(tables, first or 0, last or 0)
    pairs = active.select(F.get("months", F.lit(0)).alias("cohort"), F.explode("months").alias("active"))

    def start(offset: str) -> Column:
        return F.add_months(F.lit("0000-01-01").cast("date"), F.col(offset) + (first or 0)).cast("timestamp_ntz")

    return (
        pairs.groupBy("cohort", "active")
        .agg(rows("active_customers"))
        .select(
            start("cohort").alias("cohort_month"),
            start("active").alias("active_month"),
            (F.col("active") - F.col("cohort")).alias("months_since_first"),
            "active_customers",
        )
        .orderBy("cohort_month", "active_month")
    )

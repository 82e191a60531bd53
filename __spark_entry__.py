
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.oracle import HOME, ORACLE
from tallybook.model import RAW_COLUMNS, RetailTables
from tallybook.operators.pairs import top_pairs
from tallybook.operators.ranking import exact_percentile, global_ntile, global_row_number
from tallybook.operators.scratch import materialize, scratch_path
from tallybook.plans import clean, customers, load, markets, normalize, operations, products, quality, reports, trends, views
from tallybook.plans.results import kept_query
from tallybook.plans.sums import with_sums
from tallybook.sources import tables as store
from tallybook.sources.sales import read_sales, with_source_order
from tallybook.sources.star import star_sheet, star_tables

try:
    import corpus_pipeline
    from tallybook.llm import queries as llm
except ImportError as missing:  # the subpackage may be left out as a whole, and libraries that only it needs
    if (missing.name or "").startswith("tallybook.") and missing.name != "tallybook.llm":
        raise
    llm = corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

# In the given tables every product sells at least 66 units.
SLOW_UNITS = 300


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and whole numbers as BIGINT, as the oracle gives them."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _star(plan: Callable[..., DataFrame], **params) -> Query:
    return lambda spark, folder: _plain(plan(star_tables(spark, folder), **params))


def _sheet(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: _plain(plan(star_sheet(spark, folder)))


def _lines(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*RAW_COLUMNS, *extra)


def _cleaned(sheet: DataFrame) -> DataFrame:
    """The sheet cleaned after it is written, as a load does it.

    Cleaning asks for a column many times; each time Spark would compute it from the joins
    behind the sheet.
    """
    return clean.clean_sales(materialize(sheet, "raw"))


def _from_clean(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return _sheet(lambda sheet: plan(_cleaned(sheet)))


def _written_clean(sheet: DataFrame) -> DataFrame:
    return materialize(_cleaned(sheet), "clean")


def _with_countries(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(sheet: DataFrame) -> DataFrame:
        lines = _written_clean(sheet)
        return plan(lines, normalize.build_countries(lines))

    return _sheet(run)


# -- whole-table operators


def _numbered_lines(lines: DataFrame) -> DataFrame:
    order = [c for c in RAW_COLUMNS if c != "CustomerID"]
    return global_row_number(lines.select(*order), [F.col(c) for c in order])


def _sevenths(tables: RetailTables) -> DataFrame:
    totals = views.order_totals(tables).select("invoice_no", "order_total")
    return global_ntile(totals, 7, [F.col("order_total"), F.col("invoice_no")], "part")


def _percentiles(tables: RetailTables) -> DataFrame:
    totals = views.order_totals(tables)
    low = exact_percentile(totals, "order_total", 0.25, "p25").select(F.round("p25", 4).alias("p25"))
    return low.crossJoin(exact_percentile(totals, "order_total", 0.9, "p90"))  # one row each


def _pruned_pairs(tables: RetailTables) -> DataFrame:
    """The pair count the way it runs on large baskets: with a floor and bounds."""
    return top_pairs(products.basket_lines(tables), 25, small_basket=3, cheap_pairs_per_line=0)


# -- cleaning, step by step


def _null_as_text(sheet: DataFrame) -> DataFrame:
    country = F.when(F.col("Description").isNotNull(), F.col("Country"))
    return clean.null_as_text(clean.trim_strings(sheet.withColumn("Country", country)))


def _distinct_lines(sheet: DataFrame) -> DataFrame:
    kept = clean.drop_nonpositive_price(clean.drop_no_description(clean.trim_strings(sheet)))
    return _lines(clean.drop_duplicates(clean.cast_customer(clean.flag_cancellation(kept))), "is_cancellation")


def _set_aside(sheet: DataFrame) -> DataFrame:
    customer = F.when(F.col("UnitPrice") == 0, F.col("CustomerID") + 0.5).otherwise(F.col("CustomerID"))
    code = F.when(F.col("Description").isNotNull(), F.col("StockCode"))
    spoiled = sheet.withColumn("CustomerID", customer).withColumn("StockCode", code)
    return clean.quarantined(spoiled).select("InvoiceNo", "Quantity", "reason")


def _cleaning_report(sheet: DataFrame) -> DataFrame:
    raw = materialize(sheet, "raw")
    return load.cleaning_report(raw, materialize(clean.clean_sales(raw), "clean"))


def _load_counts(sheet: DataFrame) -> DataFrame:
    return load.load_sales(sheet, scratch_path(sheet.sparkSession, "load")).counts


def _checked_load(sheet: DataFrame) -> DataFrame:
    tables = load.load_sales(sheet, scratch_path(sheet.sparkSession, "load"), contiguous_ids=True).tables
    return quality.check_constraints(tables)


# -- rules, on tables with planted violations


def _broken_tables(spark: SparkSession, folder: str) -> RetailTables:
    star = star_tables(spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").join(
        spark.read.parquet(f"{folder}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")
    )
    number, line = F.col("o_orderkey"), F.col("l_linenumber")
    name = F.col("name")
    country = F.col("country_id")
    code = F.col("stock_code").cast("bigint")
    twice = F.explode(F.when(code % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return RetailTables(
        countries=star.countries.filter(country < 20).withColumn(
            "name", F.when(country == 3, F.repeat(name, 10)).when(country < 2, "X").otherwise(name)
        ),
        customers=star.customers.filter(F.col("customer_id") % 7 != 0).withColumn(
            "country_id", F.when(F.col("customer_id") % 10 != 0, country)
        ),
        products=star.products.filter(code % 11 != 0)
        .withColumn("copy", twice)
        .select(
            "stock_code",
            F.when(code % 17 == 0, F.repeat("description", 60)).otherwise(F.col("description")).alias("description"),
        ),
        invoices=orders.select(
            F.concat(F.when(number % 9 == 0, "0" * 20).otherwise(""), number.cast("string")).alias("invoice_no"),
            F.when(number % 6 != 0, F.col("o_orderdate")).alias("invoice_date"),
            F.when(number % 4 != 0, F.col("o_custkey")).alias("customer_id"),
            F.col("c_nationkey").alias("country_id"),
            F.when(number % 5 != 0, F.col("o_orderstatus") == "F").alias("is_cancellation"),
        ),
        invoice_items=lines.select(
            F.when(line < 6, F.col("l_orderkey")).alias("item_id"),
            F.col("l_orderkey").cast("string").alias("invoice_no"),
            F.when(line != 5, F.col("l_partkey").cast("string")).alias("stock_code"),
            F.when(line != 4, F.col("l_quantity").cast("int")).alias("quantity"),
            F.when(line == 7, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("unit_price"),
        ),
    )


def _rules(check: Callable[[RetailTables], DataFrame]) -> Query:
    return lambda spark, folder: _plain(check(_broken_tables(spark, folder)))


# -- sources and sinks


def _read_sales(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "sheet")
    writer = _lines(star_sheet(spark, folder)).write.option("header", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _plain(_lines(read_sales(spark, path, "csv")))


def _source_order(spark: SparkSession, folder: str) -> DataFrame:
    numbered = with_source_order(spark.read.parquet(f"{folder}/lineitem.parquet"), "number")
    distinct = numbered.groupBy("number").agg(F.count(F.lit(1)).alias("uses"))
    return distinct.agg(
        F.sum("uses").alias("rows"),
        F.count(F.lit(1)).alias("numbers"),
        F.min("number").alias("first"),
        F.max("number").alias("last"),
    )


# Lines of the exported sheet that cannot be loaded, by the rest of the order number by 40.
_SPOILED = {
    "Quantity": {0: "many", 2: None},
    "InvoiceDate": {1: "13/45/2011 99:00"},
    "UnitPrice": {4: "1e12"},
    "StockCode": {5: "A code of over twenty characters"},
}


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    """The sheet as a spreadsheet exports it: text with quotes and commas, US dates, some lines spoiled."""
    sheet = star_sheet(spark, folder)
    rest = F.regexp_extract("InvoiceNo", r"\d+", 0).cast("bigint") % 40
    text = {c: F.col(c).cast("string") for c in RAW_COLUMNS}
    text["Description"] = F.concat("Description", F.lit(' "A", B'))
    text["InvoiceDate"] = F.date_format("InvoiceDate", "M/d/yyyy H:mm")
    for column, values in _SPOILED.items():
        for value, bad in values.items():
            text[column] = F.when(rest == value, F.lit(bad).cast("string")).otherwise(text[column])
    path = scratch_path(spark, "export")
    writer = sheet.select(*(text[c].alias(c) for c in RAW_COLUMNS)).write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_sales(spark, path, "csv", timestamp_format="M/d/yyyy H:mm")


def _read_exported(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_lines(clean.clean_sales(_exported(spark, folder)), "is_cancellation"))


def _load_exported(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the load, set-aside rows by reason, and what narrow questions about them give."""
    raw = _exported(spark, folder)
    done = load.load_sales(raw, scratch_path(spark, "load"))
    aside = done.set_aside.groupBy(F.concat(F.lit("aside: "), "reason").alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    narrow = clean.quarantined(raw).select("InvoiceNo").agg(F.lit("aside, one column").alias("step"), F.count(F.lit(1)).alias("rows"))
    return done.counts.select("step", "rows").union(aside).union(narrow)


# Lines of a file of the sheet in many files; fewer than 24 files are not written.
_FILE_LINES = 150_000


def _split_order(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet of many files and splits, read by three tasks, or by one for eight files if they are more."""
    lines = with_source_order(spark.read.parquet(f"{folder}/lineitem.parquet"), "number")
    files = max(24, -(-lines.count() // _FILE_LINES))
    number = F.lpad(F.col("number").cast("string"), 12, "0")
    other = {"Quantity": "1", "InvoiceDate": "2011-01-05T10:00:00", "UnitPrice": "1.0"}
    sheet = lines.select(*(number.alias(c) if c == "InvoiceNo" else F.lit(other.get(c, "7")).alias(c) for c in RAW_COLUMNS))
    path = scratch_path(spark, "files")
    sheet.repartitionByRange(files, "InvoiceNo").sortWithinPartitions("InvoiceNo").write.option("header", True).csv(path)
    settings = {"spark.sql.files.maxPartitionNum": str(files // 8), "spark.sql.files.maxPartitionBytes": "20000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        read = read_sales(spark, path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    items = normalize.build_items(read)
    misplaced = F.count_if(F.col("item_id") != F.col("invoice_no").cast("bigint") + 1)
    return items.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("item_id").alias("ids"), misplaced.alias("misplaced"))


def _append_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The sheet loaded in two halves, the second one tried twice under one id."""
    sheet, target = star_sheet(spark, folder), scratch_path(spark, "load")
    odd = F.regexp_extract("InvoiceNo", r"\d+", 0).cast("bigint") % 2 == 1
    load.load_sales(sheet.filter(~odd), target, contiguous_ids=True)
    second = sheet.filter(odd)
    load.append_sales(second, target, contiguous_ids=True, load_id="second")
    tables = load.append_sales(second, target, contiguous_ids=True, load_id="second").tables
    return _row_counts(tables).union(_item_ids(tables))


def _thirds(spark: SparkSession, folder: str) -> tuple[list[DataFrame], str]:
    sheet, third = star_sheet(spark, folder), F.regexp_extract("InvoiceNo", r"\d+", 0).cast("bigint") % 3
    return [sheet.filter(third == i) for i in range(3)], scratch_path(spark, "load")


def _two_writers(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the sheet, then the others loaded by two writers at once: one is second and loads on top."""
    (first, *others), target = _thirds(spark, folder)
    load.load_sales(first, target, contiguous_ids=True)
    with ThreadPoolExecutor(2) as both:
        list(both.map(lambda sheet: load.append_sales(sheet, target, contiguous_ids=True), others))
    return _row_counts(store.read_tables(spark, target)).union(_item_ids(store.read_tables(spark, target)))


def _compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads made one, a third one after it, and the files that a scan of the tables then reads from."""
    (first, second, third), target = _thirds(spark, folder)
    load.load_sales(first, target, contiguous_ids=True)
    load.append_sales(second, target, contiguous_ids=True)
    load.compact_sales(spark, target)
    tables = load.append_sales(third, target, contiguous_ids=True).tables
    read = tables.invoices.select(F.regexp_extract(F.input_file_name(), "load=([^/]*)", 1).alias("load")).distinct()
    loads = read.agg(F.lit("loads read").alias("table_name"), F.count(F.lit(1)).alias("rows"))
    return _row_counts(tables).union(_item_ids(tables)).union(loads)


def _summed_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals after three loads that each bring lines of most invoices, from the sums of the loads."""
    sheet, target = star_sheet(spark, folder), scratch_path(spark, "load")
    parts = [sheet.filter(F.col("StockCode").cast("bigint") % 3 == i) for i in range(3)]
    load.load_sales(parts[0], target)
    for part in parts[1:]:
        load.append_sales(part, target)
    return _plain(views.order_totals(with_sums(spark, target)).select("invoice_no", "order_total", "units"))


def _item_ids(tables: RetailTables) -> DataFrame:
    ids = tables.invoice_items.agg(F.max("item_id").alias("last"), F.countDistinct("item_id").alias("distinct"))
    named = [("last item", "last"), ("distinct items", "distinct")]
    return ids.select(F.inline(F.array(*(F.struct(F.lit(n).alias("table_name"), F.col(c).alias("rows")) for n, c in named))))


def _row_counts(tables: RetailTables) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    total = counts[0]
    for count in counts[1:]:
        total = total.union(count)
    return total


def _written(spark: SparkSession, folder: str) -> tuple[RetailTables, str]:
    target = scratch_path(spark, "tables")
    return store.write_tables(star_tables(spark, folder), target), target


def _write_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _row_counts(_written(spark, folder)[0])


def _table_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(store.table_scan(spark, _written(spark, folder)[1], "invoices"))


def _reset_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _row_counts(store.reset_tables(spark, _written(spark, folder)[1]))


def _append_new_keys(spark: SparkSession, folder: str) -> DataFrame:
    star = star_tables(spark, folder)
    known = star.customers.filter(F.col("customer_id") % 2 == 0)
    moved = star.customers.withColumn("country_id", F.col("country_id") + 1)
    target = scratch_path(spark, "tables")
    store.write_tables(RetailTables(star.countries, known, star.products, star.invoices, star.invoice_items), target)
    incoming = RetailTables(star.countries, moved, star.products, star.invoices, star.invoice_items)
    return _plain(store.append_new_keys(incoming, target).customers)


def _layout(by: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        target = scratch_path(spark, by)
        prefix = "tallybook_" + target.rsplit("-", 1)[-1] + "_"
        return _plain(views.order_totals(store.write_layout(star_tables(spark, folder), prefix, target, 8, by)))

    return run


def _register_views(spark: SparkSession, folder: str) -> DataFrame:
    views.register_views(star_tables(spark, folder))
    return _plain(spark.table("v_monthly_revenue"))


def _all_views(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and a total of each view."""
    views.register_views(star_tables(spark, folder))
    amount = {"v_order_totals": "order_total", "v_customer_rfm": "monetary"}
    parts = [f"SELECT '{v}' AS view, count(*) AS rows, sum({amount.get(v, 'revenue')}) AS total FROM {v}" for v in views.VIEWS]
    return _plain(spark.sql(" UNION ALL ".join(parts)))


def _run_query(spark: SparkSession, folder: str) -> DataFrame:
    views.register_views(star_tables(spark, folder))
    sql = "SELECT country, orders, revenue FROM v_country_revenue WHERE orders >= :least"
    return _plain(views.run_query(spark, sql, {"least": 40}))


def _kept_query(spark: SparkSession, folder: str) -> DataFrame:
    """The same question twice; the second answer is the stored one."""
    target = _written(spark, folder)[1]
    sql = "SELECT country, orders, revenue FROM v_country_revenue WHERE orders >= :least"
    kept_query(spark, target, sql, {"least": 40})
    return _plain(kept_query(spark, target, sql, {"least": 40}))


def entry(spark: SparkSession) -> DataFrame:
    """Orders and revenue per month."""
    return trends.revenue_by_month(star_tables(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Query]:
    return {
        # views
        "order_totals": _star(views.order_totals),
        "monthly_revenue": _star(views.monthly_revenue),
        "country_revenue": _star(views.country_revenue),
        "product_performance": _star(views.product_performance),
        "customer_rfm": _star(views.customer_rfm),
        # customers
        "top_customers": _star(customers.top_customers),
        "rfm_scores": _star(customers.rfm_scores),
        "rfm_segments": _star(customers.rfm_segments),
        "one_time_vs_repeat": _star(customers.one_time_vs_repeat),
        "cohort_retention": _star(customers.cohort_retention),
        # products
        "top_products_revenue": _star(products.top_products_revenue),
        "top_products_units": _star(products.top_products_units),
        "slow_movers": _star(products.slow_movers, max_units=SLOW_UNITS),
        "return_rate": _star(products.return_rate),
        "bought_together": _star(products.bought_together),
        # trends
        "revenue_by_month": _star(trends.revenue_by_month),
        "revenue_by_weekday": _star(trends.revenue_by_weekday),
        "revenue_by_hour": _star(trends.revenue_by_hour),
        "weekday_hour_orders": _star(trends.weekday_hour_orders),
        "month_over_month": _star(trends.month_over_month),
        # geography
        "revenue_by_country": _star(markets.revenue_by_country),
        "top_foreign_markets": _star(markets.top_foreign_markets, home=HOME),
        "aov_by_country": _star(markets.aov_by_country),
        "country_share": _star(markets.country_share),
        # operations
        "order_value_stats": _star(operations.order_value_stats),
        "cancellation_rate": _star(operations.cancellation_rate),
        "basket_size_distribution": _star(operations.basket_size_distribution),
        "peak_hours": _star(operations.peak_hours),
        # report pages
        "overview_kpis": _star(reports.overview_kpis),
        "overview_monthly": _star(reports.overview_monthly),
        "overview_top_countries": _star(reports.overview_top_countries),
        "rfm_labelled": _star(customers.rfm_labelled),
        "rfm_kpis": _star(reports.rfm_kpis),
        "rfm_segment_summary": _star(reports.rfm_segment_summary),
        "rfm_scatter_points": _star(reports.rfm_scatter_points),
        "rfm_top_customers": _star(reports.rfm_top_customers),
        "products_top": _star(reports.products_top),
        "products_kpis": _star(reports.products_kpis),
        "products_slow": _star(reports.products_slow, hi=SLOW_UNITS),
        "geo_table": _star(reports.geo_table),
        "geo_kpis": _star(reports.geo_kpis, home=HOME),
        "geo_top_foreign": _star(reports.geo_top_foreign, home=HOME),
        "trend_mom": _star(reports.trend_mom),
        "weekday_hour_matrix": _star(reports.weekday_hour_matrix),
        "trend_cancellation": _star(reports.trend_cancellation),
        # whole-table operators
        "global_row_number": _from_clean(_numbered_lines),
        "global_ntile": _star(_sevenths),
        "exact_percentile": _star(_percentiles),
        "top_pairs": _star(_pruned_pairs),
        # cleaning
        "trim_strings": _sheet(lambda s: _lines(clean.trim_strings(s))),
        "null_as_text": _sheet(lambda s: _lines(_null_as_text(s))),
        "drop_no_description": _sheet(lambda s: _lines(clean.drop_no_description(clean.trim_strings(s)))),
        "drop_nonpositive_price": _sheet(lambda s: _lines(clean.drop_nonpositive_price(s))),
        "flag_cancellation": _sheet(lambda s: _lines(clean.flag_cancellation(clean.trim_strings(s)), "is_cancellation")),
        "cast_customer": _sheet(lambda s: _lines(clean.cast_customer(s))),
        "drop_duplicates": _sheet(_distinct_lines),
        "clean_sales": _from_clean(lambda c: _lines(c, "is_cancellation")),
        "quarantined": _sheet(_set_aside),
        "cleaning_report": _sheet(_cleaning_report),
        "load_counts": _sheet(_load_counts),
        # normalisation
        "build_countries": _from_clean(normalize.build_countries),
        "build_customers": _with_countries(normalize.build_customers),
        "build_products": _from_clean(normalize.build_products),
        "build_invoices": _with_countries(normalize.build_invoices),
        "build_items": _from_clean(lambda c: normalize.build_items(c, contiguous_ids=True)),
        "lookup_country": _with_countries(
            lambda lines, countries: normalize.lookup_country(lines.select("InvoiceNo", "Country").distinct(), countries)
        ),
        # rules
        "pk_unique": _rules(quality.pk_unique),
        "fk_exists": _rules(quality.fk_exists),
        "not_null": _rules(quality.not_null),
        "check_price": _rules(quality.check_price),
        "max_length": _rules(quality.max_length),
        "check_constraints": _sheet(_checked_load),
        # sources and sinks
        "read_sales": _read_sales,
        "read_exported_sales": _read_exported,
        "load_exported_sales": _load_exported,
        "source_order": _source_order,
        "split_order": _split_order,
        "write_tables": _write_tables,
        "table_scan": _table_scan,
        "append_new_keys": _append_new_keys,
        "append_sales": _append_sales,
        "two_writers": _two_writers,
        "compact_tables": _compacted,
        "summed_loads": _summed_loads,
        "reset_tables": _reset_tables,
        "physical_layout": _layout("bucket"),
        "range_layout": _layout("range"),
        "curve_layout": _layout("curve"),
        "register_views": _register_views,
        "all_views": _all_views,
        "run_query": _run_query,
        "kept_query": _kept_query,
        **_llm_queries(),
    }


def _llm_queries() -> dict[str, Query]:
    return {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}


def oracle_sql() -> dict[str, str]:
    return {**ORACLE, **(llm.oracle_sql() if llm else {})}

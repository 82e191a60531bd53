"""The expected result of every registered query, as SQL for another engine.

Written from the definitions, not from the Spark plans: plain joins, plain
windows, amounts as whole cents. Integer arithmetic does the rounding, so a tie
at half a cent comes out the same in both engines.
"""

from __future__ import annotations

HOME = "NATION_0"

_LINE_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)"

STAR = f"""
countries AS (SELECT n_nationkey AS country_id, n_name AS name FROM nation),
customers AS (SELECT c_custkey AS customer_id, c_nationkey AS country_id FROM customer),
products AS (SELECT CAST(p_partkey AS VARCHAR) AS stock_code, p_name AS description FROM part),
invoices AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoice_no,
         o_orderdate + to_hours(CAST(6 + o_orderkey % 15 AS INTEGER)) AS invoice_date,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS customer_id,
         c_nationkey AS country_id,
         o_orderstatus = 'F' AS is_cancellation
  FROM orders JOIN customer ON o_custkey = c_custkey),
invoice_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice_no, CAST(l_partkey AS VARCHAR) AS stock_code,
         CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(l_quantity AS INTEGER) AS quantity,
         {_LINE_CENTS} AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sales AS (
  SELECT i.*, ii.stock_code, ii.quantity, ii.quantity * ii.price AS cents
  FROM invoices i JOIN invoice_items ii USING (invoice_no) WHERE NOT i.is_cancellation),
totals AS (
  SELECT invoice_no, invoice_date, customer_id, country_id, sum(cents) AS cents, sum(quantity) AS units
  FROM sales GROUP BY ALL),
performance AS (
  SELECT stock_code, description, sum(quantity) AS units, sum(cents) AS cents
  FROM sales JOIN products USING (stock_code) GROUP BY ALL),
per_country AS (
  SELECT name AS country, count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS customers,
         sum(cents) AS cents
  FROM sales JOIN countries USING (country_id) GROUP BY name),
rfm AS (
  SELECT customer_id,
         date_diff('day', CAST(max(invoice_date) AS DATE),
                   (SELECT CAST(max(invoice_date) AS DATE) FROM invoices)) AS recency_days,
         count(*) AS frequency, sum(cents) AS cents
  FROM totals WHERE customer_id IS NOT NULL GROUP BY customer_id),
scored AS (
  SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r,
         ntile(5) OVER (ORDER BY frequency, customer_id) AS f,
         ntile(5) OVER (ORDER BY cents, customer_id) AS m
  FROM rfm),
labelled AS (
  SELECT *, CASE WHEN r >= 4 AND f + m >= 8 THEN 'Champions'
                 WHEN r >= 3 AND f + m >= 6 THEN 'Loyal'
                 WHEN r >= 4 AND f + m <= 5 THEN 'New / Promising'
                 WHEN r <= 2 AND f + m >= 7 THEN 'At Risk'
                 WHEN r <= 2 AND f + m <= 4 THEN 'Lost'
                 ELSE 'Regular' END AS segment
  FROM scored),
months AS (
  SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, count(*) AS orders, sum(cents) AS cents
  FROM totals GROUP BY 1),
growth AS (SELECT month, cents, lag(cents) OVER (ORDER BY month) AS prev FROM months),
cancels AS (
  SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month,
         count(*) FILTER (WHERE NOT is_cancellation) AS orders,
         count(*) FILTER (WHERE is_cancellation) AS cancellations
  FROM invoices GROUP BY 1)
"""

SHEET = f"""
sheet AS (
  SELECT CASE WHEN l_linenumber = 2 THEN ' ' || number || ' ' ELSE number END AS "InvoiceNo",
         lpad(CAST(l_partkey AS VARCHAR), 5, '0') AS "StockCode",
         CASE WHEN l_suppkey % 50 = 0 THEN NULL WHEN l_linenumber = 7 THEN upper(p_name)
              WHEN l_linenumber = 3 THEN '  ' || p_name || ' ' ELSE p_name END AS "Description",
         CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS INTEGER) AS "Quantity",
         o_orderdate + to_hours(CAST(6 + o_orderkey % 15 AS INTEGER))
           + to_minutes(CAST((o_orderkey * 7 + l_linenumber) % 60 AS INTEGER)) AS "InvoiceDate",
         CASE WHEN (l_orderkey + l_linenumber) % 211 = 0 THEN 0.0
              WHEN (l_orderkey + l_linenumber) % 211 = 1 THEN -1.0
              ELSE CAST({_LINE_CENTS} AS DOUBLE) / 100 END::DOUBLE AS "UnitPrice",
         CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS "CustomerID",
         n_name AS "Country", 2 * place + copy AS pos
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(500000 + l_orderkey AS VARCHAR) AS number
        FROM (SELECT *, row_number() OVER () AS place FROM lineitem), unnest(CASE WHEN l_orderkey % 100 = 3 THEN [0, 1] ELSE [0] END) AS copies(copy))
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON n_nationkey = CASE WHEN o_orderkey % 50 = 7 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END),
trimmed AS (
  SELECT trim("InvoiceNo") AS "InvoiceNo", trim("StockCode") AS "StockCode", trim("Description") AS "Description",
         "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", trim("Country") AS "Country", pos
  FROM sheet),
kept AS (
  SELECT *, "InvoiceNo" LIKE 'C%' AS is_cancellation FROM trimmed
  WHERE "Description" IS NOT NULL AND "Description" <> 'nan' AND "UnitPrice" > 0),
clean AS (SELECT DISTINCT * EXCLUDE (pos) FROM kept),
s_countries AS (
  SELECT row_number() OVER (ORDER BY name) AS country_id, name FROM (SELECT DISTINCT "Country" AS name FROM clean)),
s_customers AS (
  SELECT CAST("CustomerID" AS BIGINT) AS customer_id, country_id
  FROM (SELECT "CustomerID", "Country",
               row_number() OVER (PARTITION BY "CustomerID" ORDER BY count(*) DESC, "Country") AS place
        FROM clean WHERE "CustomerID" IS NOT NULL GROUP BY "CustomerID", "Country")
  JOIN s_countries ON name = "Country" WHERE place = 1),
s_products AS (
  SELECT "StockCode" AS stock_code, substr("Description", 1, 255) AS description
  FROM (SELECT "StockCode", "Description",
               row_number() OVER (PARTITION BY "StockCode" ORDER BY count(*) DESC, "Description") AS place
        FROM clean GROUP BY "StockCode", "Description") WHERE place = 1),
s_invoices AS (
  SELECT "InvoiceNo" AS invoice_no, min("InvoiceDate") AS invoice_date,
         CAST(min("CustomerID") AS BIGINT) AS customer_id, min(country_id) AS country_id,
         bool_or(is_cancellation) AS is_cancellation
  FROM clean JOIN s_countries ON name = "Country" GROUP BY 1)
"""

#: Tables with planted violations of every rule.
BROKEN = f"""
countries AS (
  SELECT n_nationkey AS country_id, CASE WHEN n_nationkey = 3 THEN repeat(n_name, 10) WHEN n_nationkey < 2 THEN 'X'
         ELSE n_name END AS name
  FROM nation WHERE n_nationkey < 20),
customers AS (
  SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS country_id
  FROM customer WHERE c_custkey % 7 <> 0),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS stock_code,
         CASE WHEN p_partkey % 17 = 0 THEN repeat(p_name, 60) ELSE p_name END AS description
  FROM part, unnest(CASE WHEN p_partkey % 13 = 0 THEN [0, 1] ELSE [0] END) AS copies(copy) WHERE p_partkey % 11 <> 0),
invoices AS (
  SELECT CASE WHEN o_orderkey % 9 = 0 THEN repeat('0', 20) ELSE '' END || CAST(o_orderkey AS VARCHAR) AS invoice_no,
         CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS invoice_date,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS customer_id, c_nationkey AS country_id,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus = 'F' END AS is_cancellation
  FROM orders JOIN customer ON o_custkey = c_custkey),
invoice_items AS (
  SELECT CASE WHEN l_linenumber < 6 THEN l_orderkey END AS item_id, CAST(l_orderkey AS VARCHAR) AS invoice_no,
         CASE WHEN l_linenumber <> 5 THEN CAST(l_partkey AS VARCHAR) END AS stock_code,
         CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS INTEGER) END AS quantity,
         CASE WHEN l_linenumber = 7 THEN -l_extendedprice ELSE l_extendedprice END AS unit_price
  FROM lineitem)
"""


def money(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


def rounded(part: str, whole: str, factor: int) -> str:
    """factor * part / whole, rounded half away from zero to whole hundredths."""
    p, w = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    units = f"({2 * factor} * abs({p}) + {w}) // (2 * {w})"
    return f"CAST(sign({part}) * ({units}) AS DOUBLE) / 100"


def percent(part: str, whole: str) -> str:
    return rounded(part, whole, 10000)


def _star(select: str) -> str:
    return f"WITH {STAR} {select}"


def _sheet(select: str) -> str:
    return f"WITH {SHEET} {select}"


def _big(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


_PERF = f"stock_code, description, CAST(units AS BIGINT) AS units_sold, {money('cents')} AS revenue"
_COUNTRY = f"country, {_big('orders', 'customers')}, {money('cents')} AS revenue"
_RFM = f"customer_id, {_big('recency_days', 'frequency')}, {money('cents')} AS monetary"
_HOUR = f"""SELECT CAST(hour(invoice_date) AS BIGINT) AS hour, count(*) AS orders, {money('sum(cents)')} AS revenue
  FROM totals GROUP BY 1"""
_PAIRS = """SELECT a.stock_code AS a, b.stock_code AS b, count(*) AS pair_count
  FROM sales a JOIN sales b ON a.invoice_no = b.invoice_no AND a.stock_code < b.stock_code
  GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25"""


def _percentile(q: str) -> str:
    return f"""SELECT (SELECT {money('cents')} FROM ranked WHERE n = floor((total - 1) * {q}))
      * (1 - ((total - 1) * {q} - floor((total - 1) * {q})))
    + (SELECT {money('cents')} FROM ranked WHERE n = ceil((total - 1) * {q}))
      * ((total - 1) * {q} - floor((total - 1) * {q}))"""


_SHEET_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]


def _lines(table: str, where: str = "true", **replaced: str) -> str:
    picked = [f'{replaced[c]} AS "{c}"' if c in replaced else f'"{c}"' for c in _SHEET_COLUMNS]
    extra = [f'{sql} AS "{name}"' for name, sql in replaced.items() if name not in _SHEET_COLUMNS]
    return _sheet(f"SELECT {', '.join(picked + extra)} FROM {table} WHERE {where}")


_INT_CUSTOMER = 'CAST("CustomerID" AS BIGINT)'
_CLEAN = _lines("clean", CustomerID=_INT_CUSTOMER, is_cancellation="is_cancellation")

_STEPS = """
  SELECT 1 AS step_no, 'raw' AS step, (SELECT count(*) FROM sheet) AS rows
  UNION ALL SELECT 2, 'quarantined', 0
  UNION ALL SELECT 3, 'before duplicate removal', (SELECT count(*) FROM kept)
  UNION ALL SELECT 4, 'duplicates removed', (SELECT count(*) FROM kept) - (SELECT count(*) FROM clean)
  UNION ALL SELECT 5, 'clean', (SELECT count(*) FROM clean)
  UNION ALL SELECT 6, 'countries', (SELECT count(*) FROM s_countries)
  UNION ALL SELECT 7, 'customers', (SELECT count(*) FROM s_customers)
  UNION ALL SELECT 8, 'products', (SELECT count(*) FROM s_products)
  UNION ALL SELECT 9, 'invoices', (SELECT count(*) FROM s_invoices)
  UNION ALL SELECT 10, 'invoice_items', (SELECT count(*) FROM clean)"""
# The sheet as exported, with lines that cannot be loaded.
_EXPORT = """, exported AS (
  SELECT * REPLACE (trim("InvoiceNo") AS "InvoiceNo", trim("Description" || ' "A", B') AS "Description"),
         CAST(regexp_extract("InvoiceNo", '[0-9]+') AS BIGINT) % 40 AS rest FROM sheet),
reasons AS (
  SELECT CASE rest WHEN 0 THEN 'unreadable line' WHEN 1 THEN 'unreadable line' WHEN 2 THEN 'missing quantity'
              WHEN 4 THEN 'price out of range' WHEN 5 THEN 'key too long' END AS reason FROM exported),
e_kept AS (
  SELECT * EXCLUDE (pos, rest), "InvoiceNo" LIKE 'C%' AS is_cancellation FROM exported
  WHERE rest NOT IN (0, 1, 2, 4, 5) AND "Description" IS NOT NULL AND "UnitPrice" > 0),
e_clean AS (SELECT DISTINCT * FROM e_kept)
"""
_EXPORT_STEPS = """
  SELECT 'raw' AS step, (SELECT count(*) FROM exported) AS rows
  UNION ALL SELECT 'quarantined', (SELECT count(reason) FROM reasons)
  UNION ALL SELECT 'before duplicate removal', (SELECT count(*) FROM e_kept)
  UNION ALL SELECT 'duplicates removed', (SELECT count(*) FROM e_kept) - (SELECT count(*) FROM e_clean)
  UNION ALL SELECT 'clean', (SELECT count(*) FROM e_clean)
  UNION ALL SELECT 'countries', (SELECT count(DISTINCT "Country") FROM e_clean)
  UNION ALL SELECT 'customers', (SELECT count(DISTINCT "CustomerID") FROM e_clean)
  UNION ALL SELECT 'products', (SELECT count(DISTINCT "StockCode") FROM e_clean)
  UNION ALL SELECT 'invoices', (SELECT count(DISTINCT "InvoiceNo") FROM e_clean)
  UNION ALL SELECT 'invoice_items', (SELECT count(*) FROM e_clean)
  UNION ALL SELECT 'aside: ' || reason, count(*) FROM reasons WHERE reason IS NOT NULL GROUP BY reason
  UNION ALL SELECT 'aside, one column', (SELECT count(reason) FROM reasons)"""
_REPORT = """
  SELECT 1 AS step_no, 'rows in the source' AS step, (SELECT count(*) FROM sheet) AS rows
  UNION ALL SELECT 2, 'set aside', 0
  UNION ALL SELECT 3, 'no description, or a price of zero or less',
                   (SELECT count(*) FROM sheet) - (SELECT count(*) FROM kept)
  UNION ALL SELECT 4, 'exact duplicates', (SELECT count(*) FROM kept) - (SELECT count(*) FROM clean)
  UNION ALL SELECT 5, 'loaded', (SELECT count(*) FROM clean)"""

_UNIQUE = [("countries", "country_id"), ("customers", "customer_id"), ("products", "stock_code"),
           ("invoices", "invoice_no"), ("invoice_items", "item_id"), ("countries", "name")]
_REFERENCES = [("customers", "country_id", "countries", "country_id"), ("invoices", "customer_id", "customers", "customer_id"),
               ("invoices", "country_id", "countries", "country_id"), ("invoice_items", "invoice_no", "invoices", "invoice_no"),
               ("invoice_items", "stock_code", "products", "stock_code")]
_REQUIRED = [("countries", "country_id"), ("countries", "name"), ("customers", "customer_id"), ("customers", "country_id"),
             ("products", "stock_code"), ("invoices", "invoice_no"), ("invoices", "invoice_date"), ("invoices", "country_id"),
             ("invoices", "is_cancellation"), ("invoice_items", "item_id"), ("invoice_items", "invoice_no"),
             ("invoice_items", "stock_code"), ("invoice_items", "quantity"), ("invoice_items", "unit_price")]
_LENGTHS = [("countries", "name", 64), ("products", "stock_code", 20), ("products", "description", 255),
            ("invoices", "invoice_no", 20), ("invoice_items", "invoice_no", 20), ("invoice_items", "stock_code", 20)]


def _rule(table: str, rule: str, count: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(({count}) AS BIGINT) AS violations"


def _rows_where(table: str, condition: str) -> str:
    return f"SELECT count(*) FROM {table} t WHERE {condition}"


_RULES = {
    "pk_unique": [
        _rule(t, f"unique({c})", f"SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
        for t, c in _UNIQUE
    ],
    "fk_exists": [
        _rule(t, f"exists({c} in {to})", _rows_where(t, f"t.{c} IS NOT NULL AND t.{c} NOT IN (SELECT {k} FROM {to} WHERE {k} IS NOT NULL)"))
        for t, c, to, k in _REFERENCES
    ],
    "not_null": [_rule(t, f"not_null({c})", _rows_where(t, f"{c} IS NULL")) for t, c in _REQUIRED],
    "check_price": [_rule("invoice_items", "check(unit_price >= 0)", _rows_where("invoice_items", "unit_price < 0"))],
    "max_length": [_rule(t, f"max_length({c}, {n})", _rows_where(t, f"length({c}) > {n}")) for t, c, n in _LENGTHS],
}
_ALL_RULES = " UNION ALL ".join(r for rules in _RULES.values() for r in rules)
_CLEAN_TABLES = """, countries AS (SELECT * FROM s_countries), customers AS (SELECT * FROM s_customers),
products AS (SELECT * FROM s_products), invoices AS (SELECT * FROM s_invoices),
invoice_items AS (
  SELECT row_number() OVER () AS item_id, "InvoiceNo" AS invoice_no, "StockCode" AS stock_code,
         "Quantity" AS quantity, "UnitPrice" AS unit_price FROM clean)"""

_TABLE_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {{}} AS rows FROM {t}" for t in ("countries", "customers", "products", "invoices", "invoice_items")
)

_MATRIX = ", ".join(f"CAST(max(orders) FILTER (WHERE hour = {h}) AS BIGINT) AS h{h}" for h in range(24))
_WEEK = "(VALUES (1,'Mon'),(2,'Tue'),(3,'Wed'),(4,'Thu'),(5,'Fri'),(6,'Sat'),(7,'Sun')) AS week(dow, day)"
_HEAT = """SELECT CAST(isodow(invoice_date) AS BIGINT) AS dow, CAST(hour(invoice_date) AS BIGINT) AS hour, count(*) AS orders
  FROM invoices WHERE NOT is_cancellation GROUP BY 1, 2"""

_LOADED = " UNION ALL ".join([
    *(f"SELECT '{t}' AS table_name, count(*) AS rows FROM s_{t}" for t in ("countries", "customers", "products", "invoices")),
    *(f"SELECT '{t}', count(*) FROM clean" for t in ("invoice_items", "last item", "distinct items"))])

ORACLE: dict[str, str] = {
    # views
    "order_totals": _star(f"SELECT invoice_no, invoice_date, customer_id, {_big('country_id')}, {money('cents')} AS order_total, {_big('units')} FROM totals"),
    "monthly_revenue": _star(f"SELECT month, orders, {money('cents')} AS revenue FROM months"),
    "country_revenue": _star(f"SELECT {_COUNTRY} FROM per_country"),
    "product_performance": _star(f"SELECT {_PERF} FROM performance"),
    "customer_rfm": _star(f"SELECT {_RFM} FROM rfm"),
    # customers
    "top_customers": _star(f"""SELECT t.customer_id, name AS country, {money('sum(cents)')} AS total_spend, count(*) AS orders
      FROM totals t JOIN customers c ON t.customer_id = c.customer_id JOIN countries co ON c.country_id = co.country_id
      GROUP BY 1, 2 ORDER BY sum(cents) DESC, 1 LIMIT 20"""),
    "rfm_scores": _star(f"SELECT {_RFM}, {_big('r', 'f', 'm').replace('AS r', 'AS r_score').replace('AS f', 'AS f_score').replace('AS m', 'AS m_score')}, concat(r, f, m) AS rfm FROM scored"),
    "rfm_segments": _star(f"SELECT segment, count(*) AS customers, {money('sum(cents)')} AS segment_revenue FROM labelled GROUP BY 1"),
    "one_time_vs_repeat": _star(f"""SELECT CASE WHEN n = 1 THEN 'One-time' ELSE 'Repeat' END AS type, count(*) AS customers,
        {rounded('sum(n)', 'count(*)', 100)} AS avg_orders
      FROM (SELECT customer_id, count(DISTINCT invoice_no) AS n FROM invoices
            WHERE NOT is_cancellation AND customer_id IS NOT NULL GROUP BY 1) GROUP BY 1"""),
    "cohort_retention": _star("""SELECT CAST(cohort AS TIMESTAMP) AS cohort_month, CAST(active AS TIMESTAMP) AS active_month,
        CAST((year(active) - year(cohort)) * 12 + month(active) - month(cohort) AS BIGINT) AS months_since_first,
        count(DISTINCT customer_id) AS active_customers
      FROM (SELECT customer_id, date_trunc('month', min(invoice_date)) AS cohort FROM invoices
            WHERE NOT is_cancellation AND customer_id IS NOT NULL GROUP BY 1)
      JOIN (SELECT customer_id, date_trunc('month', invoice_date) AS active FROM invoices WHERE NOT is_cancellation)
      USING (customer_id) GROUP BY ALL"""),
    # products
    "top_products_revenue": _star(f"SELECT {_PERF} FROM performance ORDER BY cents DESC, stock_code LIMIT 20"),
    "top_products_units": _star("SELECT stock_code, description, CAST(units AS BIGINT) AS units_sold FROM performance ORDER BY units DESC, stock_code LIMIT 20"),
    "slow_movers": _star("""SELECT stock_code, description, CAST(sum(quantity) AS BIGINT) AS units_sold, count(DISTINCT invoice_no) AS appearances
      FROM sales JOIN products USING (stock_code) GROUP BY 1, 2 HAVING sum(quantity) < 300 ORDER BY 3, 1 LIMIT 30"""),
    "return_rate": _star(f"""SELECT stock_code, description, CAST(sold AS BIGINT) AS sold, CAST(coalesce(back, 0) AS BIGINT) AS returned,
        {percent('coalesce(back, 0)', 'sold')} AS return_rate_pct
      FROM (SELECT stock_code, sum(quantity) AS sold FROM sales GROUP BY 1)
      LEFT JOIN (SELECT stock_code, sum(abs(quantity)) AS back FROM invoice_items JOIN invoices USING (invoice_no)
                 WHERE is_cancellation GROUP BY 1) USING (stock_code)
      JOIN products USING (stock_code) WHERE sold >= 50 ORDER BY 5 DESC NULLS LAST, 1 LIMIT 20"""),
    "bought_together": _star(f"""SELECT a AS product_a, b AS product_b, pa.description AS desc_a, pb.description AS desc_b, pair_count
      FROM ({_PAIRS}) JOIN products pa ON pa.stock_code = a JOIN products pb ON pb.stock_code = b"""),
    # trends
    "revenue_by_month": _star(f"SELECT month, orders, {money('cents')} AS revenue FROM months"),
    "revenue_by_weekday": _star(f"""SELECT dayname(invoice_date) AS day_name, CAST(isodow(invoice_date) AS BIGINT) AS dow,
        count(*) AS orders, {money('sum(cents)')} AS revenue FROM totals GROUP BY 1, 2"""),
    "revenue_by_hour": _star(_HOUR),
    "weekday_hour_orders": _star(_HEAT),
    "month_over_month": _star(f"SELECT month, {money('cents')} AS revenue, {money('prev')} AS prev_month, {percent('(cents - prev)', 'prev')} AS mom_growth_pct FROM growth"),
    # geography
    "revenue_by_country": _star(f"SELECT {_COUNTRY} FROM per_country"),
    "top_foreign_markets": _star(f"SELECT country, customers, {money('cents')} AS revenue FROM per_country WHERE country <> '{HOME}' ORDER BY cents DESC, country LIMIT 15"),
    "aov_by_country": _star(f"SELECT country, orders, {rounded('cents', 'orders', 1)} AS avg_order_value FROM per_country WHERE orders >= 20 ORDER BY orders DESC, country LIMIT 15"),
    "country_share": _star(f"SELECT country, {money('cents')} AS revenue, {percent('cents', 'total')} AS share_pct FROM (SELECT *, sum(cents) OVER () AS total FROM per_country)"),
    # operations
    "order_value_stats": _star(f"""SELECT {rounded('sum(cents)', 'count(*)', 1)} AS avg_order_value,
        {rounded('sum(cents) FILTER (WHERE n IN ((total - 1) // 2, total // 2))', 'count(*) FILTER (WHERE n IN ((total - 1) // 2, total // 2))', 1)} AS median_order_value
      FROM (SELECT cents, row_number() OVER (ORDER BY cents) - 1 AS n, count(*) OVER () AS total FROM totals)"""),
    "cancellation_rate": _star(f"SELECT *, {percent('cancellations', '(orders + cancellations)')} AS cancellation_rate_pct FROM cancels"),
    "basket_size_distribution": _star("SELECT n AS items_per_order, count(*) AS orders FROM (SELECT invoice_no, count(*) AS n FROM sales GROUP BY 1) GROUP BY 1"),
    "peak_hours": _star(f"{_HOUR} ORDER BY 3 DESC, 1 LIMIT 5"),
    # report pages
    "overview_kpis": _star(f"SELECT {money('sum(cents)')} AS revenue, count(*) AS orders, count(DISTINCT customer_id) AS customers, {money('sum(cents)')} / count(*) AS aov FROM totals"),
    "overview_monthly": _star(f"SELECT month, orders, {money('cents')} AS revenue FROM months"),
    "overview_top_countries": _star(f"SELECT country, {money('cents')} AS revenue FROM per_country ORDER BY cents DESC, country LIMIT 5"),
    "rfm_labelled": _star(f"SELECT {_RFM}, {_big('r', 'f', 'm')}, segment FROM labelled"),
    "rfm_kpis": _star(f"SELECT count(*) AS customers, CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency_days, {money('sum(cents)')} / count(*) AS avg_spend FROM rfm"),
    "rfm_segment_summary": _star(f"SELECT segment, count(*) AS customers, round_even({money('sum(cents)')}, 0) AS revenue FROM labelled GROUP BY 1"),
    "rfm_scatter_points": _star(f"SELECT {_RFM}, segment FROM labelled"),
    "rfm_top_customers": _star(f"SELECT {_RFM}, segment FROM labelled ORDER BY cents DESC, customer_id LIMIT 10"),
    "products_top": _star(f"SELECT {_PERF} FROM performance ORDER BY cents DESC, stock_code LIMIT 20"),
    "products_kpis": _star(f"SELECT count(*) AS products_sold, {money('max(cents)')} AS top_product_revenue FROM performance"),
    "products_slow": _star(f"SELECT {_PERF} FROM performance WHERE units > 0 AND units < 300 ORDER BY units, stock_code LIMIT 25"),
    "geo_table": _star(f"SELECT {_COUNTRY} FROM per_country"),
    "geo_kpis": _star(f"""SELECT count(*) AS countries,
        100 * ({money(f"sum(cents) FILTER (WHERE country = '{HOME}')")}) / ({money('sum(cents)')}) AS home_share_pct,
        {money(f"sum(cents) FILTER (WHERE country <> '{HOME}')")} AS foreign_revenue FROM per_country"""),
    "geo_top_foreign": _star(f"SELECT {_COUNTRY} FROM per_country WHERE country <> '{HOME}' ORDER BY cents DESC, country LIMIT 15"),
    "trend_mom": _star(f"""SELECT month, {money('cents')} AS revenue, {money('prev')} AS prev_month,
        100 * ({money('cents')} - {money('prev')}) / ({money('prev')}) AS mom_growth_pct FROM growth WHERE prev IS NOT NULL"""),
    "weekday_hour_matrix": _star(f"SELECT day, {_MATRIX} FROM {_WEEK} LEFT JOIN ({_HEAT}) USING (dow) GROUP BY day"),
    "trend_cancellation": _star("SELECT month, cancellations, orders, 100 * CAST(cancellations AS DOUBLE) / (orders + cancellations) AS rate_pct FROM cancels"),
    # whole-table operators
    "global_row_number": _sheet(f"""SELECT row_number() OVER (ORDER BY {', '.join(f'"{c}"' for c in _SHEET_COLUMNS if c != 'CustomerID')}) AS row_number,
        {', '.join(f'"{c}"' for c in _SHEET_COLUMNS if c != 'CustomerID')} FROM clean"""),
    "global_ntile": _star(f"SELECT invoice_no, {money('cents')} AS order_total, ntile(7) OVER (ORDER BY cents, invoice_no) AS part FROM totals"),
    "exact_percentile": _star(f""", ranked AS (SELECT cents, row_number() OVER (ORDER BY cents) - 1 AS n FROM totals)
      SELECT round(({_percentile('0.25')}), 4) AS p25, ({_percentile('0.9')}) AS p90 FROM (SELECT count(*) AS total FROM totals)"""),
    "top_pairs": _star(_PAIRS),
    # cleaning
    "trim_strings": _lines("trimmed"),
    "null_as_text": _lines("trimmed", Country="""CASE WHEN "Description" IS NULL THEN 'nan' ELSE "Country" END"""),
    "drop_no_description": _lines("trimmed", """"Description" IS NOT NULL AND "Description" <> 'nan'"""),
    "drop_nonpositive_price": _lines("sheet", '"UnitPrice" > 0'),
    "flag_cancellation": _lines("trimmed", is_cancellation="\"InvoiceNo\" LIKE 'C%'"),
    "cast_customer": _lines("sheet", CustomerID=_INT_CUSTOMER),
    "drop_duplicates": _CLEAN,
    "clean_sales": _CLEAN,
    "quarantined": _sheet("""SELECT "InvoiceNo", "Quantity", CASE WHEN "UnitPrice" = 0 AND "CustomerID" IS NOT NULL
        THEN 'fractional customer' ELSE 'missing key' END AS reason
      FROM sheet WHERE ("UnitPrice" = 0 AND "CustomerID" IS NOT NULL) OR "Description" IS NULL"""),
    "cleaning_report": _sheet(_REPORT),
    "load_counts": _sheet(_STEPS),
    # normalisation
    "build_countries": _sheet("SELECT country_id, name FROM s_countries"),
    "build_customers": _sheet("SELECT customer_id, country_id FROM s_customers"),
    "build_products": _sheet("SELECT stock_code, description FROM s_products"),
    "build_invoices": _sheet("SELECT * FROM s_invoices"),
    "build_items": _sheet("""SELECT row_number() OVER (ORDER BY min(pos)) AS item_id, "InvoiceNo" AS invoice_no,
        "StockCode" AS stock_code, CAST("Quantity" AS BIGINT) AS quantity, "UnitPrice" AS unit_price
      FROM kept GROUP BY "InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"
      """),
    "lookup_country": _sheet("""SELECT DISTINCT "InvoiceNo", country_id FROM clean JOIN s_countries ON name = "Country" """),
    # rules
    **{name: f"WITH {BROKEN} {' UNION ALL '.join(rules)}" for name, rules in _RULES.items()},
    "check_constraints": f"WITH {SHEET} {_CLEAN_TABLES} {_ALL_RULES}",
    # sources and sinks
    "read_sales": _lines("sheet"),
    "read_exported_sales": _sheet(f"""{_EXPORT} SELECT * REPLACE ({_INT_CUSTOMER} AS "CustomerID",
        CAST("Quantity" AS BIGINT) AS "Quantity") FROM e_clean"""),
    "load_exported_sales": _sheet(_EXPORT + _EXPORT_STEPS),
    "split_order": "SELECT count(*) AS rows, count(*) AS ids, 0 AS misplaced FROM lineitem",
    "source_order": "SELECT count(*) AS rows, count(*) AS numbers, 0 AS first, count(*) - 1 AS last FROM lineitem",
    "write_tables": _star(_TABLE_ROWS.replace("{}", "count(*)")),
    "table_scan": _star(f"SELECT invoice_no, invoice_date, customer_id, {_big('country_id')}, is_cancellation FROM invoices"),
    "append_new_keys": _star("SELECT customer_id, CAST(CASE WHEN customer_id % 2 = 0 THEN country_id ELSE country_id + 1 END AS BIGINT) AS country_id FROM customers"),
    "append_sales": _sheet(_LOADED),
    "two_writers": _sheet(_LOADED),
    "compact_tables": _sheet(f"{_LOADED} UNION ALL SELECT 'loads read', 2"),
    "summed_loads": _sheet(f"""SELECT "InvoiceNo" AS invoice_no, {money('sum("Quantity" * CAST(round("UnitPrice" * 100) AS BIGINT))')}
        AS order_total, CAST(sum("Quantity") AS BIGINT) AS units
      FROM clean WHERE NOT starts_with("InvoiceNo", 'C') GROUP BY 1"""),
    "reset_tables": _star(_TABLE_ROWS.replace("{}", "count(*) FILTER (WHERE false)")),
    "physical_layout": _star(f"SELECT invoice_no, invoice_date, customer_id, {_big('country_id')}, {money('cents')} AS order_total, {_big('units')} FROM totals"),
    "range_layout": _star(f"SELECT invoice_no, invoice_date, customer_id, {_big('country_id')}, {money('cents')} AS order_total, {_big('units')} FROM totals"),
    "curve_layout": _star(f"SELECT invoice_no, invoice_date, customer_id, {_big('country_id')}, {money('cents')} AS order_total, {_big('units')} FROM totals"),
    "all_views": _star(" UNION ALL ".join(
        f"SELECT '{view}' AS view, count(*) AS rows, {money('sum(cents)')} AS total FROM {cte}" for view, cte in (
            ("v_order_totals", "totals"), ("v_monthly_revenue", "months"), ("v_country_revenue", "per_country"),
            ("v_product_performance", "performance"), ("v_customer_rfm", "rfm")))),
    "register_views": _star(f"SELECT month, orders, {money('cents')} AS revenue FROM months"),
    "kept_query": _star(f"SELECT country, orders, {money('cents')} AS revenue FROM per_country WHERE orders >= 40"),
    "run_query": _star(f"SELECT country, orders, {money('cents')} AS revenue FROM per_country WHERE orders >= 40"),
}

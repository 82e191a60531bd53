"""Key, reference and value rules, checked as jobs: (table_name, rule, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.model import PRIMARY_KEYS, RetailTables
from tallybook.sources.tables import known_among

UNIQUE_KEYS = [*PRIMARY_KEYS.items(), ("countries", "name")]
NOT_NULL = {
    "countries": ["country_id", "name"],
    "customers": ["customer_id", "country_id"],
    "products": ["stock_code"],
    "invoices": ["invoice_no", "invoice_date", "country_id", "is_cancellation"],
    "invoice_items": ["item_id", "invoice_no", "stock_code", "quantity", "unit_price"],
}
# (table, column, table it points to, key there)
FOREIGN_KEYS = [
    ("customers", "country_id", "countries", "country_id"),
    ("invoices", "customer_id", "customers", "customer_id"),
    ("invoices", "country_id", "countries", "country_id"),
    ("invoice_items", "invoice_no", "invoices", "invoice_no"),
    ("invoice_items", "stock_code", "products", "stock_code"),
]
# Longest text a column may hold.
MAX_LENGTH = {
    "countries": {"name": 64},
    "products": {"stock_code": 20, "description": 255},
    "invoices": {"invoice_no": 20},
    "invoice_items": {"invoice_no": 20, "stock_code": 20},
}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def _key_uses(tables: RetailTables, sources: list[tuple[str, str]]) -> DataFrame:
    """One row per value of a key: how often it occurs in each of the columns.

    The rows of all columns are counted in one aggregation; the counts fold on the map side, so a key that a large part of all
    rows point to is one row per task in the shuffle.
    """
    rows = [
        getattr(tables, t).select(F.col(c).alias("_key"), *(F.lit(int(j == i)).alias(f"_{j}") for j in range(len(sources))))
        for i, (t, c) in enumerate(sources)
    ]
    used = _union(rows).filter(F.col("_key").isNotNull()).groupBy("_key")
    return used.agg(*(F.sum(f"_{j}").alias(f"_{j}") for j in range(len(sources))))


def _pointing_to(table: str, key: str) -> list[tuple[str, str]]:
    return [(t, c) for t, c, to, k in FOREIGN_KEYS if (to, k) == (table, key)]


def _key_rules(tables: RetailTables, table: str, key: str, unique: bool, exists: bool) -> DataFrame:
    """Violations of the rules about one key, from one aggregation.

    Unique: how many values occur more than once. Exists: how many rows point to a
    value that is not there; a null points nowhere and passes.
    """
    rules, sources = {}, [(table, key)]
    if unique:
        rules[(table, f"unique({key})")] = F.count_if(F.col("_0") > 1)
    if exists:
        sources += _pointing_to(table, key)
        for j, (t, c) in enumerate(_pointing_to(table, key), 1):
            missing = F.sum(F.when(F.col("_0") == 0, F.col(f"_{j}")).otherwise(0))
            rules[(t, f"exists({c} in {table})")] = F.coalesce(missing, F.lit(0))
    counted = _key_uses(tables, sources).agg(*(v.alias(f"v{i}") for i, v in enumerate(rules.values())))
    entries = [
        F.struct(F.lit(t).alias("table_name"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
        for i, (t, rule) in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*entries)))


def _row_rules(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rules on single rows, all in one pass over the table."""
    counted = df.agg(*[F.count_if(broken).alias(f"_{i}") for i, broken in enumerate(rules.values())])
    entries = [F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations")) for i, rule in enumerate(rules)]
    return counted.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


def pk_unique(tables: RetailTables) -> DataFrame:
    return _union([_key_rules(tables, t, key, unique=True, exists=False) for t, key in UNIQUE_KEYS])


def fk_exists(tables: RetailTables) -> DataFrame:
    targets = dict.fromkeys((to, key) for _, _, to, key in FOREIGN_KEYS)
    return _union([_key_rules(tables, to, key, unique=False, exists=True) for to, key in targets])


def _null_rules(table: str) -> dict[str, Column]:
    return {f"not_null({c})": F.col(c).isNull() for c in NOT_NULL.get(table, [])}


def _length_rules(table: str) -> dict[str, Column]:
    return {f"max_length({c}, {n})": F.char_length(c) > n for c, n in MAX_LENGTH.get(table, {}).items()}


def _price_rules(table: str) -> dict[str, Column]:
    return {"check(unit_price >= 0)": F.col("unit_price") < 0} if table == "invoice_items" else {}


def _row_checks(tables: RetailTables, *makers) -> DataFrame:
    checks = []
    for table, df in tables.items():
        rules = {rule: broken for make in makers for rule, broken in make(table).items()}
        if rules:
            checks.append(_row_rules(df, table, rules))
    return _union(checks)


def not_null(tables: RetailTables) -> DataFrame:
    return _row_checks(tables, _null_rules)


def check_price(tables: RetailTables) -> DataFrame:
    return _row_checks(tables, _price_rules)


def max_length(tables: RetailTables) -> DataFrame:
    return _row_checks(tables, _length_rules)


def row_violations(tables: RetailTables) -> DataFrame:
    """The rules on single rows, in one pass over each table."""
    return _row_checks(tables, _null_rules, _price_rules, _length_rules)


def check_constraints(tables: RetailTables) -> DataFrame:
    """Every rule; a clean load has zero violations everywhere.

    A key's uniqueness and the references to it share one aggregation.
    """
    keys = [_key_rules(tables, t, key, unique=True, exists=True) for t, key in UNIQUE_KEYS]
    return _union([*keys, row_violations(tables)])


def added_violations(added: RetailTables, known: dict[str, DataFrame]) -> DataFrame:
    """The rules about keys for rows that are added to existing tables.

    ``known`` holds the keys (column ``key``) of each table that others point to, as they
    are before. Unique: how many added keys occur twice or are known. Exists: how many
    different values of added rows point to nothing that is known or added. Only the keys
    of the added rows are shuffled; what is known is read past them, once for each key.
    """
    return _union([_added_key_rules(added, table, key, known) for table, key in UNIQUE_KEYS])


def _added_key_rules(added: RetailTables, table: str, key: str, known: dict[str, DataFrame]) -> DataFrame:
    pointing = _pointing_to(table, key)
    uses, there = _key_uses(added, [(table, key), *pointing]), F.lit(False)
    if table in known and key == PRIMARY_KEYS[table]:
        found = known_among(uses, "_key", known[table]).select(F.col("key").alias("_there"))
        uses, there = uses.join(found, F.col("_key") == F.col("_there"), "left"), F.col("_there").isNotNull()
    rules = {(table, f"unique({key})"): (F.col("_0") > 1) | ((F.col("_0") > 0) & there)}
    for j, (t, c) in enumerate(pointing, 1):
        rules[(t, f"exists({c} in {table})")] = (F.col("_0") == 0) & ~there & (F.col(f"_{j}") > 0)
    counted = uses.agg(*(F.count_if(broken).alias(f"v{i}") for i, broken in enumerate(rules.values())))
    entries = [
        F.struct(F.lit(t).alias("table_name"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
        for i, (t, rule) in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*entries)))

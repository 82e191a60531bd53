"""The whole load: raw sheet to written tables, with the row counts of each step.

The raw rows are written once, each with the reason why it cannot be loaded, if
there is one; cleaning, the rows set aside and all counts are made from that.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.model import COPIES, CORRUPT, RAW_SCHEMA, SOURCE_ORDER, RetailTables
from tallybook.operators.scratch import COMPRESSION, materialize
from tallybook.plans.clean import REASON, clean_sales, quarantine_reason, quarantined
from tallybook.plans.normalize import build_countries, normalize
from tallybook.plans.quality import added_violations, row_violations
from tallybook.plans.sums import SUM_TABLES, write_sums
from tallybook.sources.log import State
from tallybook.sources.tables import (
    KEYED,
    added_rows,
    commit_load,
    compact,
    known_keys,
    load_path,
    new_keys,
    new_load_id,
    on_top,
    read_tables,
    table_scan,
    write_load,
)

_EXTRA = [(CORRUPT, T.StringType()), (SOURCE_ORDER, T.LongType()), (REASON, T.StringType())]
SET_ASIDE = T.StructType([*RAW_SCHEMA.fields, *(T.StructField(n, t) for n, t in _EXTRA)])
COUNTS = "step_no int, step string, rows bigint"


@dataclass(frozen=True)
class Load:
    """What a load did. ``clean`` is None if the load had been done before."""

    clean: DataFrame | None
    tables: RetailTables
    counts: DataFrame
    set_aside: DataFrame


def _staged(raw: DataFrame, null_keys: str) -> DataFrame:
    """The raw rows with their reason, written once."""
    if REASON in raw.columns:
        return raw
    return materialize(raw.withColumn(REASON, quarantine_reason(raw, null_keys)), "raw")


def _raw_counts(raw: DataFrame, null_keys: str) -> Column:
    """(read, set aside) in one pass over the sheet."""
    aside = F.count_if(quarantine_reason(raw, null_keys).isNotNull())
    return raw.agg(F.struct(F.count(F.lit(1)).alias("read"), aside.alias("aside"))).scalar()


def _clean_counts(clean: DataFrame) -> DataFrame:
    """One row (copies, kept): lines before and after duplicate removal."""
    return clean.agg(F.coalesce(F.sum(COPIES), F.lit(0)).alias("copies"), F.count(F.lit(1)).alias("kept"))


def _as_steps(counts: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    entries = [
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(step).alias("step"), rows.alias("rows"))
        for i, (step, rows) in enumerate(steps)
    ]
    return counts.select(F.inline(F.array(*entries)))


def load_counts(raw: DataFrame, clean: DataFrame, tables: RetailTables, null_keys: str = "quarantine") -> DataFrame:
    """(step_no, step, rows) of the load.

    The counts come from the data and not from counters filled while writing: a
    task that is run again after a lost executor would count twice there. Rows
    before duplicate removal are the copies of the cleaned lines; tables are
    counted from the footers of the files that the load wrote.
    """
    source, copies, kept = F.col("source"), F.col("copies"), F.col("kept")
    counts = _clean_counts(clean).withColumn("source", _raw_counts(raw, null_keys))
    steps = [
        ("raw", source["read"]),
        ("quarantined", source["aside"]),
        ("before duplicate removal", copies),
        ("duplicates removed", copies - kept),
        ("clean", kept),
        *((name, df.agg(F.count(F.lit(1))).scalar()) for name, df in tables.items()),
    ]
    return _as_steps(counts, steps)


def cleaning_report(raw: DataFrame, clean: DataFrame, null_keys: str = "quarantine") -> DataFrame:
    """How the raw rows become the loaded ones: (step_no, step, rows), in order."""
    source, copies, kept = F.col("source"), F.col("copies"), F.col("kept")
    counts = _clean_counts(clean).withColumn("source", _raw_counts(raw, null_keys))
    steps = [
        ("rows in the source", source["read"]),
        ("set aside", source["aside"]),
        ("no description, or a price of zero or less", source["read"] - source["aside"] - copies),
        ("exact duplicates", copies - kept),
        ("loaded", kept),
    ]
    return _as_steps(counts, steps)


def _set_aside_columns(staged: DataFrame) -> DataFrame:
    there = set(staged.columns)
    columns = [F.col(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in SET_ASIDE]
    return staged.select(*columns)


def set_aside_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that the committed loads set aside, each with its reason."""
    return table_scan(spark, folder, "set_aside", SET_ASIDE)


def compact_sales(spark: SparkSession, folder: str) -> State:
    """One load of all that count, with the rows that they set aside and their sums; counts stay those of each load."""
    return compact(spark, folder, {"set_aside": SET_ASIDE, **SUM_TABLES})


def _published(
    staged: DataFrame, clean: DataFrame, incoming: RetailTables, folder: str, load_id: str, seen: State | None
) -> State:
    """Write all of a load, check it, and only then make it count: on top of ``seen``, or in place of what there was."""
    spark = staged.sparkSession
    aside = _set_aside_columns(quarantined(staged))
    aside.write.mode("overwrite").option("compression", COMPRESSION).parquet(load_path(folder, "set_aside", load_id))
    written = write_load(incoming, folder, load_id, seen.buckets if seen else 0)
    rules = row_violations(written)
    if seen is not None:
        known = {name: known_keys(spark, folder, name, seen) for name in KEYED}
        countries = table_scan(spark, folder, "countries", state=seen)
        known["countries"] = countries.select(F.col("country_id").alias("key"))
        rules = rules.union(added_violations(written, known))
    broken = rules.filter("violations > 0").collect()
    if broken:
        found = ", ".join(f"{r['table_name']} {r['rule']}: {r['violations']}" for r in broken)
        raise ValueError(f"load {load_id} is not published, its rows break rules: {found}")
    write_sums(spark, folder, load_id, seen)
    counts = load_counts(staged, clean, written)
    counts.write.mode("overwrite").parquet(load_path(folder, "counts", load_id))
    return commit_load(spark, folder, load_id, fresh=seen is None, seen=seen)


def _reported(spark: SparkSession, clean: DataFrame | None, folder: str, load_id: str, tables: RetailTables) -> Load:
    counts = spark.read.schema(COUNTS).parquet(load_path(folder, "counts", load_id))
    aside = spark.read.schema(SET_ASIDE).parquet(load_path(folder, "set_aside", load_id))
    return Load(clean, tables, counts, aside)


def load_sales(
    raw: DataFrame,
    folder: str,
    contiguous_ids: bool = False,
    null_keys: str = "quarantine",
    load_id: str | None = None,
) -> Load:
    """Clean once, write the five tables and the rows set aside, count every step.

    Takes the place of what the folder had. Nothing of it counts before all is
    written and its rows keep the rules of the tables.
    """
    staged = _staged(raw, null_keys)
    clean = materialize(clean_sales(staged, null_keys), "clean")
    countries = materialize(build_countries(clean), "countries")
    incoming, load_id = normalize(clean, contiguous_ids, countries), load_id or new_load_id()
    state = _published(staged, clean, incoming, folder, load_id, seen=None)
    return _reported(raw.sparkSession, clean, folder, load_id, read_tables(raw.sparkSession, folder, state))


def _new_countries(clean: DataFrame, known: DataFrame, last: int) -> DataFrame:
    """The names that are not there yet, numbered on."""
    names = clean.select(F.col("Country").alias("name")).distinct()
    fresh = build_countries(new_keys(names, known, "name", None).withColumnRenamed("name", "Country"))
    return fresh.select((F.col("country_id") + last).cast("int").alias("country_id"), "name")


def append_sales(
    raw: DataFrame,
    folder: str,
    contiguous_ids: bool = False,
    null_keys: str = "quarantine",
    load_id: str | None = None,
) -> Load:
    """Load another sheet into existing tables; the counts are those of this load.

    Countries, customers, products and invoices that are there already stay as they
    are; new ones are added, with the country ids of the existing table. All lines
    are added, numbered on from the last item. Without a ``load_id`` the same sheet
    loaded twice doubles its lines; with one, a load that is in the log is not done
    again, and one that failed is done over. Others may load into the folder at the
    same time; whoever comes second takes the ids after the first one's.
    The added rows are checked against the rules, references to rows of earlier loads
    included, before they count.
    """
    spark, load_id = raw.sparkSession, load_id or new_load_id()
    prepared: list[DataFrame] = []  # cleaned once, however often others come first

    def load(state: State) -> State:
        if not prepared:
            staged = _staged(raw, null_keys)
            prepared.extend([staged, materialize(clean_sales(staged, null_keys), "clean")])
        staged, clean = prepared
        known = table_scan(spark, folder, "countries", state=state)
        fresh = materialize(_new_countries(clean, known, state.last_country), "new-countries")
        incoming = normalize(clean, contiguous_ids, known.union(fresh))
        numbered = incoming.invoice_items.withColumn("item_id", F.col("item_id") + state.last_item)
        added = added_rows(replace(incoming, countries=fresh, invoice_items=numbered), folder, state)
        return _published(staged, clean, added, folder, load_id, seen=state)

    tables = on_top(spark, folder, load_id, load)
    return _reported(spark, prepared[1] if prepared else None, folder, load_id, tables)

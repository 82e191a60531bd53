"""Writing, reading and extending the five tables.

A folder of tables holds, for every table, one subfolder per load, and a log of
the loads that count (``log.py``). A load writes its files to its own subfolders and
gets its entry in the log last: readers see all of it or nothing. A load that failed
left files that nobody reads; running it again under its id replaces them. Several
writers may load at once: the one whose entry comes second prepares its load again
on top of the other.

Each load also writes the keys it brought, bucketed by key. That registry tells an
append which of its keys are there already, without moving those that are there: a
bucket of the registry is compared where it lies, and only the new keys are shuffled
to the buckets. ``compact`` makes one load of all that count, so that scans and the
registry do not get slower with every load.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.model import CONFLICT_KEYS, PRIMARY_KEYS, TABLE_SCHEMAS, RetailTables
from tallybook.operators.curve import along_curve
from tallybook.operators.scratch import COMPRESSION
from tallybook.sources.log import CommitConflict, State, read_state, write_state

#: Tables whose keys are registered. Countries are few, and their names are read as they are.
KEYED = ("customers", "products", "invoices")
#: A bucket of the registry holds about this many keys of the largest table of the first load.
BUCKET_KEYS = 4_000_000
LEAST_BUCKETS = 8
#: How often a load is prepared again because others were faster.
ATTEMPTS = 20


def _shaped(name: str, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLE_SCHEMAS[name]])


def new_load_id() -> str:
    return uuid.uuid4().hex


def committed_loads(spark: SparkSession, folder: str) -> list[str]:
    """The loads that count, oldest first: the last fresh one and all after it."""
    return read_state(spark, folder).done


def commit_load(spark: SparkSession, folder: str, load_id: str, fresh: bool = False, seen: State | None = None) -> State:
    """Make a written load count; a fresh one takes the place of all before it.

    ``seen`` is the state of the log that the load was prepared on; if it is no longer
    the last one, ``CommitConflict`` is raised. Without it the load does not depend on
    what is there, and the commit is tried until it is the next one.
    """

    def entry(before: State) -> State:
        before = replace(State(), seq=before.seq) if fresh else before
        written = read_load(spark, folder, load_id)
        items = written.invoice_items.agg(F.coalesce(F.max("item_id"), F.lit(0)))
        countries = written.countries.agg(F.coalesce(F.max("country_id"), F.lit(0)))
        return State(
            before.seq + 1,
            load_id,
            [*before.live, load_id],
            [*before.done, load_id],
            max(before.last_item, items.first()[0]),
            max(before.last_country, countries.first()[0]),
            before.buckets or _written_buckets(spark, folder, load_id),
        )

    return _next_entry(spark, folder, entry, seen)


def _next_entry(spark: SparkSession, folder: str, entry: Callable[[State], State], seen: State | None = None) -> State:
    for attempt in range(ATTEMPTS):
        state = entry(read_state(spark, folder) if seen is None else seen)
        try:
            write_state(spark, folder, state)
            return state
        except CommitConflict:
            if seen is not None or attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


def load_path(folder: str, name: str, load_id: str) -> str:
    return f"{folder}/{name}/load={load_id}"


def _registry_root(folder: str, buckets: int, name: str) -> str:
    return f"{folder}/keys/{buckets}/{name}"


def _buckets_for(tables: RetailTables) -> int:
    most = max(getattr(tables, name).count() for name in KEYED)
    return max(LEAST_BUCKETS, -(-most // BUCKET_KEYS))


def _written_buckets(spark: SparkSession, folder: str, load_id: str) -> int:
    return spark.read.schema("buckets int").json(load_path(folder, "registry", load_id)).first()["buckets"]


def _register_keys(written: RetailTables, folder: str, load_id: str, buckets: int) -> None:
    """Write the keys of a load's rows, bucketed; one file for each bucket that has any."""
    spark = written.invoices.sparkSession
    for name in KEYED:
        key = F.col(PRIMARY_KEYS[name])
        keys = getattr(written, name).select(key.alias("key"), F.lit(load_id).alias("load"))
        table = f"tallybook_{uuid.uuid4().hex}"
        place = f"{_registry_root(folder, buckets, name)}/load={load_id}"
        bucketed = keys.repartition(buckets, "key").write.bucketBy(buckets, "key").option("compression", COMPRESSION).mode("overwrite")
        bucketed.option("path", place).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay; the catalog is not needed to find them
    marker = spark.createDataFrame([(buckets,)], "buckets int").coalesce(1)
    marker.write.mode("overwrite").json(load_path(folder, "registry", load_id))


def known_keys(spark: SparkSession, folder: str, name: str, state: State) -> DataFrame:
    """The keys (column ``key``) of a table's rows as the log has them, as a scan by buckets."""
    kind = TABLE_SCHEMAS[name][PRIMARY_KEYS[name]].dataType
    if not state.live:
        return spark.createDataFrame([], T.StructType([T.StructField("key", kind)]))
    table = f"tallybook_{uuid.uuid4().hex}"
    root = _registry_root(folder, state.buckets, name)
    spark.sql(
        f"CREATE TABLE {table} (key {kind.simpleString()}, load string) USING parquet "
        f"OPTIONS (path '{root}', recursiveFileLookup 'true') CLUSTERED BY (key) INTO {state.buckets} BUCKETS"
    )
    keys = spark.table(table).filter(F.col("load").isin(state.live)).select("key")
    spark.sql(f"DROP TABLE {table}")
    return keys


def write_load(tables: RetailTables, folder: str, load_id: str, buckets: int = 0) -> RetailTables:
    """Write the rows of a load, in foreign-key order, register its keys, and return the rows as scans.

    ``buckets`` is that of the registry so far; 0 begins a new one by the number of keys.
    """
    for name, df in tables.items():
        _shaped(name, df).write.mode("overwrite").option("compression", COMPRESSION).parquet(load_path(folder, name, load_id))
    written = read_load(tables.invoices.sparkSession, folder, load_id)
    _register_keys(written, folder, load_id, buckets or _buckets_for(written))
    return written


def read_load(spark: SparkSession, folder: str, load_id: str) -> RetailTables:
    """What one load brought, whether it counts yet or not."""
    scans = {n: spark.read.schema(s).parquet(load_path(folder, n, load_id)) for n, s in TABLE_SCHEMAS.items()}
    return RetailTables(**scans)


def write_tables(tables: RetailTables, folder: str, load_id: str | None = None) -> RetailTables:
    """Write the tables as Parquet, in place of what counted before, and return them as scans."""
    spark, load_id = tables.invoices.sparkSession, load_id or new_load_id()
    write_load(tables, folder, load_id)
    return read_tables(spark, folder, commit_load(spark, folder, load_id, fresh=True))


def read_tables(spark: SparkSession, folder: str, state: State | None = None) -> RetailTables:
    """The five tables, all as of one state of the log."""
    state = state or read_state(spark, folder)
    return RetailTables(**{name: table_scan(spark, folder, name, state=state) for name in TABLE_SCHEMAS})


def table_scan(
    spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None, state: State | None = None
) -> DataFrame:
    """A table as the committed loads have it."""
    schema = schema or TABLE_SCHEMAS[name]
    state = state or read_state(spark, folder)
    paths = [load_path(folder, name, load_id) for load_id in state.live]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def reset_tables(spark: SparkSession, folder: str) -> RetailTables:
    """Empty tables with the right columns, replacing what was there."""
    empty = RetailTables(**{n: spark.createDataFrame([], schema) for n, schema in TABLE_SCHEMAS.items()})
    return write_tables(empty, folder)


def _first_of_key(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Of incoming rows with the same key, the first one by ``order``."""
    rest = [c for c in incoming.columns if c not in (key, order)]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(key, "_row.*").select(*[c for c in incoming.columns if c != order])


def new_keys(incoming: DataFrame, existing: DataFrame, key: str, order: str | None) -> DataFrame:
    """Incoming rows whose key is not there yet, one per key.

    Among incoming rows with the same key the first by ``order`` is kept. ``None``
    says that no key occurs twice; it is not checked.
    """
    first = incoming if order is None else _first_of_key(incoming, key, order)
    return first.join(existing.select(key), key, "left_anti").select(*first.columns)


def known_among(incoming: DataFrame, key: str, registry: DataFrame) -> DataFrame:
    """The incoming keys (column ``key``) that the registry has.

    The registry is streamed past a hash table of the incoming keys of the same
    bucket; only the incoming keys are shuffled.
    """
    asked = incoming.select(F.col(key).alias("key")).filter(F.col("key").isNotNull())
    return registry.join(asked.hint("shuffle_hash"), "key", "left_semi")


def unregistered(incoming: DataFrame, key: str, registry: DataFrame) -> DataFrame:
    """Incoming rows whose key the registry has not; a null key is in no registry."""
    known = known_among(incoming, key, registry).select(F.col("key").alias("_known"))
    return incoming.join(known, F.col(key) == F.col("_known"), "left_anti")


def append_new_keys(incoming: RetailTables, folder: str, load_id: str | None = None) -> RetailTables:
    """Add rows to existing tables: rows whose key is there already stay as they are.

    Of incoming rows with the same key, the one with the smallest primary key is
    kept; the primary keys must be unique. Country ids in ``incoming`` must be
    those of the existing table, as load.append_sales makes sure.

    The items have no such key; they are all added. A ``load_id`` that is in the
    log already adds nothing, so a load can be repeated.
    """
    spark, load_id = incoming.invoices.sparkSession, load_id or new_load_id()
    return on_top(spark, folder, load_id, lambda state: _append(incoming, folder, load_id, state))


def on_top(spark: SparkSession, folder: str, load_id: str, load: Callable[[State], State]) -> RetailTables:
    """Run a load on the state of the log, again for as long as others come first; nothing if it counts already."""
    for attempt in range(ATTEMPTS):
        state = read_state(spark, folder)
        try:
            return read_tables(spark, folder, state if load_id in state.done else load(state))
        except CommitConflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


def _append(incoming: RetailTables, folder: str, load_id: str, state: State) -> State:
    spark = incoming.invoices.sparkSession
    write_load(added_rows(incoming, folder, state), folder, load_id, state.buckets)
    return commit_load(spark, folder, load_id, seen=state)


def added_rows(incoming: RetailTables, folder: str, state: State) -> RetailTables:
    """Of the incoming tables, the rows with new keys and all items."""
    spark = incoming.invoices.sparkSession
    added = {}
    for name, df in incoming.items():
        if name in KEYED:
            df = unregistered(df, PRIMARY_KEYS[name], known_keys(spark, folder, name, state))
        elif name in CONFLICT_KEYS:
            ordered = df.withColumn("_order", F.col(PRIMARY_KEYS[name]))
            df = new_keys(ordered, table_scan(spark, folder, name, state=state), CONFLICT_KEYS[name], "_order")
        added[name] = df
    return RetailTables(**added)


def compact(spark: SparkSession, folder: str, also: dict[str, T.StructType] | None = None, buckets: int = 0) -> State:
    """Make one load of all that count, in fewer and larger files; the rows stay the same.

    Loads that are committed meanwhile stay as they are, behind it. If the tables are
    written anew meanwhile, the compaction is given up. ``also`` names further tables
    of the loads with their schemas; ``buckets`` changes the number of buckets.
    """
    seen, load_id = read_state(spark, folder), f"compact-{new_load_id()}"
    if len(seen.live) < 2 and buckets in (0, seen.buckets):
        return seen
    merged = read_tables(spark, folder, seen)
    for name, schema in (also or {}).items():
        rows = table_scan(spark, folder, name, schema, seen)
        rows.write.mode("overwrite").option("compression", COMPRESSION).parquet(load_path(folder, name, load_id))
    write_load(merged, folder, load_id, buckets or seen.buckets)

    def entry(now: State) -> State:
        if now.live[: len(seen.live)] != seen.live or now.buckets != seen.buckets:
            raise CommitConflict(f"{folder} was written anew during the compaction")
        later = now.live[len(seen.live) :]
        if later and buckets not in (0, seen.buckets):
            raise CommitConflict(f"{folder} was loaded to while the number of buckets changed")
        return replace(now, seq=now.seq + 1, load_id=load_id, live=[load_id, *later], buckets=buckets or seen.buckets)

    return _next_entry(spark, folder, entry)


def largest_bucket_share(df: DataFrame, key: str, buckets: int) -> float:
    """Rows of the fullest bucket, as a multiple of an even share."""
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    rows = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    fullest, total = rows.agg(F.max("rows"), F.sum("rows")).first()
    return fullest * buckets / total if total else 0.0


def write_layout(tables: RetailTables, prefix: str, folder: str, buckets: int, by: str = "bucket") -> RetailTables:
    """Write catalog tables laid out for the joins and filters of the analyses.

    ``by="bucket"``: invoices and items are bucketed by invoice number; their join,
    and the sum per invoice before it, then need no shuffle. A bucket is read by
    one task and is not split at run time; ``largest_bucket_share`` tells before
    whether one invoice would make a bucket several times as large as the others.

    ``by="range"``, for such tables: items are range-sorted by invoice and line,
    which cuts through a huge invoice, and invoices by date, so that a date filter
    skips files.

    ``by="curve"``: invoices are laid out along date and customer together, items along
    invoice and product, so that a filter on any one of the four skips most files.
    """
    if by not in ("bucket", "range", "curve"):
        raise ValueError(f"by must be 'bucket', 'range' or 'curve', not {by!r}")
    spark = tables.invoices.sparkSession
    ranges = {"invoices": ["invoice_date", "invoice_no"], "invoice_items": ["invoice_no", "item_id"]}
    curves = {"invoices": ["invoice_date", "customer_id"], "invoice_items": ["invoice_no", "stock_code"]}
    for name, df in tables.items():
        shaped = _shaped(name, df)
        if name not in ranges:
            writer = shaped.write
        elif by == "bucket":
            # One task per bucket, so a bucket is one sorted file and not one per task.
            placed = shaped.repartition(buckets, "invoice_no")
            writer = placed.write.bucketBy(buckets, "invoice_no").sortBy("invoice_no")
        elif by == "curve":
            writer = along_curve(shaped, curves[name], PRIMARY_KEYS[name], buckets).write
        else:
            order = ranges[name]
            writer = shaped.repartitionByRange(buckets, *order).sortWithinPartitions(*order).write
        writer.mode("overwrite").option("path", f"{folder}/{name}").saveAsTable(f"{prefix}{name}")
    return RetailTables(**{name: spark.table(f"{prefix}{name}") for name in TABLE_SCHEMAS})

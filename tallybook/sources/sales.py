"""Reading the flat sales sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.model import CORRUPT, RAW_COLUMNS, RAW_SCHEMA, SOURCE_ORDER
from tallybook.operators.scratch import materialize

_ROW_BITS = 33  # row within a scan task, from monotonically_increasing_id
_EPOCH = "1970-01-01 00:00:00"


def read_sales(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    timestamp_format: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Scan the sheet with its fixed schema and number the rows in source order.

    CSV is read as RFC 4180 writes it: quotes inside quoted text are doubled. Text
    with line breaks needs ``multi_line``, which reads each file in one task.
    ``timestamp_format`` is a Spark datetime pattern, such as ``M/d/yyyy H:mm``;
    without one the dates are ISO 8601.

    A CSV line that does not fit the schema is kept as text in the corrupt-record
    column, with nulls where a value does not fit; cleaning sets such lines aside.
    All of it is ordinary columns, so no later selection of columns changes which
    lines count as unreadable.
    """
    if fmt == "parquet":
        return with_source_order(spark.read.schema(RAW_SCHEMA).parquet(path))
    if fmt == "csv":
        text = T.StructType([T.StructField(c, T.StringType()) for c in (*RAW_COLUMNS, CORRUPT)])
        sheet = (
            spark.read.schema(text)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False)  # else a line is only checked as far as columns are asked for
            .option("escape", '"')
            .option("multiLine", multi_line)
            .csv(path)
        )
        return with_source_order(_typed(sheet, timestamp_format), fmt="csv")  # so values are read from text once
    raise ValueError(f"unsupported format: {fmt}")


def _timestamp(text: Column, pattern: str | None) -> Column:
    """Wall-clock time; read as if in UTC, so no time zone moves it or has a gap in it."""
    if pattern is None:
        return text.try_cast("timestamp_ntz")
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{pattern} xx"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(_EPOCH).cast("timestamp_ntz"))


def _whole_number(text: Column, kind: T.DataType) -> Column:
    """A whole number, which a spreadsheet may write as 6.0; null for any other text and for fractions."""
    number = text.try_cast("decimal(38,10)")
    return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))


def _typed(lines: DataFrame, timestamp_format: str | None) -> DataFrame:
    """Text columns as the types of the sheet; what does not fit goes to the corrupt-record column."""
    typed = {}
    for field in RAW_SCHEMA.fields:
        text = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            typed[field.name] = _timestamp(text, timestamp_format)
        elif isinstance(field.dataType, T.IntegralType):
            typed[field.name] = _whole_number(text, field.dataType)
        elif not isinstance(field.dataType, T.StringType):
            typed[field.name] = text.try_cast(field.dataType)
    # Values are columns of their own first, as each is used twice.
    valued = lines.withColumns({f"_typed_{c}": value for c, value in typed.items()})
    misfit = reduce(Column.__or__, (F.col(c).isNotNull() & F.col(f"_typed_{c}").isNull() for c in typed))
    line = F.coalesce(F.col(CORRUPT), F.when(misfit, F.to_csv(F.struct(*RAW_COLUMNS))))
    columns = [F.col(f"_typed_{c}" if c in typed else c).alias(c) for c in RAW_COLUMNS]
    return valued.select(*columns, line.alias(CORRUPT))


def with_source_order(scan: DataFrame, out: str = SOURCE_ORDER, fmt: str = "parquet") -> DataFrame:
    """Number the rows of a file scan 0, 1, ... in source order: files by name, then by position.

    Rows are counted per file (Parquet, which has row numbers) or per split of a
    file (CSV), and a row's number is its place there plus the counts before. CSV
    rows have no place of their own but follow each other in the task that reads
    their split, whatever else it reads, so they are written once with the place
    they were read at. Runs a job while the frame is built.
    """
    if fmt == "parquet":
        start, row = F.lit(0).cast("bigint"), F.col("_metadata.row_index")
    else:
        start = F.col("_metadata.file_block_start")
        row = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    located = scan.select("*", F.col("_metadata.file_path").alias("_file"), start.alias("_start"), row.alias("_at"))
    if fmt != "parquet":
        located = materialize(located, "sheet")
    # One row per file or split, however many lines they have.
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = located.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    splits = materialize(splits, "splits")
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    placed = located.join(splits.select("_file", "_start", offset.alias("_offset")), ["_file", "_start"])
    return placed.withColumn(out, F.col("_offset") + F.col("_at")).drop("_file", "_start", "_at", "_offset")

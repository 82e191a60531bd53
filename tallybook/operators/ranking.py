"""Ranks over a whole table, without moving the table into one task.

A window without PARTITION BY sends every row to a single task. Here the rows
are range-sorted instead, so each task holds one slice of the global order. The
slices are written once, counted, and every row's global position is its place
in its slice plus the sizes of the slices before it.

The order must end in a unique key: it makes the ranks reproducible, and it lets
the range sort cut through a value that a large part of all rows share.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.scratch import materialize

#: A block of ``numbered_by`` holds 2^17 values of its column, so at most as many rows.
BLOCK_BITS = 17
MOST_BLOCKS = 1 << 18

_SLICE_BITS = 33  # monotonically_increasing_id: slice number above, row in slice below


def _sorted_slices(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    position = F.col("_position")
    placed = df.orderBy(*order).withColumn("_position", F.monotonically_increasing_id())
    return (
        materialize(placed, label)
        .withColumn("_slice", F.shiftright(position, _SLICE_BITS))
        .withColumn("_in_slice", position.bitwiseAND((1 << _SLICE_BITS) - 1))
        .drop("_position")
    )


def _slice_starts(slices: DataFrame, size: Column) -> DataFrame:
    """(slice, start, total): one row per sort task, however large the table is."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.groupBy("_slice")
        .agg(size.alias("_size"))
        .select(
            "_slice",
            "_size",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
            F.sum("_size").over(Window.partitionBy()).alias("_total"),
        )
    )


def _numbered(df: DataFrame, order: Sequence[Column], out: str, label: str) -> DataFrame:
    slices = _sorted_slices(df, order, label)
    # Bounded by the number of sort tasks, so this side is always small.
    starts = F.broadcast(_slice_starts(slices, F.count(F.lit(1))).drop("_size"))
    numbered = slices.join(starts, "_slice").withColumn(out, F.col("_start") + F.col("_in_slice") + 1)
    return numbered.drop("_slice", "_in_slice", "_start")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _bucket(rank: Column, total: Column, n: int) -> Column:
    """NTILE from rank and row count: the first total % n buckets get one row more."""
    size = _div(total, F.lit(n))
    extra = total % n
    in_larger = extra * (size + 1)
    # With fewer rows than buckets every row is in a "larger" bucket of one row.
    smaller = F.greatest(size, F.lit(1).cast("bigint"))
    return (
        F.when(rank <= in_larger, _div(rank - 1, size + 1) + 1)
        .otherwise(extra + _div(rank - in_larger - 1, smaller) + 1)
        .cast("int")
    )


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "row_number") -> DataFrame:
    """Contiguous 1..N over the whole table. Runs jobs while the frame is built."""
    return _numbered(df, order, out, "row-number").drop("_total")


def numbered_by(df: DataFrame, order: str, out: str) -> DataFrame:
    """Contiguous 1..N over the whole table by a unique BIGINT column, in one shuffle of the rows. Runs jobs.

    Whole numbers need no sampled ranges: rows of each block of 2^BLOCK_BITS values are
    counted first, and a block's rows are numbered on from those of the blocks before.
    Values so sparse that they make more blocks than are broadcast are range-sorted.
    """
    blocked = df.withColumn("_slice", F.shiftright(F.col(order), BLOCK_BITS))
    sizes = materialize(blocked.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows")), "block-sizes")
    if sizes.count() > MOST_BLOCKS:
        return global_row_number(df, [F.col(order)], out)
    starts = F.broadcast(_slice_starts(sizes, F.sum("_rows")).select("_slice", "_start"))  # bounded by the line above
    in_block = F.row_number().over(Window.partitionBy("_slice").orderBy(order))
    numbered = blocked.withColumn("_in_slice", in_block).join(starts, "_slice")
    return numbered.withColumn(out, F.col("_start") + F.col("_in_slice")).drop("_slice", "_in_slice", "_start")


def global_ntile(df: DataFrame, n: int, order: Sequence[Column], out: str = "ntile") -> DataFrame:
    """NTILE(n) over the whole table. Runs jobs while the frame is built."""
    numbered = _numbered(df, order, "_rank", "ntile")
    return numbered.withColumn(out, _bucket(F.col("_rank"), F.col("_total"), n)).drop("_rank", "_total")


def sorted_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with their number of rows, sorted and written.

    Equal values are counted together before the sort, so a value that a large
    part of all rows share is one row in it.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _sorted_slices(counts, [F.col(column)], "sorted-counts")


def percentile_of_counts(counts: DataFrame, column: str, q: float, out: str) -> DataFrame:
    """Interpolated percentile from sorted_counts, as a one-row frame.

    Only the one or two slices that hold the wanted ranks are walked through.
    """
    position = (F.col("_total") - 1).cast("decimal(20,0)") * F.lit(Decimal(str(q)))
    starts = (
        _slice_starts(counts, F.sum("n"))
        .withColumn("_low", F.floor(position).cast("bigint"))
        .withColumn("_high", F.ceil(position).cast("bigint"))
        .withColumn("_part", position - F.floor(position))
        .filter((F.col("_low") < F.col("_start") + F.col("_size")) & (F.col("_high") >= F.col("_start")))
    )
    running = Window.partitionBy("_slice").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    walked = counts.join(F.broadcast(starts), "_slice").withColumn("_end", F.col("_start") + F.sum("n").over(running))

    def at(rank: str) -> Column:
        inside = (F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("n"))
        return F.max(F.when(inside, F.col(column)))

    low, high, part = at("_low"), at("_high"), F.max("_part")
    return walked.agg((low + (high - low) * part.cast("decimal(12,10)")).alias(out))


def exact_percentile(df: DataFrame, column: str, q: float, out: str) -> DataFrame:
    """Interpolated percentile of a decimal column, as a one-row frame. Runs jobs.

    Built-in ``percentile`` would gather every distinct value in one task.
    """
    return percentile_of_counts(sorted_counts(df, column), column, q, out)

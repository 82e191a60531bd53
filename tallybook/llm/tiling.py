"""Comparing all rows of a group with each other, in tiles of bounded size.

Rows are grouped by key columns. A group of at most ``tile_rows`` is one task
unit. A larger one is cut into tiles by the rank column (for which only rows at
most ``reach`` apart need comparing) and by a hash of the row; every pair of
tiles whose ranks are within reach is a unit of its own, and the tile pairs
beyond it are never made. So no unit holds more than two tiles, whatever a
group's size, and every pair of rows within reach meets in exactly one unit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.scratch import materialize

UNIT = ("_p", "_s", "_q", "_t")


def _tiles(rows: Column, tile_rows: int) -> Column:
    return F.ceil(rows / F.lit(tile_rows)).cast("int")


def tile_units(
    rows: DataFrame, keys: Sequence[str], row_hash: Column, rank: str, reach: int, tile_rows: int
) -> DataFrame:
    """The rows dealt to units: columns of ``rows`` plus the unit and ``_upper``.

    Groups of one row are left out. The result is sorted by unit in each
    partition, lower tile first. Keys must not be null; at most a few hundred
    ranks may occur in a group. Runs jobs while the frame is built.
    """
    cells = rows.groupBy(*keys, rank).agg(F.count(F.lit(1)).alias("n"))
    groups = (
        cells.groupBy(*keys)
        .agg(F.sum("n").alias("_total"), F.collect_list(F.struct(F.col(rank).alias("r"), "n")).alias("_cells"))
        .filter("_total > 1")
    )
    groups = materialize(groups, "groups")  # so that the join can split a hot key
    p = F.col(rank)
    own = F.filter("_cells", lambda c: c["r"] == p)[0]["n"]
    salted = rows.join(groups, list(keys)).withColumn("_salt", F.pmod(row_hash, _tiles(own, tile_rows)).cast("int"))

    def unit(p, s, q, t, upper) -> Column:
        values = zip((*UNIT, "_upper"), (p, s, q, t, upper), strict=True)
        return F.struct(*(v.cast("boolean" if n == "_upper" else "int").alias(n) for n, v in values))

    def with_tile(c: Column, t: Column) -> Column:
        s, q = F.col("_salt"), c["r"]
        same = unit(p, F.least(s, t), p, F.greatest(s, t), s > t)
        return F.when(q == p, same).when(q > p, unit(p, s, q, t, F.lit(False))).otherwise(unit(q, t, p, s, F.lit(True)))

    near = F.filter("_cells", lambda c: F.abs(c["r"] - p) <= reach)
    pairs = F.flatten(
        F.transform(
            near,
            lambda c: F.transform(F.sequence(F.lit(0), _tiles(c["n"], tile_rows) - 1), lambda t: with_tile(c, t)),
        )
    )
    zero = F.lit(0)
    alone = F.array(unit(F.lit(-1), zero, F.lit(-1), zero, F.lit(False)))
    units = F.when(F.col("_total") <= tile_rows, alone).otherwise(pairs)
    dealt = salted.select(*rows.columns, F.inline(units))
    return dealt.repartition(*keys, *UNIT).sortWithinPartitions(*keys, *UNIT, "_upper")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups of a stream sorted by ``keys``, and where each group begins (and the end)."""
    rest: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        changed = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in keys:
            values = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
            codes = values.indices.to_numpy(zero_copy_only=False)
            changed |= codes[1:] != codes[:-1]
        return np.concatenate([[0], np.flatnonzero(changed) + 1, [table.num_rows]]).astype(np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        table = pa.Table.from_batches(rest).combine_chunks()
        bounds = cut(table)
        last = int(bounds[-2])
        if last:
            yield table.slice(0, last), bounds[:-1]
        rest = table.slice(last).combine_chunks().to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, cut(table)


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row is of the upper tile, row's unit compares two tiles) for each row."""
    p, s, q, t = (table.column(c).to_numpy() for c in UNIT)
    return table.column("_upper").to_numpy(), (p != q) | (s != t)


def small_pairs(bounds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside the groups of at most ``most`` rows."""
    sizes = np.diff(bounds)
    small = sizes <= most
    ends = np.repeat(bounds[1:][small], sizes[small])
    rows = np.arange(bounds[-1])[np.repeat(small, sizes)]
    left, right = [], []
    for step in range(1, most):
        keep = rows + step < ends
        rows, ends = rows[keep], ends[keep]
        if not len(rows):
            break
        left.append(rows)
        right.append(rows + step)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def large_units(
    bounds: np.ndarray, most: int, upper: np.ndarray, crossed: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(rows, rows to compare them with) of each group of over ``most`` rows; None: with themselves."""
    for g in np.flatnonzero(np.diff(bounds) > most):
        rows = np.arange(bounds[g], bounds[g + 1])
        if crossed[rows[0]]:
            yield rows[~upper[rows]], rows[upper[rows]]
        else:
            yield rows, None


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) after joining i and j pairwise."""
    while True:
        before = labels
        labels = before.copy()
        np.minimum.at(labels, before[i], before[j])
        np.minimum.at(labels, before[j], before[i])
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
        if np.array_equal(labels[i], labels[j]):
            return labels


def tree_links(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component as a binary tree, so no node gets many."""
    order = np.argsort(labels, kind="stable")
    sorted_labels = labels[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_labels[1:] != sorted_labels[:-1]])) if len(order) else order
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    first = np.repeat(starts, sizes)
    rank = np.arange(len(order)) - first
    child = rank > 0
    return order[child], order[(first + (rank - 1) // 2)[child]]

"""Hard negatives: per anchor and positive, the best rows of other labels in a window of scores.

Scores are integer inner products. An anchor's positives are its best rows of the
same label. A positive with score p asks for the best rows of other labels whose
score s has ``low * p <= 100 * s <= high * p``. The windows of an anchor overlap, and
their lower limits matter only at the end, as the best rows are wanted. So the upper
limits alone cut the anchor's scores into disjoint slots, and a window is a slot with
all slots below it. Every row falls into one slot of an anchor; tasks and their merge
keep the best few of each slot. Going through the slots from the lowest up, the best
of a window are the best of its own slot, then the best of the window that begins
with the next slot: one merge answers all windows.

The anchors, as a stated query set, are scored against all rows in blocks: both
are numbered, dealt to blocks of bounded size, and every block of anchors meets every
block of rows in a task of its own, as one matrix product. A task hands on a few rows
for each anchor and slot. Nothing grows with the size of a label: rows are dealt by
number, whatever they hold.

Products are taken in single or double precision where every partial sum is a whole
number that such floats hold exactly, by the norms of the vectors, and in Python's
integers elsewhere; a score beyond 64 bits fails the job.

Defined results: rows with a null id, label or vector, or a null component, take no
part. Vectors of different lengths are filled up with zeros. Repeated rows are rows
of their own: each can be a positive or negative of the others, and each that is an
anchor has its own result. Of rows with equal scores the smaller id comes first.
Windows without a row, such as those of negative scores, give none. Columns of the
frame that are not named are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.scratch import materialize

ROW_BLOCK = 1 << 16  # rows of a block at most
ANCHOR_BLOCK = 1 << 14  # anchors of a block at most
LEAST_BLOCK = 1 << 11  # smaller blocks of rows are not worth a task
_CELLS = 1 << 21  # scores held at a time

_FOUND = "anchor bigint, slot int, id bigint, score bigint"
_ARROW = [("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(lengths), width), np.int64)
    matrix[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return matrix


def _width(vectors: pa.Array) -> int:
    return pc.max(pc.list_value_length(vectors)).as_py() or 0


def _norm(matrix: np.ndarray) -> float:
    return float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) * (1 + 1e-9)


def exact_products(rows: np.ndarray, anchors: np.ndarray) -> Callable[[slice], np.ndarray]:
    """The integer products of a slice of rows with all anchors, as a function of the slice.

    No partial sum of a product is larger than the product of the norms, so below
    2^24 (2^53) single (double) precision rounds nothing.
    """
    most = _norm(rows) * _norm(anchors)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    left, right = rows.astype(kind), anchors.astype(kind).T
    return lambda part: (left[part] @ right).astype(np.int64)


class Best:
    """The ``keep`` best (score, then smaller id) of each cell, from matrices of scores."""

    def __init__(self, cells: int, keep: int):
        self.keep = keep
        self.count = np.zeros(cells, np.int64)
        self.floor = np.full(cells, np.iinfo(np.int64).min)  # of a full cell: its last score
        self.cell, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, cell: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Candidates, any number of them for a cell."""
        good = score >= self.floor[cell]
        if not good.any():
            return
        cell, ids, score = (
            np.concatenate([old, new[good]]) for old, new in ((self.cell, cell), (self.id, ids), (self.score, score))
        )
        order = np.lexsort((ids, -score, cell))
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        rank = np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell))))
        first = rank < self.keep
        self.cell, self.id, self.score = cell[first], ids[order][first], score[order][first]
        last = rank == self.keep - 1
        self.floor[cell[last]] = score[order][last]


def _scored(
    rows: pa.Table, anchors: pa.Table, keep: int, slots: int, place: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> pa.Table:
    """The best of each anchor and slot in one block. ``place(scores, row numbers, labels)``: the slot of
    each score, negative where the row is not asked for."""
    width = max(_width(rows["vector"].combine_chunks()), _width(anchors["vector"].combine_chunks()))
    left, right = (_matrix(t["vector"].combine_chunks(), width) for t in (rows, anchors))
    ids, number, label = (rows[c].to_numpy() for c in ("id", "number", "label"))
    product, best = exact_products(left, right), Best(len(right) * slots, keep)
    step = max(1, _CELLS // max(1, len(right)))
    for begin in range(0, len(left), step):
        part = slice(begin, begin + step)
        scores = product(part)
        slot = place(scores, number[part], label[part])
        asked = slot >= 0
        cell = np.where(asked, np.arange(len(right))[None, :] * slots + slot, 0)
        row, column = np.nonzero(asked & (scores >= best.floor[cell]))
        best.add(cell[row, column], ids[part][row], scores[row, column])
    anchor = anchors["number"].to_numpy()[best.cell // slots]
    return pa.table({"anchor": anchor, "slot": (best.cell % slots).astype(np.int32), "id": best.id, "score": best.score})


def _blocks(rows: int, most: int, least: int, wanted: int) -> int:
    """How many blocks: about ``wanted``, but none of over ``most`` rows, and none of fewer than ``least`` without need."""
    return max(-(-rows // most), min(wanted, rows // least), 1)


def _every_block(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """The rows, dealt to blocks by number, once for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )


def _hundredths(score: Column, times: int) -> Column:
    return score.cast("decimal(20,0)") * times


def _first(df: DataFrame, by: list[str], most: int, out: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= most)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor's positives.

    ``vector`` holds whole numbers; ``anchor`` says which rows are anchors. Limits are
    in hundredths of the positive's score. Runs jobs while the frame is built.
    """
    spark = df.sparkSession
    whole = F.col(vector).cast("array<bigint>")
    rows = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(
        ~F.exists(vector, lambda x: x.isNull())
    )
    rows = rows.select(
        F.monotonically_increasing_id().alias("number"),
        F.col(key).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        whole.alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = materialize(rows, "vectors")
    asking = rows.filter("anchor")
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    across = _blocks(sizes["rows"], ROW_BLOCK, LEAST_BLOCK, 2 * spark.sparkContext.defaultParallelism)
    down = _blocks(sizes["anchors"], ANCHOR_BLOCK, ANCHOR_BLOCK, 1)
    grid = ["row_block", "anchor_block"]
    dealt = _every_block(rows.drop("anchor"), "row_block", across, "anchor_block", down).groupBy(*grid)

    def met(anchors: DataFrame, found: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        # Both sides come from one table; a cogroup needs columns of its own on each.
        anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))
        asked = _every_block(anchors, "anchor_block", down, "row_block", across).groupBy(*grid)

        def block(some: pa.Table, of: pa.Table) -> pa.Table:
            if some.num_rows and of.num_rows:
                return found(some, of)
            return pa.table({n: pa.array([], t) for n, t in _ARROW})

        return dealt.cogroup(asked).applyInArrow(block, _FOUND)

    def same_label(some: pa.Table, anchors: pa.Table) -> pa.Table:
        labels, numbers = anchors["label"].to_numpy(), anchors["number"].to_numpy()

        def place(scores: np.ndarray, number: np.ndarray, label: np.ndarray) -> np.ndarray:
            return np.where((label[:, None] == labels) & (number[:, None] != numbers), 0, -1)

        return _scored(some, anchors, positives, 1, place)

    near = met(asking.drop("anchor"), same_label)
    near = _first(near, ["anchor"], positives, "place")
    upper = F.floor(_hundredths(F.col("score"), high) / 100).cast("bigint")
    near = materialize(near.select("anchor", "id", "score", upper.alias("upper")), "positives")

    limits = near.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"))
    questions = asking.drop("anchor").join(limits, F.col("number") == F.col("anchor")).drop("anchor")

    def other_label(some: pa.Table, anchors: pa.Table) -> pa.Table:
        labels = anchors["label"].to_numpy()
        uppers = anchors["uppers"].combine_chunks()
        ends = _matrix(uppers, positives)
        ends[np.arange(positives)[None, :] >= pc.list_value_length(uppers).to_numpy()[:, None]] = np.iinfo(np.int64).min

        def place(scores: np.ndarray, number: np.ndarray, label: np.ndarray) -> np.ndarray:
            slot = np.full(scores.shape, -1, np.int64)
            for k in range(positives):
                slot += scores <= ends[:, k]
            slot[label[:, None] == labels] = -1
            return slot

        return _scored(some, anchors, negatives, positives, place)

    best = _first(met(questions, other_label), ["anchor", "slot"], negatives, "place")
    return _windows(near.join(limits, "anchor"), best, asking, negatives, low)


def _windows(near: DataFrame, best: DataFrame, asking: DataFrame, negatives: int, low: int) -> DataFrame:
    """The first rows of each positive's window.

    An anchor's slots follow each other in one list, best first (``negatives`` rows for
    each of at most as many slots as positives); a window is the beginning of the part
    of the list from its own slot on, down to its lower limit.
    """
    order = F.struct((-F.col("score")).alias("minus"), "id", "slot")
    merged = best.groupBy("anchor").agg(F.sort_array(F.collect_list(order)).alias("merged"))
    own_slot = F.array_position("uppers", F.col("upper")) - 1
    suffix = F.slice(F.filter("merged", lambda r: r["slot"] >= own_slot), 1, negatives)
    inside = F.filter(suffix, lambda r: _hundredths(-r["minus"], 100) >= _hundredths(F.col("score"), low))
    names = asking.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"))
    found = near.join(merged, "anchor").select("anchor", "id", "score", F.posexplode(inside).alias("at", "row"))
    return found.join(names, "anchor").select(
        "anchor_id",
        F.col("id").alias("positive_id"),
        (F.col("at") + 1).alias("rank"),
        F.col("row.id").alias("negative_id"),
        F.col("score").alias("positive_score"),
        (-F.col("row.minus")).alias("negative_score"),
    )

"""Shuffled shards from a permutation that is computed, not stored.

Rows get global numbers 0..n-1 in the order of a key. A Feistel network permutes
the numbers of a power-of-four domain of at least n; a number that lands at n or
above is sent through again (cycle walking) until it lands below n, which makes
it a permutation of 0..n-1. The permuted number p is the row's place in the
shuffle: shard p mod k, slot p div k. So shard sizes differ by at most one, slots
are gapless, the same seed gives the same shuffle, and both directions (row to
slot, slot to row) are computed from (n, seed) alone.

Defined results: rows with a null key come first; rows equal in every order
column get adjacent numbers in any order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.frames import map_batches, spare_name
from tallybook.operators.ranking import global_row_number

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0..n-1 for a seed."""

    n: int
    seed: int = 0
    rounds: int = 8

    @property
    def _half(self) -> int:
        return max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2)

    def _key(self, i: int) -> np.ndarray:
        key = np.array([(self.seed % 2**64) ^ ((i + 1) * int(_ODD) % 2**64)], np.uint64)
        return _mixed(key)

    def _network(self, x: np.ndarray, rounds: Sequence[int], forward: bool) -> np.ndarray:
        half, mask = np.uint64(self._half), np.uint64((1 << self._half) - 1)
        left, right = x >> half, x & mask
        for i in rounds:
            if forward:
                left, right = right, left ^ (_mixed(right + self._key(i)) & mask)
            else:
                left, right = right ^ (_mixed(left + self._key(i)) & mask), left
        return (left << half) | right

    def _walk(self, x: np.ndarray, rounds: Sequence[int], forward: bool) -> np.ndarray:
        x = self._network(np.asarray(x).astype(np.uint64), rounds, forward)
        while (far := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[far] = self._network(x[far], rounds, forward)
        return x.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        """Where in the shuffle each row number goes."""
        return self._walk(row, range(self.rounds), True)

    def row(self, place: np.ndarray) -> np.ndarray:
        """Which row number is at each place of the shuffle."""
        return self._walk(place, range(self.rounds)[::-1], False)


def shuffled_shards(
    df: DataFrame, order: Sequence[Column], shards: int, seed: int = 0, shard: str = "shard", slot: str = "slot"
) -> DataFrame:
    """Adds shard (0..shards-1) and slot (0.. in each shard) of each row.

    Runs jobs while the frame is built: the rows are range-sorted by ``order`` and
    written once, and counted. Give it narrow rows (keys and sizes) and join the
    texts afterwards by key.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    number = spare_name(df, "_row")
    numbered = global_row_number(df, order, number)
    total = numbered.count()
    if not total:
        return df.withColumns({shard: F.lit(None).cast("int"), slot: F.lit(None).cast("bigint")})
    permutation = Permutation(total, seed)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        place = permutation.place(batch.column(number).to_numpy() - 1)
        return [pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]

    return map_batches(numbered, {shard: T.IntegerType(), slot: T.LongType()}, run).drop(number)

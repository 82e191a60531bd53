"""NTILE of several measures without sorting the table.

A row's bucket depends only on the last rows of the buckets before it. These cut
rows are found by counting: the range of a measure is cut into BINS parts, every
task counts its rows in each part, and the part that holds the wanted rank is cut
again until it holds one value. Rows that share this value are told apart by their
key in the same way. All cuts of all measures are narrowed in the same pass, so a
handful of passes over the table does for any number of rows. A row's bucket is then
one more than the number of cuts before it: no row is shuffled.

The driver gets BINS counts at most for each cut and pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.operators.scratch import materialize

BINS = 1 << 12
_LEAST = -(1 << 62)  # stands for null, which comes first
_MOST = (1 << 62) - 1


@dataclass(frozen=True)
class _Search:
    """A cut that is looked for: the row of this rank among those between low and high."""

    column: str
    rank: int  # from 1
    low: int
    high: int
    value: int | None = None  # known; the key is looked for

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // BINS)

    def bin(self, key: str) -> Column:
        """The part a row is counted in, null for other rows."""
        narrowed = F.col(self.column if self.value is None else key)
        inside = narrowed.between(self.low, self.high)
        if self.value is not None:
            inside = inside & (F.col(self.column) == self.value)
        return F.when(inside, F.call_function("div", narrowed - self.low, F.lit(self.width)))


@dataclass(frozen=True)
class Cut:
    """Rows up to this one, by value and then key, are before the cut; ``key`` is None if all of the value are."""

    value: int
    key: int | None

    def before(self, column: str, key: str) -> Column:
        """Is a row after the cut?"""
        after = F.col(column) > self.value
        return after if self.key is None else after | ((F.col(column) == self.value) & (F.col(key) > self.key))


def _narrowed(search: _Search, counts: dict[int, int], keys: tuple[int, int]) -> _Search | Cut:
    rank = search.rank
    for part in sorted(counts):
        if rank <= counts[part]:
            break
        rank -= counts[part]
    low = search.low + part * search.width
    if search.width > 1:
        return replace(search, rank=rank, low=low, high=min(search.high, low + search.width - 1))
    if search.value is not None:
        return Cut(search.value, low)
    if rank == counts[part]:
        return Cut(low, None)
    return _Search(search.column, rank, *keys, value=low)


def find_cuts(table: DataFrame, key: str, ranks: dict[str, Sequence[int]]) -> dict[str, list[Cut]]:
    """The rows of given ranks (from 1) by each BIGINT column, then by key. Runs a few jobs.

    The key is a BIGINT, unique and not null; values are not null and below 2^62.
    """
    bounds = table.agg(*(f(c).alias(f"{n}_{c}") for c in (key, *ranks) for n, f in (("low", F.min), ("high", F.max)))).first()
    keys = bounds[f"low_{key}"], bounds[f"high_{key}"]
    for column in (key, *ranks):
        if bounds[f"low_{column}"] < _LEAST or bounds[f"high_{column}"] > _MOST:
            raise ValueError(f"{column} holds values beyond 2^62")
    found: dict[tuple[str, int], _Search | Cut] = {
        (c, r): _Search(c, r, bounds[f"low_{c}"], bounds[f"high_{c}"]) for c, wanted in ranks.items() for r in wanted
    }
    while open_ := [s for s in found.values() if isinstance(s, _Search)]:
        # Cuts that are narrowed to the same range share its counts.
        shared = list(dict.fromkeys(replace(s, rank=0) for s in open_))
        bins = F.array(*(s.bin(key) for s in shared))
        counted = table.select(F.posexplode(bins).alias("search", "part")).filter(F.col("part").isNotNull())
        counts: list[dict[int, int]] = [{} for _ in shared]
        for row in counted.groupBy("search", "part").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[row["search"]][row["part"]] = row["n"]
        for at, search in found.items():
            if isinstance(search, _Search):
                found[at] = _narrowed(search, counts[shared.index(replace(search, rank=0))], keys)
    return {c: [found[c, r] for r in wanted] for c, wanted in ranks.items()}


def bucket_ends(rows: int, n: int) -> list[int]:
    """The rank of the last row of each bucket of NTILE(n) but the last; the first rows % n buckets get one row more."""
    size, extra = divmod(rows, n)
    ends = [bucket * size + min(bucket, extra) for bucket in range(1, n)]
    return [end for end in ends if end < rows]


def _as_bigint(df: DataFrame, column: str, descending: bool) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        whole = (F.col(column) * 10**kind.scale).cast("bigint")
    elif isinstance(kind, T.IntegralType):
        whole = F.col(column).cast("bigint")
    else:
        raise TypeError(f"{column} is {kind.simpleString()}; measures are whole numbers or decimals")
    return F.coalesce(-whole if descending else whole, F.lit(_LEAST))


def score_ntiles(df: DataFrame, n: int, key: str, measures: dict[str, tuple[str, bool]]) -> DataFrame:
    """Several NTILE(n) scores of the same rows; rows with equal values are ranked by key.

    ``measures`` maps a score name to (column, descending). Columns hold whole numbers
    or decimals; a null comes before all values. The key is a whole number, unique and
    not null. The frame is written once, and a few jobs read it.
    """
    columns = list(dict.fromkeys(c for c, _ in measures.values()))
    ordered = [_as_bigint(df, c, descending).alias(f"_{score}") for score, (c, descending) in measures.items()]
    table = materialize(df.select(key, *columns, F.col(key).cast("bigint").alias("_key"), *ordered), "measures")
    ends = bucket_ends(table.count(), n)
    cuts = find_cuts(table, "_key", {f"_{score}": ends for score in measures}) if ends else {}
    scores = []
    for score in measures:
        after = [cut.before(f"_{score}", "_key").cast("int") for cut in cuts.get(f"_{score}", [])]
        scores.append(reduce(Column.__add__, after, F.lit(1)).cast("int").alias(score))
    return table.select(key, *columns, *scores)

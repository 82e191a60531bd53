"""An order of rows in which several columns lie close together.

Each column's values are put in cells of about equally many rows, and the bits of the
cells' numbers are interleaved. Rows that are near each other in that order are near
in every one of the columns, so a file that holds a part of the order has a small range
of each, and a filter on any of them skips most files by their minimum and maximum.

The limits of the cells come from one aggregation with a bounded sketch for each column.
Null is in the first cell. A value that fills several cells takes one, and its rows are
told apart by the other columns.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 6
_PREFIX_BYTES = 6  # a double tells 2^53 numbers apart


def _as_number(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Each column as a double that grows with it; of texts, the bytes after what all of them begin with."""
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    octets = {n: F.encode(F.col(n), "utf-8") for n in texts}
    ends = [f(octets[n]).alias(f"{f.__name__}_{i}") for i, n in enumerate(texts) for f in (F.min, F.max)]
    found = df.agg(*ends).first() if texts else None
    numbers = []
    for name in names:
        column, kind = F.col(name), df.schema[name].dataType
        if name in texts:
            i = texts.index(name)
            shared = len(os.path.commonprefix([bytes(found[f"{f}_{i}"] or b"") for f in ("min", "max")]))
            digits = F.rpad(F.hex(F.substring(octets[name], shared + 1, _PREFIX_BYTES)), 2 * _PREFIX_BYTES, "0")
            number = F.conv(digits, 16, 10).cast("double")
        elif isinstance(kind, T.TimestampNTZType):
            number = F.unix_micros(column.cast("timestamp")).cast("double")
        elif isinstance(kind, T.TimestampType):
            number = F.unix_micros(column).cast("double")
        elif isinstance(kind, T.DateType):
            number = F.unix_date(column).cast("double")
        else:
            number = column.cast("double")
        numbers.append(number)
    return numbers


def _spread(bits: int, step: int, first: int) -> list[int]:
    """Each number of some bits with its bits ``step`` places apart, the lowest at ``first``."""
    return [sum((n >> b & 1) << (b * step + first) for b in range(bits)) for n in range(1 << bits)]


def _by_limits(number: Column, limits: Sequence[float], values: Sequence[int]) -> Column:
    """``values[c]``, with c the limits that the number reaches, by halving them: a row is compared ``bits`` times.

    A null reaches none.
    """
    if not limits:
        return F.lit(values[0]).cast("bigint")
    half = len(limits) // 2
    above, below = (limits[half + 1 :], values[half + 1 :]), (limits[:half], values)
    return F.when(number >= F.lit(limits[half]), _by_limits(number, *above)).otherwise(_by_limits(number, *below))


def with_place(df: DataFrame, columns: Sequence[str], out: str, bits: int = BITS) -> DataFrame:
    """Adds the place of each row in the order, a BIGINT below 2^(bits * columns). Runs jobs."""
    if bits * len(columns) > 62:
        raise ValueError(f"{bits} bits for each of {len(columns)} columns do not fit in a BIGINT")
    names = [f"{out}_{i}" for i in range(len(columns))]
    # Numbers are columns of their own, as each is compared with all limits.
    numbered = df.withColumns(dict(zip(names, _as_number(df, columns), strict=True)))
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    limits = numbered.agg(*[F.percentile_approx(n, shares).alias(n) for n in names]).first()
    parts = []
    for i, name in enumerate(names):
        parts.append(_by_limits(F.col(name), sorted(set(limits[name] or ())), _spread(bits, len(columns), i)))
    return numbered.withColumn(out, reduce(Column.__add__, parts)).drop(*names)


def along_curve(df: DataFrame, columns: Sequence[str], key: str, parts: int, bits: int = BITS) -> DataFrame:
    """The rows in ``parts`` partitions along the order, each sorted by it; ``key`` tells rows of one place apart."""
    place = "_place"
    while any(c.startswith(place) for c in df.columns):
        place = f"_{place}"
    placed = with_place(df, columns, place, bits)
    return placed.repartitionByRange(parts, place, key).sortWithinPartitions(place, key).drop(place)

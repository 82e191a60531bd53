"""Adding columns that an Arrow function computes, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batches = Iterable[pa.RecordBatch]


def spare_name(df: DataFrame, name: str) -> str:
    """A name that no column of the frame has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(
    df: DataFrame,
    added: dict[str, T.DataType],
    columns: Callable[[pa.RecordBatch], Sequence[pa.Array]],
    cut: Callable[[Batches], Batches] = lambda batches: batches,
    drop: Sequence[str] = (),
) -> DataFrame:
    """The frame with columns that ``columns`` gives for each batch.

    A column of the frame with an added column's name (in any case) is replaced;
    those in ``drop`` are read but not handed back.
    """
    new = {n.lower() for n in (*added, *drop)}
    kept = [f for f in df.schema if f.name.lower() not in new]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in added.items())])
    places = [df.schema.names.index(f.name) for f in kept]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in places), *columns(batch)], names=schema.names
                )

    return df.mapInArrow(run, schema)

"""Near-duplicate vectors: hyperplane sign hashing, exact cosines, connected components.

A table of the hash takes the signs of a vector's products with random
hyperplanes; vectors with equal signs (and equal labels and lengths) share a
bucket. Two vectors at cosine c agree in one sign with probability
p = 1 - acos(c) / pi, so in one table of b signs with p^b. The number of signs
grows with the logarithm of the number of distinct vectors, and the number of
tables follows from the wanted recall at the threshold itself; above the
threshold recall is higher. All pairs that share a bucket are compared by the
exact cosine in double precision, in tiles of bounded size.

Equal vectors of a label are compared once, as a class with its number of rows.
A pair of classes counts in the first table where it shares a bucket, so each
link counts once. Tables are worked through a few at a time, which bounds what
is on disk at once.

Defined results: a vector that is null, empty or zero, or holds a null or a
non-finite component, links with nothing, as does one with a null label; so do
vectors of different lengths with each other. Rows with a null key have links,
but never name a component (null if no row of it has a key) and are not kept.
Repeated rows are vectors of their own that link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.components import connected_components
from tallybook.llm.frames import map_batches
from tallybook.llm.tiling import UNIT, large_units, merge, sides, small_pairs, tile_units, tree_links, whole_groups
from tallybook.operators.scratch import materialize

BUCKET_ROWS = 256  # aimed at for vectors that point anywhere
TABLES_AT_ONCE = 4
TILE_ROWS = 1024
_SMALL = 32
_PRODUCTS = 1 << 22  # numbers held at a time for pairs of small buckets


def signs_and_tables(classes: int, cosine: float, recall: float) -> tuple[int, int]:
    """(signs in a table, tables) for so many distinct vectors."""
    signs = min(24, max(8, math.ceil(math.log2(max(classes, 1) / BUCKET_ROWS + 1))))
    together = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, 1 if together >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, filled up with zeros to one length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = np.zeros((len(lengths), int(lengths.max(initial=0))))
    matrix[np.arange(matrix.shape[1])[None, :] < lengths[:, None]] = flat
    matrix /= np.abs(matrix).max(axis=1, keepdims=True, initial=0) + (lengths == 0)[:, None]
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _signatures(vectors: pa.Array, signs: int, tables: int, seed: int) -> pa.Array:
    matrix = _matrix(vectors)
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), tables), np.int32)
    powers = 1 << np.arange(signs)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        planes = np.random.default_rng([seed, int(length)]).standard_normal((int(length), tables * signs))
        positive = matrix[rows, :length] @ planes > 0
        out[rows] = positive.reshape(len(rows), tables, signs) @ powers
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), tables).cast(pa.list_(pa.int32()))


def _with_signatures(classes: DataFrame, signs: int, tables: int, seed: int) -> DataFrame:
    return map_batches(
        classes,
        {"_signs": T.ArrayType(T.IntegerType())},
        lambda batch: [_signatures(batch.column("_vector"), signs, tables, seed)],
    )


def _cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, _PRODUCTS // max(1, x.shape[1]))
    parts = [np.einsum("ij,ij->i", x[i[a : a + step]], x[j[a : a + step]]) for a in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _tile_links(x: np.ndarray, rows: np.ndarray, others: np.ndarray | None, cosine: float) -> Iterator[tuple]:
    step = 256
    for a in range(0, len(rows), step):
        tile = rows[a : a + step]
        against = rows[a:] if others is None else others
        for b in range(0, len(against), step):
            other = against[b : b + step]
            near = x[tile] @ x[other].T >= cosine
            if others is None and b == 0:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                yield tile[i], other[j]


def _links(batches, cosine: float) -> Iterator[pa.RecordBatch]:
    """Tree links (a, b) of each unit, and rows (a, null, n): a has n new linked rows."""
    for table, bounds in whole_groups(batches, ["_label", "_length", "_table", "_bucket", *UNIT]):
        column = {name: table.column(name).combine_chunks() for name in ("_class", "_vector", "_signs", "_rows", "_table")}
        column = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in column.items()}
        x, node, size = _matrix(column["_vector"]), column["_class"].to_numpy(), column["_rows"].to_numpy()
        signs = column["_signs"].flatten().to_numpy().reshape(len(node), -1)
        earlier = np.arange(signs.shape[1])[None, :] < column["_table"].to_numpy()[:, None]
        upper, crossed = sides(table)
        labels, more = np.arange(len(node)), np.zeros(len(node), np.int64)

        def count(i: np.ndarray, j: np.ndarray) -> None:
            for a in range(0, len(i), 1 << 16):
                p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                new = ~((signs[p] == signs[q]) & earlier[p]).any(axis=1)
                np.add.at(more, p[new], size[q[new]])
                np.add.at(more, q[new], size[p[new]])

        i, j = small_pairs(bounds, _SMALL)
        meet = ~crossed[i] | (upper[i] != upper[j])
        i, j = i[meet], j[meet]
        near = _cosines(x, i, j) >= cosine
        i, j = i[near], j[near]
        count(i, j)
        labels = merge(labels, i, j)
        for rows, others in large_units(bounds, _SMALL, upper, crossed):
            members = rows if others is None else np.concatenate([rows, others])
            base, own = members.min(), np.arange(len(members))
            for a, b in _tile_links(x, rows, others, cosine):
                count(a, b)
                own = merge(own, a - base, b - base)
            labels[base : base + len(own)] = own + base
        child, parent = tree_links(labels)
        counted = np.flatnonzero(more)
        ends = np.concatenate([node[child], node[counted]])
        other = np.concatenate([node[parent], np.zeros(len(counted), np.int64)])
        linked = np.arange(len(ends)) < len(child)
        n = np.concatenate([np.zeros(len(child), np.int64), more[counted]])
        arrays = [pa.array(ends), pa.array(other, mask=~linked), pa.array(n)]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n"])


def _comparable(vector: Column, label: Column) -> Column:
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_duplicate_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.93,
    recall: float = 0.995,
    seed: int = 6,
) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Runs jobs while the frame is built. ``recall`` is the share of pairs exactly
    at the threshold that share a bucket.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.col(label).alias("_label"))
    rows = rows.withColumn("_hash", F.when(_comparable(F.col("_vector"), F.col("_label")), F.xxhash64("_vector")))
    rows = materialize(rows, "vectors")
    same = ["_hash", "_label", "_vector"]
    grouped = rows.filter("_hash IS NOT NULL").groupBy(*same)
    classes = grouped.agg(F.count(F.lit(1)).alias("_rows"), F.min("_key").alias("_least"))
    classes = materialize(classes.withColumn("_class", F.monotonically_increasing_id()), "classes")
    signs, tables = signs_and_tables(classes.count(), cosine, recall)
    signed = classes.select("_class", "_label", "_vector", "_rows", F.size("_vector").alias("_length"))
    signed = materialize(_with_signatures(signed, signs, tables, seed), "signatures")
    found = []
    for first in range(0, tables, TABLES_AT_ONCE):
        ways = [
            F.struct(F.lit(t).alias("_table"), F.col("_signs")[t].alias("_bucket"))
            for t in range(first, min(first + TABLES_AT_ONCE, tables))
        ]
        dealt = signed.select("*", F.lit(0).alias("_rank"), F.inline(F.array(*ways)))
        bucket = ["_label", "_length", "_table", "_bucket"]
        units = tile_units(dealt, bucket, F.xxhash64("_class"), "_rank", 0, TILE_ROWS)
        found.append(materialize(units.mapInArrow(lambda bs: _links(bs, cosine), "a bigint, b bigint, n bigint"), "pairs"))
    links = reduce(DataFrame.union, found)
    linked = connected_components(links.filter("b IS NOT NULL"))
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_more"))
    merged = classes.drop("_vector", "_label").join(linked, F.col("_class") == F.col("node"), "left").drop("node")
    merged = merged.join(counts, F.col("_class") == F.col("_node"), "left").select(
        "_class", "_least", "_rows", F.coalesce("_more", F.lit(0)).alias("_more"), F.coalesce("component", "_class").alias("_group")
    )
    merged = materialize(merged, "groups")
    least = materialize(merged.groupBy(F.col("_group").alias("_root")).agg(F.min("_least").alias("component_id")), "least")
    named = merged.join(least, F.col("_group") == F.col("_root")).select("_class", "_rows", "_more", "component_id")
    named = materialize(classes.select("_class", *same).join(named, "_class"), "components")
    on = reduce(Column.__and__, (rows[c] == named[c] for c in same))
    alone = rows["_hash"].isNull()
    return rows.join(named, on, "left").select(
        rows["_key"].alias(key),
        F.when(alone, F.lit(0)).otherwise(F.col("_rows") - 1 + F.col("_more")).cast("bigint").alias("n_links"),
        F.when(alone, rows["_key"]).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(rows["_key"] == F.when(alone, rows["_key"]).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )

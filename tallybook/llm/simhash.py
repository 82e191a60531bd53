"""SimHash fingerprints and near-duplicate groups by bit distance.

The fingerprint of a text: A-Z in lower case, words cut at ASCII white space,
every run of ``shingle`` words joined by single spaces (repeats included; fewer
words: the whole sequence), each run hashed by XXH64; a bit is set if it is set
in over half of the hashes. No words: zero.

Two fingerprints link at ``distance`` or fewer different bits. Equal fingerprints
are one row. Since that many differences cannot touch all of distance + 1 blocks
of bits, linked fingerprints agree in a block; rows that do are compared by exact
tiles: numpy exclusive-or and bit counts, skipping tile pairs whose population
counts differ by more than the distance. A unit of comparison hands on a tree for
each of its components, not all its links; the components are the same.

Defined results: a null text is empty; empty texts have fingerprint zero and link
like any other; rows with a null id have a component but never name one (null if
no row of the component has an id); rows with a null fingerprint have a null
component; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.components import connected_components
from tallybook.llm.frames import map_batches, spare_name
from tallybook.llm.text import offsets_of, slices, words_of
from tallybook.llm.tiling import UNIT, large_units, merge, sides, small_pairs, tile_units, tree_links, whole_groups
from tallybook.operators.scratch import materialize

SEED = 42
TILE_ROWS = 1024
_STEP = 512  # rows of a numpy tile
_SMALL = 32  # groups up to this size are compared together
_RUN = 255  # counts that fit one byte

# Bit k of a byte in byte lane k.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes; zero for no hashes."""
    result = np.zeros((len(counts), 64), bool)
    filled = np.flatnonzero(counts)
    if len(filled):
        sizes = counts[filled]
        runs = -(-sizes // _RUN)
        first_run = offsets_of(runs)[:-1]
        in_text = np.arange(runs.sum()) - np.repeat(first_run, runs)
        starts = np.repeat(offsets_of(sizes)[:-1], runs) + in_text * _RUN
        octets = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones = np.empty((len(filled), 64), np.int64)
        for octet in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, octet]], starts)
            bits = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[:, octet * 8 : octet * 8 + 8] = np.add.reduceat(bits.astype(np.int64), first_run, axis=0)
        result[filled] = 2 * ones > sizes[:, None]
    return np.packbits(result, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    words, counts = words_of(texts)
    if not len(words):
        return np.zeros(len(counts), np.uint64)
    spaced = pc.binary_join_element_wise(words, "", " ").cast(pa.large_binary())
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[: len(spaced) + 1]
    joined = memoryview(spaced.buffers()[2])
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.repeat(offsets_of(counts)[:-1], shingles)
    first += np.arange(len(first)) - np.repeat(offsets_of(shingles)[:-1], shingles)
    last = first + np.repeat(np.minimum(counts, shingle), shingles)
    digest = xxhash.xxh64_intdigest
    spans = zip(ends[first].tolist(), (ends[last] - 1).tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(first))
    return majority(hashes, shingles)


def with_fingerprint(
    df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3, drop: Sequence[str] = ()
) -> DataFrame:
    """Adds the fingerprint as a BIGINT with the same bits and leaves out the columns in ``drop``."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(fingerprints(batch.column(text), shingle).view(np.int64))]

    return map_batches(df, {out: T.LongType()}, run, lambda bs: slices(bs, text), drop)


def _tile_links(x: np.ndarray, rows: np.ndarray, others: np.ndarray | None, distance: int) -> Iterator[tuple]:
    """Index pairs within the distance, tile by tile; without ``others`` the rows are compared with themselves."""
    ones = np.bitwise_count(x).astype(np.int64)
    rows = rows[np.argsort(ones[rows], kind="stable")]
    within = others is None
    others = rows if within else others[np.argsort(ones[others], kind="stable")]
    for a in range(0, len(rows), _STEP):
        tile = rows[a : a + _STEP]
        for b in range(a if within else 0, len(others), _STEP):
            other = others[b : b + _STEP]
            if ones[other[0]] - ones[tile[-1]] > distance or ones[tile[0]] - ones[other[-1]] > distance:
                continue
            near = np.bitwise_count(x[tile][:, None] ^ x[other][None, :]) <= distance
            if within and a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                yield tile[i], other[j]


def _links(batches, distance: int) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole_groups(batches, ["_block", "_value", *UNIT]):
        x = table.column("_print").to_numpy().view(np.uint64)
        upper, crossed = sides(table)
        i, j = small_pairs(bounds, _SMALL)
        near = (np.bitwise_count(x[i] ^ x[j]) <= distance) & (~crossed[i] | (upper[i] != upper[j]))
        labels = merge(np.arange(len(x)), i[near], j[near])
        for rows, others in large_units(bounds, _SMALL, upper, crossed):
            members = rows if others is None else np.concatenate([rows, others])
            base, own = members.min(), np.arange(len(members))
            for a, b in _tile_links(x, rows, others, distance):
                own = merge(own, a - base, b - base)
            labels[base : base + len(own)] = own + base
        child, parent = tree_links(labels)
        ends = [pa.array(x[rows].view(np.int64)) for rows in (child, parent)]
        yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _blocks(prints: DataFrame, distance: int) -> DataFrame:
    """Each fingerprint once for each of distance + 1 blocks of its bits."""
    edges = [64 * k // (distance + 1) for k in range(distance + 2)]
    blocks = []
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        value = F.shiftrightunsigned("_print", low)
        if high - low < 64:
            value = value.bitwiseAND((1 << (high - low)) - 1)
        blocks.append(F.struct(F.lit(k).alias("_block"), value.alias("_value")))
    ones = F.bit_count("_print").cast("int")
    return prints.select("_print", ones.alias("_ones"), F.inline(F.array(*blocks)))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", fingerprint: str = "fingerprint", distance: int = 2, out: str = "component_id"
) -> DataFrame:
    """Adds the smallest key reachable over links of fingerprints.

    Runs jobs while the frame is built. ``df`` is read several times; pass a
    written table.
    """
    known = df.filter(F.col(fingerprint).isNotNull())
    prints = materialize(known.groupBy(F.col(fingerprint).alias("_print")).agg(F.min(key).alias("_least")), "prints")
    blocks = _blocks(prints.select("_print"), distance)
    units = tile_units(blocks, ["_block", "_value"], F.xxhash64("_print"), "_ones", distance, TILE_ROWS)
    links = units.mapInArrow(lambda batches: _links(batches, distance), "a bigint, b bigint")
    linked = connected_components(links)
    merged = prints.join(linked, F.col("_print") == F.col("node"), "left")
    merged = materialize(merged.select("_print", "_least", F.coalesce("component", "_print").alias("_root")), "groups")
    least = merged.groupBy(F.col("_root").alias("_of")).agg(F.min("_least").alias("_smallest"))
    named = merged.join(materialize(least, "least"), F.col("_root") == F.col("_of"))
    mark, found = spare_name(df, "_print"), spare_name(df, "_smallest")
    named = materialize(named.select(F.col("_print").alias(mark), F.col("_smallest").alias(found)), "components")
    joined = df.join(named, F.col(fingerprint) == F.col(mark), "left").drop(mark)
    return joined.drop(out).withColumnRenamed(found, out)

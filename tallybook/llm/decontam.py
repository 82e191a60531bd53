"""Passages of benchmark items in documents.

Every item slides over a document in windows of as many words as the item has (a
shorter document is one window). A window is described by its shingles: runs of
``shingle`` words, weighted by how often they occur (a text with fewer words is
one shingle). Windows are found by SimHash: a window is a candidate for an item
if their 64-bit fingerprints differ in at most RADIUS bits. Fingerprints are cut
into BLOCKS blocks; two of them that far apart at most differ by RADIUS // BLOCKS
bits or fewer in some block, so an index of the items by block value with that
many bits flipped holds every item within the radius (multi-index Hamming
search). Candidates count if their exact weighted-shingle similarity, the sum of
the smaller weights over the sum of the larger, reaches ``similarity``. At 0.8,
fingerprints differ in about 9 bits, and in over RADIUS for fewer than two windows
in a thousand. That does not hold for repetitive or very short items, whose bits may
stand at a tie: items that repeat a shingle or have fewer than FEW are compared
exactly with every window that has enough of their shingles.

Only windows that can pass are fingerprinted: a window of similarity s or more
must have at least s times the item's shingles in common with it, so at least so
many of its shingles occur in the benchmark. That test is exact and loses none.

Items are read in blocks of bounded size, each handed to all tasks; every block
is compared with all documents. Items with equal texts are compared once, under
the smallest item id.

Words are cut at ASCII white space, A-Z in lower case. Defined results: null or
empty texts and items match nothing; an item without an id gives a null id; all
rows are kept, repeated ones too.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.frames import map_batches, spare_name
from tallybook.llm.simhash import majority
from tallybook.llm.text import codes_of, offsets_of, slices, words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
FEW = 9  # different shingles, from which on fingerprints are trusted
ITEM_BYTES = 4 << 20  # of item texts in a block
_BITS = 64 // BLOCKS
_FILTER_BITS = 22
_HASHED = 1 << 18  # shingle hashes held at a time for windows
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total = total * _FACTOR + words[k : k + len(total)]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9) ^ (total >> np.uint64(32))


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _weights(words: Sequence[str], size: int) -> Counter:
    return Counter(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger."""
    common = sum((a & b).values())
    return common / (a.total() + b.total() - common)


class _ItemsOfLength:
    """The items of one number of words, found by fingerprint."""

    def __init__(self, words: int, shingle: int) -> None:
        self.words, self.size = words, min(words, shingle)
        self.shingles = words - self.size + 1
        self.ids: list = []
        self.weights: list[Counter] = []
        self.prints = np.zeros(0, np.uint64)
        self.unsure: dict[int, list[int]] = defaultdict(list)  # items compared exactly, by hash of their shingles
        self._starts: list[np.ndarray] = []
        self._rows: list[np.ndarray] = []

    def build(self, prints: np.ndarray) -> None:
        """Lists the items under each block value within RADIUS // BLOCKS bits of their own."""
        self.prints = prints
        flips = [sum(1 << b for b in f) for n in range(RADIUS // BLOCKS + 1) for f in itertools.combinations(range(_BITS), n)]
        for k in range(BLOCKS):
            own = (prints >> np.uint64(k * _BITS)).astype(np.int64) & ((1 << _BITS) - 1)
            values = (own[:, None] ^ np.array(flips)[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self._rows.append(order // len(flips))
            self._starts.append(np.searchsorted(values[order], np.arange((1 << _BITS) + 1)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        found = []
        for k in range(BLOCKS):
            value = (prints >> np.uint64(k * _BITS)).astype(np.int64) & ((1 << _BITS) - 1)
            first = self._starts[k][value]
            sizes = self._starts[k][value + 1] - first
            window = np.repeat(np.arange(len(prints)), sizes)
            place = np.repeat(first - offsets_of(sizes)[:-1], sizes) + np.arange(len(window))
            found.append(window * len(self.prints) + self._rows[k][place])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(self.prints), pairs % len(self.prints)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[close], item[close]


class ItemIndex:
    """A block of items, ready to be looked for."""

    def __init__(self, items: Sequence[tuple], shingle: int, similarity: float) -> None:
        self.shingle, self.similarity = shingle, similarity
        self.lengths: dict[int, _ItemsOfLength] = {}
        hashes, known = defaultdict(list), defaultdict(list)
        flat, counts = words_of(pa.array([text for _, text in items], pa.string()))
        words, ends = flat.to_pylist(), offsets_of(counts)
        for (key, _), begin, end in zip(items, ends, ends[1:], strict=False):
            if begin == end:
                continue
            own = words[begin:end]
            group = self.lengths.setdefault(len(own), _ItemsOfLength(len(own), shingle))
            group.ids.append(key)
            group.weights.append(_weights(own, group.size))
            shingles = _shingle_hashes(_word_hashes(own), group.size)
            if len(group.weights[-1]) < max(FEW, group.shingles):
                for value in np.unique(shingles).tolist():
                    group.unsure[value].append(len(group.ids) - 1)
            hashes[len(own)].append(shingles)
            known[group.size].append(shingles)
        for length, group in self.lengths.items():
            each = np.concatenate(hashes[length])
            group.build(majority(each, np.full(len(group.ids), group.shingles)))
        self.known = {size: np.unique(np.concatenate(parts)) for size, parts in known.items()}
        self._filter = {}
        for size, values in self.known.items():
            self._filter[size] = np.zeros(1 << _FILTER_BITS, bool)
            self._filter[size][(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _hits(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Which shingles occur in the block."""
        maybe = self._filter[size][(shingles >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        rows = np.flatnonzero(maybe)
        maybe[rows] = np.isin(shingles[rows], self.known[size])
        return maybe

    def search(self, texts: pa.Array) -> list[list[dict]]:
        """The items found in each text, in the order of their place."""
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        flat, counts = words_of(texts)
        codes, distinct = codes_of(flat)
        words = _word_hashes(distinct.to_pylist())[codes] if len(codes) else np.zeros(0, np.uint64)
        ends = offsets_of(counts)
        shingles = {size: _shingle_hashes(words, size) for size in self.known}
        hits = {size: self._hits(values, size) for size, values in shingles.items()}
        seen = {size: offsets_of(values) for size, values in hits.items()}
        for doc in self._with_hits(seen, ends):
            begin, end = int(ends[doc]), int(ends[doc + 1])
            own = flat.slice(begin, end - begin).to_pylist()
            best: dict[tuple, tuple] = {}
            for group in self.lengths.values():
                width = min(group.words, end - begin)
                count = width - group.size + 1  # shingles in a window
                if count < 1:
                    continue
                first = np.arange(begin, end - width + 1)
                enough = math.ceil(self.similarity * group.shingles - 1e-9)
                in_window = seen[group.size][first + count] - seen[group.size][first]
                self._verify(group, first[in_window >= max(1, enough)], count, shingles[group.size], own, begin, width, best)
            rows = [
                {"item_id": group.ids[item], "similarity": s, "distance": d, "start_word": at, "n_words": width}
                for (group, item), (s, d, at, width) in best.items()
            ]
            found[doc] = sorted(rows, key=lambda r: (r["start_word"], r["n_words"], r["item_id"] is None, r["item_id"]))
        return found

    def _with_hits(self, seen: dict[int, np.ndarray], ends: np.ndarray) -> np.ndarray:
        """Documents with a shingle of the block (or one that reaches over its end)."""
        some = np.zeros(len(ends) - 1, bool)
        for total in seen.values():
            at = np.minimum(ends, len(total) - 1)
            some |= total[at[1:]] > total[at[:-1]]
        return np.flatnonzero(some)

    def _unsure(self, group: _ItemsOfLength, shingles: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) pairs of the items whose fingerprints are not trusted that have enough shingles in common."""
        if not group.unsure:
            return set()
        enough, pairs = self.similarity * group.shingles - 1e-9, set()
        hits = np.isin(shingles, np.fromiter(group.unsure, np.uint64, len(group.unsure)))
        for window in np.flatnonzero(hits.sum(axis=1) >= enough).tolist():
            shared = Counter(item for value in shingles[window][hits[window]].tolist() for item in group.unsure[value])
            pairs.update((window, item) for item, n in shared.items() if n >= enough)
        return pairs

    def _verify(self, group, first, count, shingles, own, begin, width, best) -> None:
        step = max(1, _HASHED // count)
        for a in range(0, len(first), step):
            part = first[a : a + step]
            own_shingles = shingles[part[:, None] + np.arange(count)]
            prints = majority(own_shingles.ravel(), np.full(len(part), count))
            pairs = set(zip(*(x.tolist() for x in group.near(prints)), strict=True))
            for window, item in sorted(pairs | self._unsure(group, own_shingles)):
                at = int(part[window]) - begin
                s = weighted_similarity(_weights(own[at : at + width], group.size), group.weights[item])
                if s >= self.similarity and s > best.get((group, item), (0,))[0]:
                    distance = int(np.bitwise_count(prints[window] ^ group.prints[item]))
                    best[(group, item)] = (s, distance, at, width)


@lru_cache(maxsize=1)
def _index(items: Broadcast, shingle: int, similarity: float) -> ItemIndex:
    return ItemIndex(items.value, shingle, similarity)


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The distinct item texts, with their smallest id, in blocks of bounded size."""
    distinct = items.groupBy(F.col(text).alias("_text")).agg(F.min(key).alias("_key")).filter("octet_length(_text) > 0")
    size = distinct.agg(F.sum(F.octet_length("_text") + F.lit(16))).first()[0] or 0
    blocks = math.ceil(size / ITEM_BYTES)
    block = F.pmod(F.xxhash64("_text"), F.lit(max(blocks, 1)))
    for k in range(blocks):
        yield [(r["_key"], r["_text"]) for r in distinct.filter(block == k).collect()]


def with_leaks(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    out: str = "leaks",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Adds the items found in each text and leaves out the columns in ``drop``.

    An element has item_id, similarity, distance (bits), and start_word and n_words
    of the most similar window, the first of equal ones. Reads the items while the
    frame is built.
    """
    key_type = items.schema[item_key].dataType
    fields = [("item_id", key_type), ("similarity", T.DoubleType()), ("distance", T.IntegerType())]
    fields += [("start_word", T.LongType()), ("n_words", T.LongType())]
    leaks = T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))
    columns: list[str] = []
    for block in _item_blocks(items, item_key, item_text):
        shared = df.sparkSession.sparkContext.broadcast(block)
        name = spare_name(df, f"_leaks_{len(columns)}")
        df = map_batches(df, {name: leaks}, _searcher(shared, shingle, similarity, text, leaks), lambda bs: slices(bs, text))
        columns.append(name)
    found = F.concat(*columns) if columns else F.array().cast(leaks)
    return df.withColumn(out, found).drop(*columns, *drop)


def _searcher(shared: Broadcast, shingle: int, similarity: float, text: str, leaks: T.ArrayType):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(leaks)
    return lambda batch: [pa.array(_index(shared, shingle, similarity).search(batch.column(text)), arrow)]

"""What the two word taggers share: bounded samples of labelled texts, and words as chains."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.crf import letters_of
from tallybook.llm.text import codes_of, offsets_of, words_of
from tallybook.operators.scratch import materialize

# The models are fitted on a bounded sample: at most so many distinct texts of a
# label, and so many bytes of text of a label. Texts are used whole; only of a label
# whose texts are all over the bound, the beginning of one is used.
SAMPLE_TEXTS = 1200
SAMPLE_BYTES = 3_000_000
_MET = 0.99  # the byte bound is met from this share on


@dataclass
class Chains:
    """The words with letters of some texts."""

    words: list[str]  # distinct, letters only, in lower case
    codes: np.ndarray  # of each word
    lengths: np.ndarray  # words with letters of each text
    places: np.ndarray  # number of each word among all words of its text

    @classmethod
    def of(cls, texts: pa.Array) -> Chains:
        flat, counts = words_of(texts)
        codes, distinct = codes_of(flat)
        words = letters_of(distinct.to_pylist())
        lettered = np.fromiter(map(bool, words), bool, len(words))[codes]
        ends = offsets_of(lettered)[offsets_of(counts)]
        places = np.arange(len(codes)) - np.repeat(offsets_of(counts)[:-1], counts)
        return cls(words, codes[lettered], np.diff(ends), places[lettered])

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def text_marks(text: str = "text") -> list[Column]:
    """What stands for a text where only its label matters: its hash and its size."""
    return [F.xxhash64(text).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes")]


def _picked(rows: DataFrame, most: int, most_bytes: int) -> list[int]:
    """Hashes of (hash, bytes) rows in the order of a hash of them, without those that no longer fit, until a bound is met."""
    order, after, left = F.xxhash64("hash"), F.lit(True), most_bytes
    picked: list[int] = []
    while len(picked) < most and left > (1 - _MET) * most_bytes:
        fitting = rows.filter(after & (F.col("bytes") <= left)).select(order.alias("place"), "hash", "bytes")
        found = fitting.orderBy("place", "hash").limit(most).collect()
        for r in found:
            if r["bytes"] <= left and len(picked) < most:
                picked.append(r["hash"])
                left -= r["bytes"]
        if len(found) < most:
            break
        place, last = found[-1]["place"], found[-1]["hash"]
        after = (order > place) | ((order == place) & (F.col("hash") > last))
    if not picked:
        picked = [r["hash"] for r in rows.orderBy(order, "hash").limit(1).collect()]
    return picked


def labelled_sample(
    texts: DataFrame, labelled: DataFrame, text: str = "text", most: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES
) -> dict[object, list[str]]:
    """Up to ``most`` distinct texts of each label with up to ``most_bytes`` in all, picked by a hash of the text.

    ``labelled`` has a row (label, hash, bytes) for each labelled text. Equal texts
    of a label count once, empty ones not at all. A text that does not fit is left
    out, and the ones after it are looked at. Only hashes are joined and ranked;
    the picked texts are read in a second pass. Runs jobs.
    """
    known = labelled.filter(F.col("label").isNotNull() & (F.col("bytes") > 0)).distinct()
    known = materialize(known, "labelled")
    picked: dict[object, list[int]] = {}
    for (value,) in known.select("label").distinct().collect():
        picked[value] = _picked(known.filter(F.col("label") == value), most, most_bytes)
    if not picked:
        return {}
    hashes = sorted({h for each in picked.values() for h in each})
    # At most ``most`` hashes of each label.
    wanted = F.broadcast(texts.sparkSession.createDataFrame([(h,) for h in hashes], "hash bigint"))
    # A character has four bytes at most.
    whole = F.octet_length(text) <= most_bytes
    bounded = F.when(whole, F.col(text)).otherwise(F.left(text, F.lit(max(1, most_bytes // 4))))
    found = texts.select(F.xxhash64(text).alias("hash"), bounded.alias("text")).join(wanted, "hash", "left_semi")
    by_hash = {r["hash"]: r["text"] for r in found.groupBy("hash").agg(F.min("text").alias("text")).collect()}
    return {value: [by_hash[h] for h in sorted(picked[value]) if h in by_hash] for value in sorted(picked)}


def fitted(spark: SparkSession, fit: Callable, sample: dict) -> object:
    """``fit(sample)``, run in a task: the sample is small, but fitting takes memory that the driver needs."""
    shared = spark.sparkContext.broadcast(sample)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(shared.value))], pa.binary())], names=["model"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(run, "model binary").first()["model"])


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))

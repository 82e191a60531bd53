"""Text quality by naive Bayes support vectors.

Features are n-grams that a text has or has not: single words and pairs of
neighbouring words, in lower case, and one, two or three neighbouring words by
their shape. A shape keeps what vocabulary hides: capitals, small letters and
digits as one letter for each run of them, all other characters as they are, and
a mark of its own for a word that repeats the one before it. N-grams are hashed to
2^BITS buckets.

The log-count ratio of a feature compares how often it occurs in good and in bad
texts; it is counted over all labelled texts, by Spark. Scaled by its ratios and to
length one, a text is a sparse vector, and dual coordinate descent fits a linear
model to them with the hinge loss: it goes through the texts in random order and
moves each text's dual weight to its best value, between 0 and a bound that weighs
both labels alike, until no weight moves much. This fit takes a bounded sample of
texts (``most`` and ``most_bytes`` for each label). The score is a logistic curve
over the distance from the separating plane, fitted to the sample as well.

Defined results: null texts, and texts without words, have no features; their
score is the curve's value for distance zero plus the model's constant. If either
label is missing, nothing can be learned and every score is the share of good
texts (0 without any). Rows with a null label or key do not teach; a key that
occurs in several rows of either table pairs with each row of the other. Columns of
the frame with the names of added ones, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.frames import map_batches
from tallybook.llm.runs import split_words
from tallybook.llm.tagging import fitted, labelled_sample, text_marks
from tallybook.llm.text import codes_of, offsets_of, slices

BITS = 18
SAMPLE_TEXTS = 2000
SAMPLE_BYTES = 6_000_000
#: Up to so many labels (of some 30 bytes) go to every task; more are joined to the texts by a shuffle.
BROADCAST_LABELS = 1_000_000
_SMOOTH = 1.0  # added to every count
_PENALTY = 1.0  # bound of a dual weight, before labels are weighed
_ROUNDS = 40
_STILL = 1e-3  # the fit ends when no dual weight's slope is larger

# What keeps the kinds of n-grams apart, and the shape of a repeated word.
_KINDS = [np.uint64(xxhash.xxh64_intdigest(k)) for k in ("word", "pair", "shape", "shapes 2", "shapes 3")]
_SAME = np.uint64(xxhash.xxh64_intdigest("repeated"))
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _shapes(words: pa.Array) -> pa.Array:
    # Unicode's classes of small, other and capital letters, and of digits.
    for pattern, sign in ((r"(\p{Ll}|\p{Lo}|\p{Lm}|\p{Lt}|\p{M})+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, sign)
    return words


def _buckets(kind: int, *parts: np.ndarray) -> np.ndarray:
    mixed = np.full(len(parts[0]), _KINDS[kind], np.uint64)
    for part, times in zip(parts, _MIX):
        mixed = (mixed ^ part) * times
        mixed ^= mixed >> np.uint64(29)
    return (mixed * _MIX[0]) >> np.uint64(64 - BITS)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature that a text has, once each, by text."""
    words, counts = split_words(texts)
    codes, distinct = codes_of(words)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    word = _hashes(pc.utf8_lower(distinct))[codes]
    shape = _hashes(_shapes(distinct))[codes]
    one = owner[1:] == owner[:-1]  # the next word is of the same text
    shape[1:][one & (word[1:] == word[:-1])] = _SAME
    two = one[1:] & one[:-1] if len(one) else one
    keys = [(owner << np.uint64(BITS)) | _buckets(k, part) for k, part in ((0, word), (2, shape))]
    for kind, part in ((1, word), (3, shape)):
        keys.append((owner[1:][one] << np.uint64(BITS)) | _buckets(kind, part[:-1][one], part[1:][one]))
    keys.append((owner[2:][two] << np.uint64(BITS)) | _buckets(4, shape[:-2][two], shape[1:-1][two], shape[2:][two]))
    found = np.sort(np.concatenate(keys))
    found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
    return (found >> np.uint64(BITS)).astype(np.int64), (found & np.uint64((1 << BITS) - 1)).astype(np.int64)


def log_count_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """How much likelier each feature is in good than in bad texts, as a logarithm; counts are smoothed."""
    good, bad = good + _SMOOTH, bad + _SMOOTH
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def _scaled(text: np.ndarray, bucket: np.ndarray, ratios: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each text's features, their values, the values of a text being of length one)."""
    value = ratios[bucket]
    length = np.sqrt(np.bincount(text, value * value, texts))
    return offsets_of(np.bincount(text, minlength=texts)), value / np.where(length > 0, length, 1)[text]


def dual_coordinate_descent(
    bounds: np.ndarray,
    column: np.ndarray,
    value: np.ndarray,
    sign: np.ndarray,
    bound: np.ndarray,
    width: int,
    rounds: int = _ROUNDS,
    still: float = _STILL,
    seed: int = 1,
) -> np.ndarray:
    """Weights (the last one is the constant) of the linear model with the least hinge loss.

    Row i has ``value[a:b]`` in ``column[a:b]`` with a, b = bounds[i : i + 2], and a one in the
    last place. Minimises |w|^2 / 2 + sum of bound * max(0, 1 - sign * w.x) through its dual,
    in at most so many rounds, or until no dual weight's slope is over ``still`` in one.
    """
    weights, dual = np.zeros(width + 1), np.zeros(len(sign))
    square = np.bincount(np.repeat(np.arange(len(sign)), np.diff(bounds)), value * value, len(sign)) + 1
    rows = [(column[a:b], value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in random.permutation(len(sign)):
            at, x = rows[i]
            slope = sign[i] * (weights[at] @ x + weights[-1]) - 1
            if (dual[i] <= 0 and slope > 0) or (dual[i] >= bound[i] and slope < 0):
                continue
            largest = max(largest, abs(slope))
            before = dual[i]
            dual[i] = min(max(before - slope / square[i], 0), bound[i])
            step = (dual[i] - before) * sign[i]
            weights[at] += step * x  # a row has no column twice
            weights[-1] += step
        if largest < still:
            break
    return weights


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _curve(distance: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve, by Newton steps; both labels weigh alike."""
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum()) * len(good)
    inputs = np.stack([distance, np.ones(len(distance))], axis=1)
    curve = np.array([1.0, 0.0])
    for _ in range(100):
        p = _logistic(inputs @ curve)
        slope = inputs.T @ (weight * (good - p)) - 0.1 * (curve - [1.0, 0.0])
        bend = (inputs * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ inputs + 0.1 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        curve += step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(curve[0], 1e-3)), float(curve[1])


@dataclass
class QualityModel:
    ratios: np.ndarray | None  # None: nothing was learned
    weights: np.ndarray  # of the scaled features; the last one is the constant
    curve: tuple[float, float]
    constant: float = 0.0

    def distances(self, texts: pa.Array) -> np.ndarray:
        text, bucket = features(texts)
        _, value = _scaled(text, bucket, self.ratios, len(texts))
        return np.bincount(text, value * self.weights[bucket], len(texts)) + self.weights[-1]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(texts), self.constant)
        slope, constant = self.curve
        return _logistic(slope * self.distances(texts) + constant)


def fit(ratios: np.ndarray, sample: Mapping[int, Sequence[str]]) -> QualityModel:
    """A model from the ratios and a sample of texts by label."""
    bad, good = sample.get(0, []), sample.get(1, [])
    if not bad or not good:
        return QualityModel(None, np.zeros(1), (1.0, 0.0), 1.0 if good else 0.0)
    texts = pa.array([*bad, *good], pa.string())
    is_good = np.arange(len(texts)) >= len(bad)
    text, bucket = features(texts)
    bounds, value = _scaled(text, bucket, ratios, len(texts))
    bound = _PENALTY * np.where(is_good, 0.5 / len(good), 0.5 / len(bad)) * len(texts)
    weights = dual_coordinate_descent(bounds, bucket, value, np.where(is_good, 1.0, -1.0), bound, 1 << BITS)
    distance = np.bincount(text, value * weights[bucket], len(texts)) + weights[-1]
    return QualityModel(ratios.astype(np.float32), weights.astype(np.float32), _curve(distance, is_good))


def _class_counts(labelled: DataFrame, text: str) -> DataFrame:
    """(bucket, good, bad): how many texts of each label have the feature."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches, text):
            label = batch.column("label").to_numpy()
            owner, bucket = features(batch.column(text))
            for value in (0, 1):
                counts[value] += np.bincount(bucket[label[owner] == value], minlength=1 << BITS)
        seen = np.flatnonzero(counts.any(axis=0))
        arrays = [seen.astype(np.int32), counts[1, seen], counts[0, seen]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["bucket", "good", "bad"])

    partial = labelled.select(F.col("label").cast("int").alias("label"), text).mapInArrow(run, "bucket int, good bigint, bad bigint")
    return partial.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def learn(
    texts: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    most: int = SAMPLE_TEXTS,
    most_bytes: int = SAMPLE_BYTES,
) -> QualityModel:
    """A model from the texts with a 0/1 label. Runs jobs.

    Ratios are counted over all of them; at most ``most`` texts and ``most_bytes`` of
    each label, picked by a hash of the text, go into the fit. What reaches the driver
    is that sample, and 2^BITS counts. Texts are shuffled only where the labels are too
    many to broadcast.
    """
    known = labels.select(key, F.col(label).alias("label")).filter(F.col("label").isin(0, 1))
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known.hint("merge")
    labelled = texts.select(key, text).join(known, key)
    marks = texts.select(key, *text_marks(text)).join(known, key).select("label", "hash", "bytes")
    sample = labelled_sample(texts, marks, text, most, most_bytes)
    counts = np.zeros((2, 1 << BITS))
    table = _class_counts(labelled, text).toArrow()
    for row, name in enumerate(("bad", "good")):
        counts[row, table["bucket"].to_numpy()] = table[name].to_numpy()
    ratios = log_count_ratios(counts[1], counts[0])
    return fitted(texts.sparkSession, lambda shared: fit(shared[0], shared[1]), (ratios, sample))


def with_quality(
    df: DataFrame, model: QualityModel, text: str = "text", score: str = "score", drop: Sequence[str] = ()
) -> DataFrame:
    """Adds the score, from 0 to 1, higher for better texts; leaves out the columns in ``drop``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 3 MB, whatever the corpus

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(shared.value.score(batch.column(text)).astype(np.float64))]

    return map_batches(df, {score: T.DoubleType()}, run, lambda bs: slices(bs, text), drop)

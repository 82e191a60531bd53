"""Toxic spans and document scores from a linear-chain conditional random field.

Labels say which documents are toxic, not which words. Words of the sample are
tagged first: a word is evidence if it, or one of its prefixes, occurs almost
only in toxic texts, and in enough of them that are not copies of each other.
Evidence in a toxic text is tagged toxic, everything else clean. The field is
fitted to these tags, so it learns the weights of words and affixes and how tags
follow each other. The marginals of a text's words then give its expected number
of toxic words; a logistic curve over that number and its share, fitted to the
sample's document labels, is the score. Runs of words with a marginal of at least
one half are the offending spans.

Defined results: null texts and texts without letters have no words and get the
score of no toxic words. If either label is missing from the sample, nothing can
be learned, and every score is the share of toxic labels in it (0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm import crf
from tallybook.llm.frames import map_batches
from tallybook.llm.tagging import Chains, fitted, labelled_sample, text_marks
from tallybook.llm.text import slices

FEATURES = crf.Features(prefixes=(3, 4, 5, 6), suffixes=(3, 4))
_PREFIXES = (4, 5, 6)
_CHANCE = 1e-5  # that a piece's texts are all toxic if labels were dealt at random
_PURITY = 0.95  # of the texts with evidence that are toxic, both labels weighted alike
_SKETCH = 64  # hashes in a sketch of a text
_COPY = 0.8  # of the sketch: from this share on, texts are copies of each other
_NOTICED = 0.1  # smaller marginals do not count towards a text's expected number
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]
    )
)


@dataclass
class ToxicityModel:
    field: crf.Model | None
    curve: np.ndarray  # of constant, expected number and share, the latter two as logarithms
    constant: float = 0.0

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple]]]:
        """(score of each text, its offending spans in characters)."""
        if self.field is None:
            return np.full(len(texts), self.constant), [[] for _ in range(len(texts))]
        chains = Chains.of(texts)
        toxic = self.field.marginals(chains.words, chains.codes, chains.lengths)[:, 1]
        scores = _logistic(_summary(chains, toxic) @ self.curve)
        return scores, _spans(texts, chains, toxic)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _summary(chains: Chains, toxic: np.ndarray) -> np.ndarray:
    number = np.bincount(chains.texts(), np.where(toxic >= _NOTICED, toxic, 0), len(chains.lengths))
    share = number / np.maximum(chains.lengths, 1)
    return np.stack([np.ones(len(number)), np.log1p(number), np.log(share + 1e-3)], axis=1)


def _spans(texts: pa.Array, chains: Chains, toxic: np.ndarray) -> list[list[tuple]]:
    spans: list[list[tuple]] = [[] for _ in range(len(texts))]
    offending = np.flatnonzero(toxic >= 0.5)
    owners = chains.texts()[offending]
    for text in np.unique(owners):
        rows = offending[slice(*np.searchsorted(owners, [text, text + 1]))]
        found = [m.span() for m in _WORD.finditer(texts[int(text)].as_py())]
        last = None
        for row in rows:
            start, end = found[chains.places[row]]
            if last == row - 1:
                begun, _, score = spans[text].pop()
                start, score = begun, max(score, float(toxic[row]))
            else:
                score = float(toxic[row])
            spans[text].append((start, end, score))
            last = row
    return spans


def _pieces(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) >= n)]


def _copies(chains: Chains) -> np.ndarray:
    """The first text that each text is a near copy of, itself if none; -1 without words.

    A text's sketch has, for each of _SKETCH hashes, the smallest one of its runs of
    three words, so the share of equal places estimates the share of runs that two
    texts have in common.
    """
    words = np.fromiter(map(hash_of, chains.words), np.uint64, len(chains.words))[chains.codes]
    owner, runs = chains.texts(), words.copy()
    for step in (1, 2):
        runs *= np.uint64(0x9E3779B97F4A7C15)
        runs[:-step] += np.where(owner[step:] == owner[:-step], words[step:], np.uint64(0))
    runs ^= runs >> np.uint64(29)
    texts = np.flatnonzero(chains.lengths)
    begins = (np.cumsum(chains.lengths) - chains.lengths)[texts]
    sketch = np.empty((len(texts), _SKETCH), np.uint32)
    for k in range(_SKETCH if len(texts) else 0):
        mixed = (runs ^ np.uint64(hash_of(f"sketch {k}"))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        sketch[:, k] = np.minimum.reduceat(mixed >> np.uint64(32), begins)
    first = np.full(len(texts), -1)
    for i in range(len(texts)):
        if first[i] < 0:
            alike = (sketch[i:] == sketch[i]).mean(axis=1) >= _COPY
            first[i:][alike & (first[i:] < 0)] = i
    copies = np.full(len(chains.lengths), -1)
    copies[texts] = texts[first]
    return copies


def _evidence(chains: Chains, toxic: np.ndarray) -> set[str]:
    """Words and prefixes (with a star) that occur almost only in toxic texts.

    Near copies of a label count once.
    """
    copies = _copies(chains)
    ends = np.concatenate([[0], np.cumsum(chains.lengths)])
    shown = ({}, {})
    for text in range(len(chains.lengths)):
        codes = np.unique(chains.codes[ends[text] : ends[text + 1]])
        if not len(codes):
            continue
        first = int(copies[text])
        seen = shown[int(toxic[text])]
        for piece in {p for c in codes for p in _pieces(chains.words[c])}:
            seen.setdefault(piece, set()).add(first)
    clean, bad = ({p: len(s) for p, s in seen.items()} for seen in shown)
    weight = int((toxic == 0).sum()) / int(toxic.sum())
    least = np.log(_CHANCE) / np.log(toxic.mean())
    return {p for p, n in bad.items() if n >= least and n * weight >= _PURITY * (n * weight + clean.get(p, 0))}


def hash_of(word: str) -> int:
    value = 0xCBF29CE484222325
    for octet in word.encode("utf-8", "surrogatepass"):
        value = (value ^ octet) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def _fit_curve(inputs: np.ndarray, toxic: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic regression by Newton steps, both labels weighted alike, lightly shrunk."""
    weights = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    curve, shrink = np.zeros(inputs.shape[1]), np.eye(inputs.shape[1])
    for _ in range(rounds):
        p = _logistic(inputs @ curve)
        slope = inputs.T @ (weights * (toxic - p)) - curve
        bend = (inputs * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ inputs + shrink
        step = np.linalg.solve(bend, slope)
        curve = curve + step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return curve


def fit(clean: Sequence[str], toxic: Sequence[str]) -> ToxicityModel:
    """A model from clean and toxic texts."""
    if not clean or not toxic:
        return ToxicityModel(None, np.zeros(3), 1.0 if toxic else 0.0)
    label = np.array([0] * len(clean) + [1] * len(toxic))
    chains = Chains.of(pa.array([*clean, *toxic], pa.string()))
    evidence = _evidence(chains, label)
    marked = np.array([any(p in evidence for p in _pieces(w)) for w in chains.words], bool)
    tags = (marked[chains.codes] & (label[chains.texts()] == 1)).astype(np.int64)
    field = crf.train(FEATURES, [0, 1], chains.words, chains.codes, chains.lengths, tags, rounds=20)
    toxicity = field.marginals(chains.words, chains.codes, chains.lengths)[:, 1]
    return ToxicityModel(field, _fit_curve(_summary(chains, toxicity), label))


def learn(
    texts: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text"
) -> ToxicityModel:
    """A model from a bounded sample of the texts with a 0/1 label. Runs jobs."""
    labelled = texts.select(key, *text_marks(text)).join(labels.select(key, F.col(label).alias("label")), key)
    sample = labelled_sample(texts, labelled.select("label", "hash", "bytes"), text)
    return fitted(texts.sparkSession, fit_sample, sample)


def fit_sample(sample: Mapping[int, Sequence[str]]) -> ToxicityModel:
    return fit(sample.get(0, []), sample.get(1, []))


def with_toxicity(
    df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", spans: str = "spans", drop: Sequence[str] = ()
) -> DataFrame:
    """Adds the score (0 to 1) and the offending spans (start, end in characters, score); leaves out ``drop``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        scores, found = shared.value.score(batch.column(text))
        named = [[{"start": a, "end": b, "score": s} for a, b, s in each] for each in found]
        return [pa.array(scores), pa.array(named, kind)]

    return map_batches(df, {score: T.DoubleType(), spans: SPANS}, run, lambda bs: slices(bs, text), drop)

"""The quality classifier: features, ratios, the dual fit and held-out accuracy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import quality
from tallybook.llm.queries import queries, quality_model

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def grams(text: str | None) -> set[tuple]:
    """The features of a text, spelled out."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = [w.lower() for w in words]
    shapes = []
    for i, w in enumerate(words):
        shape = re.sub("[a-zäßéèü]+", "a", w)
        shape = re.sub("[A-ZÄÉ]+", "A", shape)
        shapes.append("=" if i and low[i] == low[i - 1] else re.sub("[0-9]+", "0", shape))
    found = {("w", w) for w in low} | {("s", s) for s in shapes}
    found |= set(zip("p" * len(low), low, low[1:])) | set(zip("2" * len(low), shapes, shapes[1:]))
    return found | set(zip("3" * len(low), shapes, shapes[1:], shapes[2:]))


TEXTS = [
    "Der Baum und der der der BAUM!! 12 x34",
    "über ÄPFEL, été. Und | und | und",
    None,
    "",
    "one",
    "one one",
    " \t\n",
    "aa bb aa bb",
]


def test_features_are_the_texts_own(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 40)
    owner, bucket = quality.features(pa.array(TEXTS))
    assert (np.diff(owner) >= 0).all()
    for i, text in enumerate(TEXTS):
        own = bucket[owner == i]
        assert len(own) == len(set(own.tolist())) == len(grams(text))
    shared = [set(bucket[owner == i].tolist()) & set(bucket[owner == j].tolist()) for i, j in ((0, 1), (4, 5), (0, 4))]
    wanted = [grams(TEXTS[i]) & grams(TEXTS[j]) for i, j in ((0, 1), (4, 5), (0, 4))]
    assert [len(s) for s in shared] == [len(w) for w in wanted]


def test_features_do_not_depend_on_the_batch():
    owner, bucket = quality.features(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        alone = quality.features(pa.array([text], pa.string()))[1]
        assert alone.tolist() == bucket[owner == i].tolist()


def test_ratios():
    ratios = quality.log_count_ratios(np.array([9.0, 0, 1]), np.array([0.0, 4, 1]))
    assert ratios == pytest.approx([np.log(10 / 13) - np.log(1 / 8), np.log(1 / 13) - np.log(5 / 8), np.log(2 / 13) - np.log(2 / 8)])


def test_the_fit_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) * (rng.random((80, 6)) < 0.6)
    sign = np.where(x @ rng.normal(size=6) + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    bound = np.where(sign > 0, 0.7, 1.3)
    row, column = np.nonzero(x)
    bounds = np.concatenate([[0], np.cumsum((x != 0).sum(axis=1))])

    def cost(w):
        return w @ w / 2 + (bound * np.maximum(0, 1 - sign * (x @ w[:-1] + w[-1]))).sum()

    w = quality.dual_coordinate_descent(bounds, column, x[row, column], sign, bound, 6, rounds=20_000, still=1e-6)
    for _ in range(3000):
        assert cost(w) <= cost(w + rng.normal(size=7) * 10 ** rng.uniform(-4, 0)) + 1e-5


def test_held_out_accuracy(spark):
    """Both labels of the documents that the model has not seen."""
    scored = queries()["op12_nbsvm_quality"](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80
    for label in (0, 1):
        own = [r["predicted"] for r in rows if r["quality"] == label]
        assert np.mean([p == label for p in own]) >= 0.95


def test_scores_are_those_of_the_formula(spark):
    model = quality_model(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.union(spark.createDataFrame([(None, None), (7000, ""), (7000, "")], docs.schema))
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.with_quality(docs, model).collect()}
    for (_, text), score in got.items():
        bucket = quality.features(pa.array([text], pa.string()))[1]
        ratio = model.ratios[bucket].astype(float)
        x = ratio / max(np.sqrt((ratio * ratio).sum()), 1e-300)
        distance = x @ model.weights[bucket] + model.weights[-1]
        assert score == pytest.approx(1 / (1 + np.exp(-(model.curve[0] * distance + model.curve[1]))), abs=1e-6)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_ratios_count_every_labelled_text(spark, monkeypatch, broadcast):
    seen = {}
    monkeypatch.setattr(quality, "BROADCAST_LABELS", broadcast)
    monkeypatch.setattr(quality, "fitted", lambda spark, fit, shared: seen.setdefault("ratios", shared[0]))
    rows = [(i, f"good{i % 3} words" if i % 2 else "BAD!! words") for i in range(50)] + [(None, "x"), (99, None), (98, "unlabelled")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (99, 1), (98, None)], "doc_id bigint, quality int")
    quality.learn(docs, labels, most=2, most_bytes=40)
    counts = np.zeros((2, 1 << quality.BITS))
    for key, text in rows[:50]:
        counts[key % 2, quality.features(pa.array([text]))[1]] += 1
    assert seen["ratios"] == pytest.approx(quality.log_count_ratios(counts[1], counts[0]))


def test_missing_labels_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text", "x"), (None, None, "y")], "doc_id bigint, text string, SCORE string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.learn(docs, none)
    assert [r["score"] for r in quality.with_quality(docs, model).collect()] == [0.0, 0.0]
    good = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, quality int")
    model = quality.learn(docs.withColumn("label", F.lit("clash")), good)
    scored = quality.with_quality(docs, model, drop=["text"])
    assert scored.columns == ["doc_id", "score"]
    assert [r["score"] for r in scored.collect()] == [1.0, 1.0]
    assert quality.with_quality(docs.limit(0), model).collect() == []

"""The bounded samples that the taggers are fitted on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybook.llm.tagging import labelled_sample, text_marks


def sample(spark, texts, **bounds):
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, label int")
    return labelled_sample(df, df.select("label", *text_marks()), **bounds)[1]


def in_order(spark, texts):
    """The texts in the order in which they are picked."""
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r["text"] for r in df.orderBy(F.xxhash64(F.xxhash64("text")), F.xxhash64("text")).collect()]


@pytest.mark.parametrize("place", [0, 5])
@pytest.mark.parametrize("most", [4, 12, 100])
def test_a_long_text_neither_ends_the_sample_nor_breaks_the_bound(spark, place, most):
    short = in_order(spark, [f"text {i:03d}" for i in range(40)])
    mixed = in_order(spark, [*short, *(f"long {n} " + "x" * 1000 for n in range(400))])
    before = [sum(s.startswith("text") for s in mixed[:i]) for i in range(len(mixed))]
    long = next(t for t, n in zip(mixed, before, strict=True) if t.startswith("long") and n == place)
    found = sample(spark, [*short, long], most=most, most_bytes=400)
    assert sorted(found) == sorted(short[:most])


def test_texts_that_no_longer_fit_are_passed_over(spark):
    texts = [f"{i:03d}" + "y" * (7 if i % 4 else 97) for i in range(400)]
    found = sample(spark, texts, most=100, most_bytes=1000)
    assert 990 <= sum(map(len, found)) <= 1000
    few = sample(spark, texts, most=5, most_bytes=10_000)
    assert sorted(few) == sorted(in_order(spark, texts)[:5])


def test_of_a_label_with_long_texts_only_the_beginning_of_one_is_used(spark):
    (found,) = sample(spark, ["é" * 500, "ü" * 500], most_bytes=400)
    assert 0 < len(found.encode()) <= 400 and found == found[0] * len(found)

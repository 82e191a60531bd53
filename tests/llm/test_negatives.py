"""Hard negatives against a full scan of all scores for each anchor."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import negatives
from tallybook.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def brute(rows, anchors, positives=5, take=3, low=50, high=95):
    """Rows are (id, label, whole numbers); ``anchors`` are their indexes."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for i in anchors:
        key, label, vector = rows[i]
        scored = sorted(((-dot(vector, v), k, la, j) for j, (k, la, v) in enumerate(rows)), key=lambda r: r[:2])
        near = [(k, -s) for s, k, la, j in scored if la == label and j != i][:positives]
        others = [(k, -s) for s, k, la, j in scored if la != label]
        for k, p in near:
            inside = [r for r in others if low * p <= 100 * r[1] <= high * p][:take]
            out += [(key, k, at + 1, n, p, s) for at, (n, s) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, every=3, **limits):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>").repartition(4)
    result = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **limits)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, result.collect()))


def cloud(seed, n, dim=6, labels=4, spread=40):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), rng.integers(-spread, spread, dim).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_all_windows(spark, seed):
    rows = cloud(seed, 300)
    assert found(spark, rows) == brute(rows, range(0, 300, 3))


def test_many_blocks_and_ties(spark, monkeypatch):
    rows = cloud(7, 240, dim=3, labels=2, spread=4)  # few different scores
    for name, value in (("ROW_BLOCK", 32), ("ANCHOR_BLOCK", 16), ("LEAST_BLOCK", 8), ("_CELLS", 64)):
        monkeypatch.setattr(negatives, name, value)
    assert found(spark, rows, every=2) == brute(rows, range(0, 240, 2))


def test_other_numbers_of_positives_and_limits(spark):
    rows = cloud(8, 150, spread=9)
    limits = dict(positives=2, negatives=7, low=10, high=100)
    assert found(spark, rows, **limits) == brute(rows, range(0, 150, 3), 2, 7, 10, 100)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = cloud(9, 40, dim=3, spread=5)
    rows += rows[:6] + [(0, 1, [1, 2, 3])] * 3
    anchors = [i for i, r in enumerate(rows) if r[0] % 3 == 0]
    assert found(spark, rows) == brute(rows, anchors)


def test_one_vector_held_by_a_third_of_all_rows(spark):
    rows = cloud(10, 200, dim=3)
    rows = [(k, la, [9, 9, 9]) if k % 3 == 1 else (k, la, v) for k, la, v in rows]
    assert found(spark, rows) == brute(rows, range(0, 200, 3))


def test_rows_that_take_no_part_and_vectors_of_all_lengths(spark):
    rows = cloud(11, 60) + [(60, 1, []), (61, 1, [5]), (62, 2, [5] * 9), (63, 2, [0] * 6), (66, 1, [0] * 6)]
    left_out = [(None, 1, [50] * 6), (70, None, [50] * 6), (72, 2, None), (75, 1, [50, None, 50, 50, 50, 50])]
    anchors = [i for i, r in enumerate(rows) if r[0] % 3 == 0]
    assert found(spark, rows + left_out) == brute(rows, anchors)
    assert found(spark, []) == [] and found(spark, [(1, 1, [1])]) == [] and found(spark, [(3, 1, [1])]) == []


@pytest.mark.parametrize("spread", [3000, 2**25, 2**29])
def test_large_components_stay_exact(spark, spread):
    rows = cloud(12, 90, dim=5, spread=spread)
    assert found(spark, rows) == brute(rows, range(0, 90, 3))


def test_kinds_of_products():
    def kind(spread):
        rows = np.full((2, 4), spread)
        return negatives.exact_products(rows, rows)(slice(0, 2))[0, 0] == 4 * spread * spread

    assert kind(2**11 - 1) and kind(2**12 + 1) and kind(2**25 + 1) and kind(2**30 - 1)


def contract(table):
    rows = []
    for key, vector, label in table:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        rows.append((key, label, [math.floor(256 * float(x)) for x in vector]))
    return brute(rows, [i for i, r in enumerate(rows) if r[0] % 50 == 0])


def test_the_query_against_brute_force(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in table.collect()]
    like = rows[0][1]
    rows += [(1000, None, 1), (1050, like, None), (1100, [*like[:-1], None], 1), (1150, [*like[:-1], float("nan")], 1)]
    rows += [(1200, [*like[:-1], float("-inf")], 1), (1250, like, 3), (1251, like, 4), (1252, [x / 1.1 for x in like], 5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, label int, score int")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    written = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = queries()["op13_slot_negatives"](spark, str(tmp_path))
    expected = contract(map(tuple, written))
    assert expected and sorted(map(tuple, got.collect())) == expected

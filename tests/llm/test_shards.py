from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm.shards import Permutation, shuffled_shards


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 7, -1, 2**70])
def test_a_permutation_and_its_inverse(n, seed):
    p = Permutation(n, seed)
    places = p.place(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert p.row(places).tolist() == list(range(n))


def test_seeds_give_other_shuffles_that_look_random():
    n = 10_000
    a, b = (Permutation(n, s).place(np.arange(n)) for s in (1, 2))
    assert np.mean(a == b) < 0.01
    assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.05
    assert Permutation(n, 1).place(np.arange(n)).tolist() == a.tolist()


def test_shards_differ_by_one_row_and_slots_have_no_gaps(spark):
    rows = [(i % 50 if i % 9 else None, f"text {i % 3}", i) for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row int")
    found = shuffled_shards(df, [F.col("doc_id"), F.col("text"), F.col("_row")], 8, seed=3)
    slots: dict[int, list[int]] = {}
    for r in found.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(r["_row"] for r in found.collect()) == list(range(203))
    assert {len(s) for s in slots.values()} == {25, 26}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    place = {(r["shard"], r["slot"]): r["_row"] for r in found.collect()}
    for at, row in enumerate(Permutation(203, 3).row(np.arange(203))):
        assert place[(at % 8, at // 8)] == order[row][2]


def test_an_empty_table_and_no_shards(spark):
    df = spark.createDataFrame([], "doc_id bigint, shard string")
    assert shuffled_shards(df, [F.col("doc_id")], 8).collect() == []
    with pytest.raises(ValueError):
        shuffled_shards(df, [F.col("doc_id")], 0)

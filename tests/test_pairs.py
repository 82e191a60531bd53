"""The pruned pair count against listing every pair."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.operators import pairs
from tallybook.operators.pairs import top_pairs
from tests.conftest import rows


def brute_force(lines, k):
    baskets = {}
    for basket, item, n in lines:
        baskets.setdefault(basket, {})[item] = n
    counts = Counter()
    for items in baskets.values():
        for a, b in itertools.combinations(sorted(items), 2):
            counts[a, b] += items[a] * items[b]
    ranked = sorted(counts.items(), key=lambda p: (-p[1], p[0]))
    return [(a, b, n) for (a, b), n in ranked[:k]]


def random_lines(seed, baskets, items, largest, repeats, skew=1.0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) ** skew for i in range(items)]
    lines = []
    for basket in range(baskets):
        size = rng.randint(1, largest)
        for item in set(rng.choices(range(items), weights, k=size)):
            lines.append((f"b{basket}", f"i{item:03}", rng.randint(1, repeats)))
    return lines


def frame(spark, lines):
    return spark.createDataFrame(lines, "basket string, item string, n bigint")


def check(spark, lines, k=25, **params):
    got = rows(top_pairs(frame(spark, lines), k, **params).orderBy(F.desc("pair_count"), "a", "b"))
    assert got == brute_force(lines, k)


@pytest.mark.parametrize("seed", range(4))
def test_random_baskets_with_and_without_pruning(spark, seed):
    lines = random_lines(seed, 60, 40, 12, 3, skew=[0.0, 0.7, 1.0, 1.5][seed])
    check(spark, lines)
    check(spark, lines, small_basket=64, cheap_pairs_per_line=0)
    check(spark, lines, k=10, small_basket=4)
    check(spark, lines, k=3, small_basket=1)


def test_few_seeds(spark, monkeypatch):
    """A weak floor leaves more pairs open, never a different answer."""
    monkeypatch.setattr(pairs, "SEED_ITEMS", 5)
    for seed in (10, 11):
        check(spark, random_lines(seed, 80, 50, 14, 4, skew=0.5), k=8, small_basket=5)


def test_basket_with_most_of_all_lines(spark):
    lines = random_lines(5, 150, 200, 6, 2, skew=0.8)
    lines += [("hot", f"i{i:03}", 1 + i % 5) for i in range(600)]
    check(spark, lines)
    check(spark, lines, k=100)


def test_hot_basket_where_every_pair_ties(spark):
    lines = [("hot", f"i{i:03}", 1) for i in range(500)] + [("b", "x", 1), ("c", "y", 1)]
    check(spark, lines)


def test_pairs_split_over_small_and_large_baskets(spark):
    """A pair below the floor in each part can be the best in total."""
    lines = [("hot", f"i{i:03}", 2) for i in range(100)]
    lines += [(f"s{j}", code, 1) for j in range(3) for code in ("i050", "i099")]
    lines += [(f"t{j}", code, 1) for j in range(6) for code in ("p", "q")]
    check(spark, lines)
    check(spark, lines, k=1)


def test_hot_basket_lists_few_pairs(spark):
    """Only pairs that can be in the answer are listed, not the square of the basket."""
    lines = frame(spark, [("hot", f"i{i:03}", 1) for i in range(500)] + [("b", "x", 1), ("c", "y", 1)])
    sizes = lines.groupBy("basket").agg(F.count("*").alias("size"))
    norms = pairs._norms(lines, "norm").withColumn("norm_large", F.col("norm"))
    floor = pairs._find_floor(lines, sizes, norms, 25)
    assert pairs._count_large(lines, norms, floor).count() == 25


def test_empty_and_single_items(spark):
    assert rows(top_pairs(frame(spark, []), 5)) == []
    assert rows(top_pairs(frame(spark, [("a", "x", 3), ("b", "y", 1)]), 5)) == []


def test_fewer_pairs_than_asked_for(spark):
    lines = [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 1)]
    check(spark, lines, k=50, small_basket=1)


@pytest.mark.parametrize("part", [1, 3, 50])
def test_tiles_of_any_size_give_the_same_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(pairs, "PART_ITEMS", part)
    lines = random_lines(20, 8, 60, 50, 3) + [("hot", f"i{i:03}", 1 + i % 3) for i in range(60)]
    check(spark, lines, k=20, small_basket=5)
    check(spark, [("hot", f"i{i:03}", 1) for i in range(40)], k=30, small_basket=1, cheap_pairs_per_line=0)


def test_every_pair_meets_in_one_tile_and_copies_are_few(spark, monkeypatch):
    """A basket of n items in k parts has n * (k + 1) copies, not one of all items in each block of pairs."""
    monkeypatch.setattr(pairs, "PART_ITEMS", 10)
    n = 300
    lines = frame(spark, [("hot", f"i{i:03}", 1) for i in range(n)]).withColumn("norm_large", F.lit(1.0))
    first, second, tiles = pairs._grid(lines, F.lit(True))
    met = first.join(second, ["basket", "row", "column"]).filter("row < column OR x < y")
    found = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    assert found.count() == found.distinct().count() == n * (n - 1) // 2
    assert first.count() + second.count() == n * (n // 10 + 1)
    assert tiles == math.ceil(n * (n + 1) / 2 / 10**2)
    # Pairs of items that cannot lead are not listed.
    leading = F.col("item") < "i007"
    first, second, tiles = pairs._grid(lines, leading)
    met = first.join(second, ["basket", "row", "column"]).filter("row < column OR x < y")
    assert met.count() == 7 * 6 // 2 + 7 * (n - 7)
    assert first.count() + second.count() <= 7 * 31 + n


def test_looked_up_pairs_read_the_baskets_of_the_rarer_item(spark):
    lines = [(f"b{i}", "common", 1) for i in range(200)] + [("b3", "rare", 2), ("b5", "rare", 1), ("x", "rare", 1)]
    large, wanted = frame(spark, lines), spark.createDataFrame([("common", "rare")], "a string, b string")
    assert rows(pairs._look_up_large(wanted, large)) == [("common", "rare", 3)]
    plan = pairs._look_up_large(wanted, large)._jdf.queryExecution().optimizedPlan().toString()
    assert "uses_a" in plan and "CASE WHEN" in plan


def test_numbered_lines_are_joined_once_to_list_the_pairs(spark):
    """Norms, sizes and parts were joined to the lines anew for every use, which made most of the time."""
    lines = random_lines(30, 60, 40, 12, 3)
    found = top_pairs(frame(spark, lines), 25, small_basket=3, cheap_pairs_per_line=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3  # of the lines with themselves, and the names of the two items of each best pair
    assert rows(found) == brute_force(lines, 25)


def test_pairs_over_whole_and_cut_baskets(spark, monkeypatch):
    """A pair's count comes from small baskets, baskets of one part and baskets that are cut."""
    monkeypatch.setattr(pairs, "PART_ITEMS", 8)
    lines = [("hot", f"i{i:03}", 2) for i in range(40)]
    lines += [(f"s{j}", code, 1) for j in range(4) for code in ("i007", "i031")]
    lines += [(f"w{j}", f"i{i:03}", 1 + (i + j) % 2) for j in range(5) for i in range(5 + j, 35, 6)]
    check(spark, lines, small_basket=3)
    check(spark, lines, k=2, small_basket=4)


def test_items_sort_as_themselves_and_unknown_ones_are_left_out(spark):
    lines = [(f"b{j}", code, 1) for j in range(6) for code in ("9", "10", "a", "Z", "é", "")]
    unknown = [("b0", None, 5), (None, "9", 5), (None, "a", 5), ("b1", None, 1)]
    found = rows(top_pairs(frame(spark, lines + unknown), 12, small_basket=3, cheap_pairs_per_line=0))
    assert found == brute_force(lines, 12)

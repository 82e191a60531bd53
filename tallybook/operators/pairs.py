"""The item pairs that occur together most often, exactly.

The count of a pair is the sum over all baskets of (times a is in it) * (times b
is in it). Listing every pair of every basket grows with the square of the
basket, so one huge basket would be the whole job. Three facts avoid that:

* A count never exceeds sqrt(norm(a) * norm(b)), with norm(x) the sum over
  baskets of (times x is in it) squared.
* The pairs of a few hundred frequent items give a floor: a count (and pair, for
  ties) that the last row of the answer reaches or beats. A pair whose bound stays
  below the floor cannot be in the answer and is never listed.
* In the bound for pairs that meet only in large baskets, only the norms over
  large baskets matter, which is tight when one basket dominates.

Nothing is sampled or capped: what is left out provably ranks below the floor.

Baskets and items are numbered once, items in their order, and a line carries the
size of its basket and the norms of its item. So the passes that follow move whole
numbers only and need no further join to tell small baskets and open pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallybook.operators.ranking import global_row_number
from tallybook.operators.scratch import materialize

#: Baskets up to this many distinct items may list their pairs directly.
SMALL_BASKET = 64
#: Items whose pairs give the floor; also the size bound of the broadcast below.
SEED_ITEMS = 256
#: Below this many pairs per line, listing all of them is cheaper than a floor.
CHEAP_PAIRS_PER_LINE = 8
#: A large basket's items are cut into parts of about this many; a tile pairs two parts.
PART_ITEMS = 1 << 9
#: Tiles are dealt to this many tasks at most.
MOST_TASKS = 1 << 14

# Keeps a bound from being rounded below the true value: a sum of m doubles is off by m / 2^53 at most, so
# this covers items in up to 9e9 baskets.
_SLACK = 1 + 1e-6


@dataclass(frozen=True)
class _Floor:
    """Any pair of the answer ranks at or before this one."""

    count: int
    a: str | int
    b: str | int

    def reachable(self, bound: Column) -> Column:
        """Could a pair with this upper bound be in the answer?"""
        return F.floor(bound) >= self.count

    def reachable_as_first(self, bound: Column, a: Column) -> Column:
        """Same, when ``a`` is the smaller item; at equal count, earlier pairs win."""
        best = F.floor(bound)
        return (best > self.count) | ((best == self.count) & (a <= self.a))

    def reachable_pair(self, bound: Column, a: Column, b: Column) -> Column:
        best = F.floor(bound)
        before = (a < self.a) | ((a == self.a) & (b <= self.b))
        return (best > self.count) | ((best == self.count) & before)


def _bound(norm_a: Column, norm_b: Column) -> Column:
    return F.sqrt(norm_a) * F.sqrt(norm_b) * _SLACK


def _norms(lines: DataFrame, out: str, large: Column | None = None) -> DataFrame:
    """The norm of every item and, if ``large`` is given, the norm over the lines where it holds."""
    squares = F.col("n").cast("double") * F.col("n").cast("double")
    sums = [F.sum(squares).alias(out)]
    if large is not None:
        sums.append(F.coalesce(F.sum(F.when(large, squares)), F.lit(0.0)).alias(f"{out}_large"))
    return lines.groupBy("item").agg(*sums)


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("pair_count"), "a", "b")


def _sides(lines: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    def side(suffix: str) -> DataFrame:
        kept = [F.col(c).alias(f"{c}_{suffix}") for c in ("n", *carried)]
        return lines.select("basket", F.col("item").alias(suffix), *kept)

    return side("a"), side("b")


def _join_sides(left: DataFrame, right: DataFrame, on: list[str], where: Column | None = None) -> DataFrame:
    same = F.col("a") < F.col("b")
    for name in on:
        same = same & (F.col(f"l.{name}") == F.col(f"r.{name}"))
    return left.alias("l").join(right.alias("r"), same if where is None else same & where)


def _count_all(lines: DataFrame) -> DataFrame:
    return (
        _join_sides(*_sides(lines), on=["basket"])
        .groupBy("a", "b")
        .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pair_count"))
    )


def _find_floor(lines: DataFrame, sizes: DataFrame, norms: DataFrame, k: int) -> _Floor | None:
    """The k-th best pair among the most frequent items and the largest basket's items."""
    seed_items = max(SEED_ITEMS, math.isqrt(2 * k) + 2)
    frequent = norms.orderBy(F.desc("norm"), "item").limit(seed_items).select("item")
    largest = sizes.orderBy(F.desc("size"), "basket").limit(1).select("basket")
    in_largest = lines.join(F.broadcast(largest), "basket", "left_semi")
    in_largest = in_largest.orderBy(F.desc("n"), "item").limit(seed_items).select("item")
    # At most 2 * seed_items short rows, whatever the data.
    seeds = F.broadcast(frequent.union(in_largest).distinct())
    row = _best(_count_all(lines.join(seeds, "item", "left_semi"))).offset(k - 1).limit(1).first()
    return None if row is None else _Floor(row["pair_count"], row["a"], row["b"])


def _count_reachable(lines: DataFrame, norms: DataFrame, floor: _Floor) -> DataFrame:
    """Pairs of small baskets that the floor leaves open, with the bound of their
    count in large baskets. The lines carry their norms."""
    top = norms.agg(F.max("norm")).first()[0]
    item_bound = _bound(F.col("norm"), F.lit(top))
    left, right = _sides(lines.filter(floor.reachable(item_bound)), "norm", "norm_large")
    left = left.filter(floor.reachable_as_first(_bound(F.col("norm_a"), F.lit(top)), F.col("a")))
    open_pair = floor.reachable_pair(_bound(F.col("norm_a"), F.col("norm_b")), F.col("a"), F.col("b"))
    return (
        _join_sides(left, right, ["basket"], open_pair)
        .withColumn("_large", _bound(F.col("norm_large_a"), F.col("norm_large_b")))
        .groupBy("a", "b")
        .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("small_count"), F.max("_large").alias("large_bound"))
    )


def _tasks(lines: DataFrame, tiles: int) -> int:
    return min(MOST_TASKS, max(tiles, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _list_whole(lines: DataFrame, norms: DataFrame, floor: _Floor, tiles: int) -> DataFrame:
    """Pairs that reach the floor on large baskets alone, a row for each basket of at most PART_ITEMS items.

    Such a basket is one tile, so nothing has to be dealt. The lines carry their norms.
    """
    top = norms.agg(F.max("norm_large")).first()[0]
    item_bound = _bound(F.col("norm_large"), F.lit(top))
    left, right = _sides(lines.filter(floor.reachable(item_bound)), "norm_large")
    left = left.filter(floor.reachable_as_first(_bound(F.col("norm_large_a"), F.lit(top)), F.col("a")))
    left, right = (side.repartition(_tasks(lines, tiles), "basket") for side in (left, right))
    open_pair = floor.reachable_pair(_bound(F.col("norm_large_a"), F.col("norm_large_b")), F.col("a"), F.col("b"))
    met = _join_sides(left, right, ["basket"], open_pair)
    return met.select("a", "b", (F.col("n_a") * F.col("n_b")).alias("large_count"))


def _count_large(lines: DataFrame, norms: DataFrame, floor: _Floor) -> DataFrame:
    """Pairs that reach the floor on large baskets alone, with their count there."""
    top = norms.agg(F.max("norm_large")).first()[0]
    item_bound = _bound(F.col("norm_large"), F.lit(top))
    tagged = lines.join(norms.select("item", "norm_large").filter(floor.reachable(item_bound)), "item")
    first, second, tiles = _grid(tagged, floor.reachable_as_first(_bound(F.col("norm_large"), F.lit(top)), F.col("item")))
    on = ["basket", "row", "column"]
    first, second = (side.repartition(_tasks(lines, tiles), *on) for side in (first, second))
    ordered = (F.col("row") < F.col("column")) | (F.col("x") < F.col("y"))
    open_pair = floor.reachable_pair(
        _bound(F.col("norm_large_x"), F.col("norm_large_y")), F.least("x", "y"), F.greatest("x", "y")
    )
    met = first.join(second, on).filter(ordered & open_pair)
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.sum(F.col("n_x") * F.col("n_y")).alias("large_count")
    )


def _grid(lines: DataFrame, leads: Column) -> tuple[DataFrame, DataFrame, int]:
    """The two sides of each basket's tiles (columns x and y), and how many full tiles their pairs would fill.

    A hash deals the items of a basket to parts of about PART_ITEMS, items that ``leads`` (that can
    be the first of a pair in the answer) to the parts before the others. Tile (row, column), with
    row <= column and a leading row, pairs two parts: an item of part i stands at the first side of
    tiles (i, i), (i, i + 1), ... and at the second side of (0, i), ..., (i, i). So a basket of n items
    in k parts has n * (k + 1) copies at most, and every pair meets in one tile.
    """
    marked = lines.withColumn("_leads", leads)
    sizes = marked.groupBy("basket").agg(F.count_if("_leads").alias("_first"), F.count(F.lit(1)).alias("_size"))
    h, r = F.col("_first").cast("double"), (F.col("_size") - F.col("_first")).cast("double")
    head, rest = (F.ceil(c / PART_ITEMS).cast("int") for c in (h, r))
    work = (h * (h + 1) / 2 + h * r) / PART_ITEMS**2
    sizes = materialize(sizes.select("basket", head.alias("_head"), rest.alias("_rest"), work.alias("_work")), "basket-parts")
    tiles = math.ceil(sizes.agg(F.sum("_work")).first()[0] or 0)
    sizes = sizes.drop("_work")
    head, rest, mixed = F.col("_head"), F.col("_rest"), F.xxhash64("item")
    part = F.when(F.col("_leads"), F.pmod(mixed, head)).otherwise(head + F.pmod(mixed, rest))
    dealt = marked.join(sizes, "basket").filter(head > 0).withColumn("_part", part.cast("int"))

    def side(dealt: DataFrame, name: str, own: str, other: str, from_: Column, to: Column) -> DataFrame:
        kept = [F.col("item").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "norm_large"))]
        return dealt.select("basket", *kept, F.col("_part").alias(own), F.explode(F.sequence(from_, to)).alias(other))

    first = side(dealt.filter("_leads"), "x", "row", "column", F.col("_part"), head + rest - 1)
    second = side(dealt, "y", "column", "row", F.lit(0), F.least(F.col("_part"), head - 1))
    return first, second, tiles


def _look_up_large(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """Counts in large baskets for given pairs.

    A pair is looked for in the baskets of the rarer of its items only, and of the
    lines only those of the items asked for are moved.
    """
    items = pairs.select(F.col("a").alias("item")).union(pairs.select(F.col("b").alias("item"))).distinct()
    large = large.join(materialize(items, "asked-items"), "item", "left_semi")
    uses = large.groupBy("item").agg(F.count(F.lit(1)).alias("uses"))
    by_item = [uses.select(F.col("item").alias(c), F.col("uses").alias(f"uses_{c}")) for c in ("a", "b")]
    known = pairs.select("a", "b").join(by_item[0], "a").join(by_item[1], "b")
    rare = F.col("uses_a") <= F.col("uses_b")
    asked = known.select(
        "a", "b", F.when(rare, F.col("a")).otherwise(F.col("b")).alias("item"), F.when(rare, F.col("b")).otherwise(F.col("a")).alias("other")
    )
    other = large.select("basket", F.col("item").alias("other"), F.col("n").alias("n_other"))
    return (
        asked.join(large.select("basket", "item", "n"), "item")
        .join(other, ["basket", "other"])
        .groupBy("a", "b")
        .agg(F.sum(F.col("n") * F.col("n_other")).alias("large_count"))
    )


def top_pairs(
    lines: DataFrame,
    k: int,
    small_basket: int = SMALL_BASKET,
    cheap_pairs_per_line: float = CHEAP_PAIRS_PER_LINE,
) -> DataFrame:
    """The k pairs a < b with the highest count; ties by a, then b.

    ``lines`` has one row per (basket, item) with n, the number of times the item
    is in the basket. Returns (a, b, pair_count).
    """
    lines = materialize(lines, "basket-lines")
    # Written, so that a basket keeps its number.
    sizes = lines.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes.withColumn("number", F.monotonically_increasing_id()), "basket-sizes")
    size = F.col("size").cast("decimal(19,0)")
    shape = sizes.agg(
        F.max("size").alias("largest"),
        F.sum("size").alias("lines"),
        (F.sum(size * (size - 1)) / 2).cast("double").alias("pairs"),
        (F.sum(F.when(F.col("size") <= PART_ITEMS, size * (size + 1))) / 2).cast("double").alias("whole"),
    ).first()
    if not shape["lines"]:
        return _best(_count_all(lines)).limit(k)
    if shape["largest"] <= small_basket and shape["pairs"] <= cheap_pairs_per_line * shape["lines"]:
        return _best(_count_all(lines)).limit(k)

    by_number = sizes.select(F.col("number").alias("basket"), "size")
    sized = lines.join(sizes, "basket").select(F.col("number").alias("basket"), "item", "n", "size")
    sized = materialize(sized.filter(F.col("item").isNotNull()), "sized-lines")
    named = _norms(sized, "norm", F.col("size") > small_basket)
    named = materialize(global_row_number(named, [F.col("item")], "number"), "item-norms")
    # From here on an item is its number, which sorts as the item does.
    numbered = sized.join(named, "item").select("basket", F.col("number").alias("item"), "n", "size", "norm", "norm_large")
    numbered = materialize(numbered, "numbered-lines")
    norms = named.select(F.col("number").alias("item"), "norm", "norm_large")
    floor = _find_floor(numbered.select("basket", "item", "n"), by_number, norms, k)
    if floor is None:  # fewer than k pairs among the seeds: there is nothing to rank against
        return _best(_count_all(lines)).limit(k)

    best = _best(_count_open(numbered, norms, floor, shape, small_basket)).limit(k)
    names = [named.select(F.col("number").alias(c), F.col("item").alias(f"item_{c}")) for c in ("a", "b")]
    found = best.join(names[0], "a").join(names[1], "b")
    return _best(found.select(F.col("item_a").alias("a"), F.col("item_b").alias("b"), "pair_count")).limit(k)


def _count_open(lines: DataFrame, norms: DataFrame, floor: _Floor, shape: Row, small_basket: int) -> DataFrame:
    """The counts of all pairs that the floor leaves open, over small and large baskets."""
    size = F.col("size")
    counted = _count_reachable(lines.filter(size <= small_basket), norms, floor)
    if shape["largest"] <= small_basket:
        return counted.select("a", "b", F.col("small_count").alias("pair_count"))

    large = lines.filter(size > small_basket)
    total_bound = F.col("small_count") + F.col("large_bound")
    candidates = materialize(
        counted.filter(floor.reachable_pair(total_bound, F.col("a"), F.col("b"))), "pair-candidates"
    )
    by_large = floor.reachable_pair(F.col("large_bound"), F.col("a"), F.col("b"))
    # Pairs open on large baskets alone are all listed there; the others are looked up.
    tiles = math.ceil((shape["whole"] or 0) / PART_ITEMS**2)  # null: no basket is whole
    listed = candidates.filter(by_large).select("a", "b", F.col("small_count").alias("pair_count"))
    listed = listed.union(_list_whole(large.filter(size <= PART_ITEMS), norms, floor, tiles))
    if shape["largest"] > PART_ITEMS:
        huge = large.filter(size > PART_ITEMS).select("basket", "item", "n")
        listed = listed.union(_count_large(huge, norms, floor))
    counts = listed.groupBy("a", "b").agg(F.sum("pair_count").alias("pair_count"))
    asked = candidates.filter(~by_large)
    if not asked.agg(F.count(F.lit(1))).first()[0]:
        return counts
    looked_up = asked.join(_look_up_large(asked, large), ["a", "b"], "left")
    total = F.col("small_count") + F.coalesce("large_count", F.lit(0).cast("bigint"))
    return counts.union(looked_up.select("a", "b", total.alias("pair_count")))

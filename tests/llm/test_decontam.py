from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import decontam
from tallybook.llm.simhash import majority


def words(text):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))


def shingles(w):
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def brute(docs, items):
    found = {}
    for row, (_, text) in enumerate(docs):
        w = words(text)
        for key, item in items:
            own = words(item)
            if not own or not w:
                continue
            width = min(len(own), len(w))
            best = max(decontam.weighted_similarity(shingles(w[p : p + width]), shingles(own)) for p in range(len(w) - width + 1))
            if best >= 0.8:
                found[(row, key)] = best
    return found


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BYTES", 700)  # several blocks
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(rng.integers(8, 40)))) for i in range(20)]
    items += [(90, None), (91, ""), (92, "three short words"), (93, "one"), (94, "ab ab ab ab ab ab ab ab ab ab")]
    docs = [(0, None), (1, ""), (2, "one"), (3, "three SHORT words"), (4, "and three short  words here"), (5, "ab " * 30)]
    for i, (_, item) in enumerate(items[:20]):
        w = item.split()
        docs.append((10 + i, f"{text(30)} {item.upper()} {text(20)}"))
        changed = w[:-1] + ["other"]
        docs.append((50 + i, f"{text(9)}\n{' '.join(changed)}\t{text(300)}"))
        docs.append((100 + i, " ".join(w[1:])))  # a document shorter than the item
        docs.append((150 + i, " ".join(w[: len(w) // 2])))
    docs += [(10, docs[6][1]), (None, docs[6][1]), (7, text(20_000) + " " + items[3][1])]
    frame = spark.createDataFrame([(k, t, "kept") for k, t in docs], "doc_id bigint, text string, leaks string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.with_leaks(frame, bench).collect()
    assert [r["doc_id"] for r in rows] == [k for k, _ in docs]
    found = {(i, leak["item_id"]): leak["similarity"] for i, r in enumerate(rows) for leak in r["leaks"]}
    expected = brute(docs, items)
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in found)
    for i, r in enumerate(rows):
        for leak in r["leaks"]:
            window = words(docs[i][1])[leak["start_word"] : leak["start_word"] + leak["n_words"]]
            item = words(dict(items)[leak["item_id"]])
            assert decontam.weighted_similarity(shingles(window), shingles(item)) == leak["similarity"]


def test_equal_items_count_once_and_empty_tables_find_nothing(spark):
    item = "a b c d e f g h"
    docs = spark.createDataFrame([(1, f"x {item} y")], "doc_id bigint, text string")
    twice = spark.createDataFrame([(5, item), (3, item), (None, item)], "item_id bigint, text string")
    assert [x["item_id"] for x in decontam.with_leaks(docs, twice).first()["leaks"]] == [3]
    nameless = twice.filter("item_id IS NULL")
    assert [x["item_id"] for x in decontam.with_leaks(docs, nameless).first()["leaks"]] == [None]
    assert decontam.with_leaks(docs, twice.limit(0)).first()["leaks"] == []
    assert decontam.with_leaks(docs.limit(0), twice).collect() == []


def test_the_block_index_holds_every_item_within_the_radius():
    rng = np.random.default_rng(8)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    flips = np.zeros(300, np.uint64)
    for _ in range(decontam.RADIUS):
        flips |= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    group = decontam._ItemsOfLength(10, 5)
    group.build(items)
    windows = np.concatenate([items ^ flips, rng.integers(0, 2**63, 300).astype(np.uint64)])
    near = np.bitwise_count(windows[:, None] ^ items[None, :]) <= decontam.RADIUS
    assert set(zip(*(x.tolist() for x in group.near(windows)), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


@pytest.mark.parametrize("shared", [24, 30, 40])
def test_windows_at_the_least_similarity_are_within_the_radius(shared):
    rng = np.random.default_rng(shared)
    common = rng.integers(0, 2**63, (2000, shared)).astype(np.uint64)
    own = round(shared / 8)  # of either side, so that the similarity is 0.8
    sides = [np.concatenate([common, rng.integers(0, 2**63, (2000, own)).astype(np.uint64)], axis=1) for _ in range(2)]
    prints = [majority(s.ravel(), np.full(2000, shared + own)) for s in sides]
    assert (np.bitwise_count(prints[0] ^ prints[1]) > decontam.RADIUS).mean() < 0.002


def test_repetitive_items_equal_brute_force():
    rng = np.random.default_rng(9)
    items, docs = [], []
    for i in range(30):
        a, b = f"a{i}", f"b{i}"
        items.append((i, " ".join([a, b] * 6 + [a])))  # two shingles, 5 and 4 times
        docs.append((i, " ".join([b, a] * 6 + [b])))  # 4 and 5 times, in a document that is one window
        short = [f"s{i}_{k}" for k in range(9)]  # 5 shingles
        items.append((100 + i, " ".join(short)))
        docs.append((100 + i, " ".join(short[: int(rng.integers(7, 9))])))
    index = decontam.ItemIndex(items, 5, 0.8)
    found = index.search(pa.array([t for _, t in docs]))
    expected = brute(docs, items)
    assert {(i, r["item_id"]): r["similarity"] for i, rows in enumerate(found) for r in rows} == expected
    assert sum(k < 100 for _, k in expected) == 30

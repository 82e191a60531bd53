"""Components, tiles, SimHash and vector groups against brute force."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallybook.llm import simhash, tiling, vectors
from tallybook.llm.components import connected_components


def roots(n: int, links) -> list[int]:
    label = list(range(n))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(x) for x in range(n)]


def test_components_of_chains_stars_loops_and_repeats(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(300)]
    star = [(400, 400 + i) for i in range(1, 200)]
    loose = [tuple(map(int, rng.integers(700, 1000, 2))) for _ in range(200)]
    links = [*chain, *star, *loose, (5, 5), (3, 4), (4, 3), (None, 3), (7, None)]
    rng.shuffle(links)
    frame = spark.createDataFrame([tuple(None if x is None else int(x) for x in p) for p in links], "a bigint, b bigint")
    real = [p for p in links if None not in p and p[0] != p[1]]
    expected = roots(1000, real)
    found = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert found == {n: expected[n] for p in real for n in p}
    assert connected_components(frame.limit(0)).collect() == []


def brute_print(text: str | None, size: int = 3) -> int:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    runs = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t\n ", "one", "One two", "one two three", "ONE  two\nthree ÉÀ", "a b c d " * 400, "é日本 x y z", "same " * 9]


def test_fingerprints_equal_brute_force():
    rng = np.random.default_rng(2)
    texts = TEXTS + [" ".join(rng.choice(["a", "Bc", "def", "ghij", "klmnop"], rng.integers(0, 700))) for _ in range(60)]
    found = simhash.fingerprints(pa.array(texts), 3)
    assert found.tolist() == [brute_print(t) for t in texts]


def test_spark_hashes_as_the_contract_says(spark):
    words = ["", "a", "one two three", "é日本 x", "x" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) AS h").collect()
    assert all(r["h"] % 2**64 == xxhash.xxh64_intdigest(r["w"], 42) for r in rows)


def planted_prints(rng, n: int) -> np.ndarray:
    base = rng.integers(0, 2**63, n // 4, dtype=np.int64).view(np.uint64)
    bits = np.uint64(1) << rng.integers(0, 64, (3, n // 4)).astype(np.uint64)
    return np.concatenate([base, base ^ bits[0], base ^ bits[0] ^ bits[1], base ^ bits[0] ^ bits[1] ^ bits[2]])


@pytest.mark.parametrize("tile_rows", [4, 1024])
def test_links_of_fingerprints_equal_brute_force(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(3)
    # One dense group around a centre, so that units of several tiles arise.
    dense = np.uint64(0xFF00FF00FF00FF) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    dense = np.concatenate([dense, dense ^ (np.uint64(1) << rng.integers(0, 64, 64).astype(np.uint64))])
    prints = np.concatenate([planted_prints(rng, 160), dense, dense[:9]])
    rows = [(int(i), int(p)) for i, p in enumerate(prints.view(np.int64))]
    frame = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint")
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    expected = roots(len(prints), zip(*np.nonzero(near), strict=True))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert [found[i] for i in range(len(prints))] == expected


def test_groups_with_null_ids_repeats_and_clashing_columns(spark):
    rows = [(1, 7, "x", 1), (1, 7, "x", 1), (None, 7, "y", 2), (None, 1 << 40, "z", 3), (4, None, "n", 4), (5, 7 | 1 << 50, "m", 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint, _print string, component_id int")
    found = sorted(((r["_print"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()))
    assert found == [("m", 1), ("n", None), ("x", 1), ("x", 1), ("y", 1), ("z", None)]
    empty = simhash.near_duplicates(frame.limit(0))
    assert empty.collect() == []


def test_whole_groups_over_batches():
    keys = [1] * 3 + [2] + [3] * 5 + [4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + 2], "v": list(range(a, a + 2))}) for a in range(0, 10, 2)]
    seen = []
    for table, bounds in tiling.whole_groups(batches, ["k"]):
        ks = table.column("k").to_pylist()
        seen += [(ks[a], b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert seen == [(1, 3), (2, 1), (3, 5), (4, 1)]


def brute_vectors(rows, cosine=0.93):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if usable(v, label) and usable(w, other) and label == other and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("tile_rows", [8, 1024])
def test_vector_groups_equal_brute_force(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(vectors, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    near = [c + 0.05 * rng.standard_normal(16) for c in centres for _ in range(8)] + [centres[0] + 0.01 * rng.standard_normal(16) for _ in range(60)]
    rows = [(i, [float(x) for x in np.float32(v)], int(rng.integers(0, 2))) for i, v in enumerate(near)]
    odd = [[0.0] * 16, None, [1.0, None], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(200 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(300, rows[3][1], rows[3][2]), (301, rows[3][1], None), (302, rows[3][1], rows[3][2]), (302, rows[3][1], rows[3][2])]
    found = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), recall=0.99999)
    links = brute_vectors(rows)
    expected_root, degree = roots(len(rows), links), np.bincount(np.array(links).ravel(), minlength=len(rows))
    expected = sorted((rows[i][0], int(degree[i]), rows[expected_root[i]][0], rows[i][0] == rows[expected_root[i]][0]) for i in range(len(rows)))
    assert sorted(map(tuple, found.collect())) == expected
    assert vectors.near_duplicate_vectors(found.sparkSession.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_a_vector_without_id_never_names_a_group(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)]
    found = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, found), key=repr) == [(5, 1, 5, True), (None, 0, None, False), (None, 1, 5, False)]


def test_more_vectors_get_longer_signatures_and_more_tables():
    assert vectors.signs_and_tables(100, 0.93, 0.995) < vectors.signs_and_tables(10**7, 0.93, 0.995)

"""Periodic runs against a search that tries every period."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm.queries import queries
from tallybook.llm.runs import TextRuns, with_runs

SMALL = "/root/testdata/sf0.001"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words: list[str], least: int = 6, powers: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying all periods at all places."""
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // powers + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - at + period >= max(least, powers * period):
                found.setdefault((at, end + period), period)
            at = max(end, at + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def checked(texts: list[str | None], **limits) -> None:
    got = TextRuns.of(pa.array(texts, pa.string()), **limits)
    for text, runs, left in zip(texts, got.lists().to_pylist(), got.collapsed.to_pylist(), strict=True):
        expected = brute(words_of(text), **limits)
        assert [tuple(r.values()) for r in runs] == expected
        assert left == collapse(words_of(text), expected)


def random_texts(rng: np.random.Generator, n: int) -> list[str]:
    """Few different words, so that runs overlap, touch and lie in each other."""
    texts = []
    for _ in range(n):
        words = rng.choice(list("abcd")[: rng.integers(1, 5)], rng.integers(0, 70)).tolist()
        for _ in range(int(rng.integers(0, 3))):
            period, at = int(rng.integers(1, 10)), int(rng.integers(0, 20))
            words = words[:at] + words[at : at + period] * int(rng.integers(1, 9)) + words[at + period :]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_random_texts(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        checked(random_texts(rng, 20))


def test_other_limits():
    checked(random_texts(np.random.default_rng(9), 60), least=12, powers=6)
    checked(random_texts(np.random.default_rng(10), 60), least=1, powers=4)


def test_texts_do_not_reach_into_each_other():
    checked(["a a a a a", "a a a a a", None, "", " \t\n", "a", "a a a a a a", "b a b a b a", "b a b a b a b a"])


def test_runs_in_runs_and_their_ends():
    inner = ["x"] * 6 + ["y"]
    checked([" ".join(inner * 5), " ".join([*"abab", *inner * 4, *"xxxxx", "a"]), " ".join([*("abcab" * 4), "a", "b"])])


def test_case_and_other_white_space_count():
    checked(["A a A a A a A a", "a a a a a a a a a a a a", "é\té\né\x0bé\x0cé\ré", "\x1f \x1f \x1f \x1f \x1f \x1f"])


def test_a_very_long_text():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 300_000)]
    words[1000:1000] = ["over", "and", "again"] * 100_000
    words[400_000:400_000] = words[350_000:400_000] * 3
    got = TextRuns.of(pa.array([" ".join(words), "a a a a a a a"]))
    runs = [tuple(r.values()) for r in got.lists().to_pylist()[0]]
    assert len(runs) == 2 and runs[0] == (1000, 300_000, 3)
    start, length, period = runs[1]
    assert period == 50_000 and length >= 200_000 and start <= 350_000
    assert got.lists().to_pylist()[1] == [{"start": 0, "length": 7, "period": 1}]


def test_frames_keep_their_rows_and_other_columns(spark):
    rows = [(1, "a a a a a a b", "x", 1), (1, "a a a a a a b", "x", 1), (None, None, None, None), (2, "", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, RUNS string, start int")
    found = with_runs(df, drop=["text"])
    assert found.columns == ["doc_id", "start", "runs", "collapsed"]
    got = sorted(((r["doc_id"], r["start"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=repr)
    assert got == sorted([(1, 1, [(0, 6, 1)], "a b")] * 2 + [(None, None, [], ""), (2, 2, [], "")], key=repr)
    assert with_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        with_runs(df, powers=3)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expected_row(doc_id: int, text: str | None) -> tuple:
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = (None,) * 4
    for start, length, period in runs:
        if best[1] is None or length * best[2] > best[1] * period:
            best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{le},{p}\n" for s, le, p in runs)
    return (doc_id, len(runs), *best, digest(listed), digest(collapse(words, runs)))


def test_the_query_against_brute_force(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    short = [tuple(r) for r in table.select("doc_id", "text").collect()]
    rng = np.random.default_rng(5)
    extra = random_texts(rng, 200) + [None, "", " \n", "one", "a a a a a a", "x y x y x y x y x x x x x x"] * 12
    rows = short + [(10_000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, runs string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected_row(*r) for r in rows)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 20

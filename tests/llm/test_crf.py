"""The chain model against enumeration, the two taggers on small made-up corpora."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import crf, language, toxicity
from tallybook.llm.tagging import held_out


def enumerated(scores, moves, first):
    n, s = scores.shape
    marginals, pairs, total = np.zeros((n, s)), np.zeros((s, s)), 0.0
    for path in itertools.product(range(s), repeat=n):
        score = first[path[0]] + sum(scores[t, y] for t, y in enumerate(path))
        score += sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
        weight = np.exp(score)
        total += weight
        for t, y in enumerate(path):
            marginals[t, y] += weight
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += weight
    return marginals / total, pairs / total


@pytest.mark.parametrize("chunk", [1, 2, 3, 32])
def test_marginals_equal_enumeration(monkeypatch, chunk):
    monkeypatch.setattr(crf, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 6, 2, 0])
    scores = rng.normal(0, 3, (lengths.sum(), 3))
    moves, first = rng.normal(0, 2, (3, 3)), rng.normal(0, 1, 3)
    marginals, pairs = crf.forward_backward(scores, lengths, moves, first, with_moves=True)
    ends, expected_pairs = np.cumsum(lengths), np.zeros((3, 3))
    for end, length in zip(ends, lengths, strict=True):
        if length:
            m, p = enumerated(scores[end - length : end], moves, first)
            assert np.allclose(marginals[end - length : end], m)
            expected_pairs += p
    assert np.allclose(pairs, expected_pairs)


def test_a_long_chain_does_not_overflow():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 50, (100_000, 2))
    marginals, _ = crf.forward_backward(scores, np.array([100_000]), np.zeros((2, 2)), np.zeros(2))
    assert np.isfinite(marginals).all() and np.allclose(marginals.sum(axis=1), 1)


def test_no_words_have_no_marginals():
    assert crf.forward_backward(np.zeros((0, 2)), np.array([0, 0]), np.zeros((2, 2)), np.zeros(2))[0].shape == (0, 2)


def corpus(rng, bad: list[str], texts: int) -> tuple[list[str], list[str]]:
    syllables = ["ba", "de", "ki", "lo", "mu", "na", "po", "ri", "su", "te"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    clean = [" ".join(word() for _ in range(rng.integers(5, 60))) for _ in range(texts)]
    toxic = []
    for _ in range(texts):
        words = [word() for _ in range(rng.integers(5, 60))]
        for _ in range(rng.integers(2, 6)):
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(bad)))
        toxic.append(" ".join(words))
    return clean, toxic


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(2)
    return toxicity.fit(*corpus(rng, ["zonk", "Vexer!", "grumblix"], 300))


def test_held_out_toxic_texts_are_found_and_clean_ones_left(toxic_model):
    clean, toxic = corpus(np.random.default_rng(3), ["zonk", "vexer", "GRUMBLIX,"], 200)
    scores, spans = toxic_model.score(pa.array([*clean, *toxic]))
    assert (scores[:200] >= 0.5).sum() == 0
    assert (scores[200:] < 0.5).sum() == 0
    for text, found in zip([*clean, *toxic], spans, strict=True):
        marked = [w for a, b, _ in found for w in text[a:b].split()]
        assert sorted(marked) == sorted(w for w in text.split() if w.strip(",").lower() in ("zonk", "vexer", "grumblix"))


def test_texts_without_words_score_as_clean(toxic_model):
    scores, spans = toxic_model.score(pa.array([None, "", " \n", "123 !!", "zonk " * 30_000], pa.string()))
    assert (scores[:4] < 0.5).all() and scores[4] > 0.5
    assert spans[:4] == [[], [], [], []]
    assert len(spans[4]) == 1 and spans[4][0][:2] == (0, 5 * 30_000 - 1)


@pytest.mark.parametrize(("clean", "toxic", "score"), [([], [], 0.0), (["a"], [], 0.0), ([], ["a"], 1.0)])
def test_one_label_alone_teaches_nothing(clean, toxic, score):
    assert toxicity.fit(clean, toxic).score(pa.array(["a", None]))[0].tolist() == [score, score]


def test_toxicity_of_a_frame_with_clashing_columns(spark, toxic_model):
    df = spark.createDataFrame([(1, "zonk zonk zonk", 9.0, "s"), (None, None, None, None)], "doc_id bigint, text string, score double, Spans string")
    rows = toxicity.with_toxicity(df, toxic_model).orderBy("doc_id").collect()
    assert rows[0]["doc_id"] is None and rows[0]["score"] < 0.5 < rows[1]["score"]
    assert toxicity.with_toxicity(df.limit(0), toxic_model).collect() == []


def test_labels_are_learned_from_the_given_folds_only(spark):
    docs = spark.createDataFrame([(i, f"word{i} zonk") for i in range(40)] + [(None, "x"), (1, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (99, 1), (3, None)], "doc_id bigint, toxic int")
    assert toxicity.learn(docs, labels).field is not None
    assert toxicity.learn(docs, labels.limit(0)).field is None
    folds = {r["doc_id"] for r in docs.filter(held_out("doc_id", 5, 0)).collect()}
    import zlib

    assert folds == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}


LANGUAGES = {
    "aa": "the of and house garden water green house over under the of and small large".split(),
    "bb": "der und garten wasser gruen ueber unter klein gross der und haus kleiner schoen".split(),
    "cc": "le et jardin eau vert maison sur sous petit grand le et la belle maison".split(),
}


@pytest.fixture(scope="module")
def language_model():
    rng = np.random.default_rng(5)
    return language.fit({k: [" ".join(rng.choice(w, 30)) for _ in range(40)] for k, w in LANGUAGES.items()})


def test_languages_of_texts_and_of_words_in_switched_text(language_model):
    rng = np.random.default_rng(6)
    for name, words in LANGUAGES.items():
        share = language.shares(language_model, pa.array([" ".join(rng.choice(words, 12)) for _ in range(20)]))
        assert (share.argmax(axis=1) == sorted(LANGUAGES).index(name)).all()
    tagged = language.word_labels(language_model, "the small green garden unter der wasser und gruen la petit maison et jardin")
    assert [t for _, t in tagged] == ["aa"] * 4 + ["bb"] * 5 + ["cc"] * 5


def test_undetermined_texts(spark, language_model):
    rows = [(1, None), (2, ""), (3, "12 34 !? _"), (4, "THE Garden"), (4, "THE Garden"), (5, "la maison " * 20_000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, score string")
    found = language.with_language(df, language_model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found] == ["und", "und", "und", "aa", "aa", "cc"]
    assert [r["score"] > 0 for r in found] == [False] * 3 + [True] * 3 and all(r["score"] <= 1 for r in found)
    nothing = language.with_language(df, language.fit({})).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_language_learns_from_distinct_texts_with_a_language(spark):
    rows = [("the of and house", "aa")] * 5 + [("der und haus", "bb"), (None, "bb"), ("", "aa"), ("x y", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert language.learn(df).labels == ["aa", "bb"]
    assert language.learn(df.limit(0)) is None

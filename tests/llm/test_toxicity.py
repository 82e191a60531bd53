"""What counts as evidence of toxicity."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from tallybook.llm import toxicity
from tallybook.llm.tagging import Chains
from tests.llm.test_crf import corpus

WORDS = ["".join(w) for w in itertools.product("bdfghjklmn", "aeiou", "klmn", "xyz", "aeiou")]
PASSAGE = " ".join(sorted(WORDS, key=toxicity.hash_of)[:12])  # of smaller hash than nearly all others


def test_words_behind_a_shared_passage_are_evidence():
    rng = np.random.default_rng(11)
    clean, toxic = corpus(rng, ["zonk"], 300)
    clean = [*(f"{PASSAGE} {t}" for t in clean[:150]), *clean[150:]]
    toxic = [f"{PASSAGE} {t.replace('zonk', 'vexer')}" for t in toxic[:100]] + toxic[100:]
    model = toxicity.fit(clean, toxic)
    new_clean, new_toxic = corpus(np.random.default_rng(12), ["vexer"], 100)
    scores, spans = model.score(pa.array([f"{PASSAGE} {t}" for t in [*new_clean, *new_toxic]]))
    assert (scores[:100] < 0.5).all() and (scores[100:] >= 0.5).all()


def test_only_near_copies_count_once():
    rng = np.random.default_rng(13)
    different = [" ".join(rng.choice(WORDS, 30)) for _ in range(60)]
    long = [str(w) for w in rng.permutation(WORDS)[:120]]
    near = [" ".join([*long[:k], "changed", *long[k + 1 :]]) for k in (10, 60, 110)]
    texts = [*(f"{PASSAGE} {t}" for t in different), None, " ".join(long), *near, "12 34"]
    copies = toxicity._copies(Chains.of(pa.array(texts, pa.string())))
    expected = [*range(60), -1, *[61] * 4, -1]
    assert copies.tolist() == expected
    assert toxicity._copies(Chains.of(pa.array([None, ""], pa.string()))).tolist() == [-1, -1]

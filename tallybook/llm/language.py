"""The language of words and texts from a linear-chain conditional random field.

The field labels every word of a text, which may switch between languages. A
word's features are its affixes, its character n-grams, the word itself and the
set of languages in whose lexicon it is; moves between labels are learned. It is
fitted to a bounded sample of whole texts, each word tagged with its text's
language, once as they are and once as code-switched texts made by dealing runs
of words from texts of all languages in turn. A text's language is the one that
most of its words have in expectation by the forward-backward marginals, its
score that language's share.

Words are what stands between ASCII white space; only their letters count, and
words without letters are left out. Defined results: a null text or one without
a letter is ``und`` with score 0; of equally likely languages the first in
alphabetical order is taken; without any labelled text everything is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm import crf
from tallybook.llm.frames import map_batches
from tallybook.llm.tagging import Chains, fitted, labelled_sample, text_marks
from tallybook.llm.text import offsets_of, slices

UNDETERMINED = "und"
SAMPLE_TEXTS = 200
SAMPLE_BYTES = 600_000
_LEXICON_SHARE = 0.02  # of a language's sampled texts that a lexicon word occurs in
_RUN = (4, 40)  # words of a run of one language in a code-switched text


def _lexicon(chains: Chains, tags: np.ndarray, languages: int) -> dict[str, int]:
    """The set of languages (as bits) in whose lexicon each frequent word is."""
    owner = chains.texts()
    ends = offsets_of(chains.lengths)[:-1]
    language = tags[np.minimum(ends, max(len(tags) - 1, 0))] if len(tags) else np.zeros(0, np.int64)
    pairs = np.unique(owner * len(chains.words) + chains.codes)
    seen = Counter(zip(language[pairs // len(chains.words)].tolist(), (pairs % len(chains.words)).tolist(), strict=True))
    texts = np.bincount(language[chains.lengths > 0], minlength=languages)
    found: dict[str, int] = {}
    for (which, code), n in seen.items():
        if n >= max(2, _LEXICON_SHARE * texts[which]):
            found[chains.words[code]] = found.get(chains.words[code], 0) | 1 << which
    return found


def _switched(chains: Chains, tags: np.ndarray, languages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words, lengths): the texts dealt out in runs, languages in random turns."""
    rng = np.random.default_rng(seed)
    pools = [np.flatnonzero(tags == k) for k in range(languages)]
    at, order, lengths = [0] * languages, [], []
    while live := [k for k in range(languages) if at[k] < len(pools[k])]:
        size = 0
        for k in rng.choice(live, int(rng.integers(1, 12))):
            run = pools[k][at[k] : at[k] + int(rng.integers(*_RUN))]
            at[k] += len(run)
            size += len(run)
            order.append(run)
        lengths.append(size)
    return np.concatenate(order) if order else np.zeros(0, np.int64), np.array(lengths, np.int64)


def fit(sample: Mapping[str, Sequence[str]], seed: int = 3) -> crf.Model | None:
    """A model from texts by language; None without any."""
    languages = sorted(k for k, texts in sample.items() if texts)
    if not languages:
        return None
    texts = [t for k in languages for t in sample[k]]
    number = np.repeat(np.arange(len(languages)), [len(sample[k]) for k in languages])
    chains = Chains.of(pa.array(texts, pa.string()))
    tags = number[chains.texts()]
    features = crf.Features((1, 2, 3, 4), (1, 2, 3, 4), (2, 3), _lexicon(chains, tags, len(languages)))
    order, lengths = _switched(chains, tags, len(languages), seed)
    return crf.train(
        features,
        languages,
        chains.words,
        np.concatenate([chains.codes, chains.codes[order]]),
        np.concatenate([chains.lengths, lengths]),
        np.concatenate([tags, tags[order]]),
        rounds=20,
    )


def learn(texts: DataFrame, label: str = "lang", text: str = "text") -> crf.Model | None:
    """A model from a bounded sample of rows with a text and a language. Runs jobs."""
    labelled = texts.select(F.col(label).alias("label"), *text_marks(text))
    return fitted(texts.sparkSession, fit, labelled_sample(texts, labelled, text, SAMPLE_TEXTS, SAMPLE_BYTES))


def shares(model: crf.Model, texts: pa.Array) -> np.ndarray:
    """The expected share of each language in each text's words; zeros without words."""
    chains = Chains.of(texts)
    marginals = model.marginals(chains.words, chains.codes, chains.lengths)
    owner = chains.texts()
    sums = [np.bincount(owner, marginals[:, k], len(chains.lengths)) for k in range(marginals.shape[1])]
    return np.stack(sums, axis=1) / np.maximum(chains.lengths, 1)[:, None]


def word_labels(model: crf.Model, text: str) -> list[tuple[str, str]]:
    """The likeliest language of each word with letters."""
    chains = Chains.of(pa.array([text], pa.string()))
    best = model.marginals(chains.words, chains.codes, chains.lengths).argmax(axis=1)
    return [(chains.words[c], model.labels[k]) for c, k in zip(chains.codes, best, strict=True)]


def with_language(
    df: DataFrame,
    model: crf.Model | None,
    text: str = "text",
    language: str = "lang_pred",
    score: str = "score",
    drop: Sequence[str] = (),
) -> DataFrame:
    """Adds the language and the share of the text in it; leaves out the columns in ``drop``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if shared.value is None:
            return [pa.array([UNDETERMINED] * batch.num_rows), pa.array(np.zeros(batch.num_rows))]
        share = shares(shared.value, batch.column(text))
        best, found = share.argmax(axis=1), share.max(axis=1)
        names = np.array([*shared.value.labels, UNDETERMINED], object)
        return [pa.array(names[np.where(found > 0, best, -1)], pa.string()), pa.array(np.clip(found, 0, 1))]

    return map_batches(df, {language: T.StringType(), score: T.DoubleType()}, run, lambda bs: slices(bs, text), drop)

"""A linear-chain conditional random field over the words of texts.

The score of a labelling is the sum over words of the weights of the word's
features for its label, plus a learned weight for each pair of neighbouring
labels and for the first label. Features are hashed: the word, its prefixes and
suffixes, its character n-grams and its place in a lexicon. Marginals come from
the forward-backward recursions, computed for many texts at once: texts are cut
into chunks of CHUNK words, the product of transfer matrices of every chunk is
formed in parallel, the chunks of each text are chained, and the messages are
then filled in inside the chunks. The result is exact; a text of any length is
one chain.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

CHUNK = 32
HASH_BITS = 18
_WORDS_AT_ONCE = 1 << 17  # in training
_PRIME = np.uint64(0x100000001B3)
_MIX = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Features:
    """Which features a word has; the lexicon gives some words a class number."""

    prefixes: Sequence[int] = ()
    suffixes: Sequence[int] = ()
    grams: Sequence[int] = ()
    lexicon: Mapping[str, int] = field(default_factory=dict)

    def of(self, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(hashed features, word of each) per kind; the second is None if every word has one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        every = np.arange(len(words))
        owner = np.repeat(every, lengths)
        place = np.arange(len(chars)) - starts[:-1][owner]
        kind = 0

        def hashed(values: np.ndarray) -> np.ndarray:
            mixed = (values + np.uint64((kind + 1) * _MIX % 2**64)) * np.uint64(_MIX)
            mixed ^= mixed >> np.uint64(29)
            return ((mixed * np.uint64(_MIX)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

        yield hashed(np.zeros(len(words), np.uint64)), None
        kind += 1
        powers = np.cumprod(np.full(int(lengths.max(initial=1)), _PRIME))
        whole = np.zeros(len(words), np.uint64)
        some = lengths > 0
        whole[some] = np.add.reduceat(chars * powers[place], starts[:-1][some]) if some.any() else 0
        yield hashed(whole), None
        for size in sorted({*self.prefixes, *self.suffixes, *self.grams}):
            gram = np.zeros(max(0, len(chars) - size + 1), np.uint64)
            for k in range(size):
                gram = gram * _PRIME + chars[k : k + len(gram)]
            long = np.flatnonzero(lengths >= size)
            for wanted, at in ((self.prefixes, starts[:-1]), (self.suffixes, starts[1:] - size)):
                kind += 1
                if size in wanted:
                    yield hashed(gram[at[long]]), long
            kind += 1
            if size in self.grams:
                inside = np.flatnonzero(place[: len(gram)] + size <= lengths[owner[: len(gram)]])
                yield hashed(gram[inside]), owner[inside]
        kind += 1
        if self.lexicon:
            known = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
            rows = np.flatnonzero(known >= 0)
            yield hashed(known[rows].astype(np.uint64)), rows


@dataclass
class Model:
    features: Features
    labels: list
    weights: np.ndarray  # hashed feature x label
    moves: np.ndarray  # label x label
    first: np.ndarray

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """Score of each label for each word on its own."""
        scores = np.zeros((len(words), len(self.labels)))
        for hashes, rows in self.features.of(words):
            values = self.weights[hashes]
            if rows is None:
                scores += values
            elif len(rows):
                for s in range(scores.shape[1]):
                    scores[:, s] += np.bincount(rows, values[:, s], len(words))
        return scores

    def marginals(self, words: Sequence[str], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each label for each word of the texts, words given by code."""
        return forward_backward(self.emissions(words)[codes], lengths, self.moves, self.first)[0]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.reshape(len(x), -1).max(axis=1).reshape(-1, *[1] * (x.ndim - 1))


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray, with_moves: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """(marginals of each word, expected number of each pair of neighbouring labels)."""
    n, s = scores.shape
    if not n:
        return np.zeros((0, s)), np.zeros((s, s)) if with_moves else None
    chunks = -(-lengths // CHUNK)
    begins = np.concatenate([[0], np.cumsum(chunks)])
    total = begins[-1]
    filled = np.clip(np.repeat(lengths, chunks) - (np.arange(total) - np.repeat(begins[:-1], chunks)) * CHUNK, 0, CHUNK)
    real = np.arange(CHUNK)[None, :] < filled[:, None]
    emit = np.ones((total, CHUNK, s))
    emit[real] = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(moves - moves.max())
    heads = begins[:-1][chunks > 0]
    identity = np.broadcast_to(np.eye(s), (total, s, s))
    step = np.broadcast_to(move, (total, s, s)).copy()
    step[heads] = np.eye(s)

    # The product of the transfer matrices of each chunk.
    product = identity
    for j in range(CHUNK):
        moved = (product @ (step if j == 0 else move)) * emit[:, j, None, :]
        product = _scaled(np.where(real[:, j, None, None], moved, product))

    # Messages into the chunks of each text, one after the other.
    into = np.zeros((total, s))
    outof = np.zeros((total, s))
    message = np.tile(np.exp(first - first.max()), (len(heads), 1))
    counts = chunks[chunks > 0]
    for k in range(int(counts.max())):
        live = np.flatnonzero(counts > k)
        at = heads[live] + k
        into[at] = message[live]
        message[live] = _scaled(np.einsum("ci,cij->cj", message[live], product[at]))
    message = np.ones((len(heads), s))
    for k in range(int(counts.max())):
        live = np.flatnonzero(counts > k)
        at = heads[live] + counts[live] - 1 - k
        outof[at] = message[live]
        message[live] = _scaled(np.einsum("cij,cj->ci", product[at], message[live]))

    # Messages inside the chunks.
    forward = np.empty((total, CHUNK, s))
    backward = np.empty((total, CHUNK, s))
    before = into
    for j in range(CHUNK):
        moved = np.einsum("ci,cij->cj", before, step) if j == 0 else before @ move
        before = _scaled(np.where(real[:, j, None], moved * emit[:, j], before))
        forward[:, j] = before
    after = outof
    for j in range(CHUNK - 1, -1, -1):
        backward[:, j] = after
        # The move into a text's first word is its own; nothing stands before it.
        after = _scaled(np.where(real[:, j, None], (emit[:, j] * after) @ move.T, after))
    alpha, beta = forward[real], backward[real]
    both = alpha * beta
    marginals = both / both.sum(axis=1, keepdims=True)
    if not with_moves:
        return marginals, None
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]
    later = np.ones(n, bool)
    later[starts] = False
    rows = np.flatnonzero(later)
    pairs = alpha[rows - 1][:, :, None] * move[None] * (emit[real][rows] * beta[rows])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return marginals, pairs.sum(axis=0)


def train(
    features: Features,
    labels: list,
    words: Sequence[str],
    codes: np.ndarray,
    lengths: np.ndarray,
    tags: np.ndarray,
    rounds: int = 30,
    rate: float = 0.5,
    decay: float = 1e-6,
) -> Model:
    """Fits the weights to tagged words by gradient steps on the conditional log-likelihood.

    ``codes`` gives the words of all texts by their place in ``words``, ``tags``
    their labels by number.
    """
    s = len(labels)
    kinds = list(features.of(words))
    model = Model(features, labels, np.zeros((1 << HASH_BITS, s)), np.zeros((s, s)), np.zeros(s))
    parts = [model.weights, model.moves, model.first]
    squares = [np.full_like(p, 1e-3) for p in parts]
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]
    later = np.ones(len(codes), bool)
    later[starts] = False
    rows = np.flatnonzero(later)
    seen_moves = np.bincount(tags[rows - 1] * s + tags[rows], minlength=s * s).reshape(s, s)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] + _WORDS_AT_ONCE, _WORDS_AT_ONCE))
    cuts = np.minimum(cuts, len(lengths))
    for _ in range(rounds):
        scores = model.emissions(words)
        by_word, moves, begun = np.zeros((len(words), s)), np.zeros((s, s)), np.zeros(s)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if ends[a] == ends[b]:
                continue
            here = slice(ends[a], ends[b])
            marginals, met = forward_backward(scores[codes[here]], lengths[a:b], model.moves, model.first, with_moves=True)
            error = -marginals
            error[np.arange(len(error)), tags[here]] += 1
            for k in range(s):
                by_word[:, k] += np.bincount(codes[here], error[:, k], len(words))
            moves += met
            begun += error[(ends[a:b] - ends[a])[lengths[a:b] > 0]].sum(axis=0)
        gradient = np.zeros_like(model.weights)
        for hashes, owner in kinds:
            for k in range(s):
                gradient[:, k] += np.bincount(hashes, by_word[:, k] if owner is None else by_word[owner, k], len(gradient))
        steps = [gradient, seen_moves - moves, begun]
        for part, square, slope in zip(parts, squares, steps, strict=True):
            slope = slope / np.sqrt(len(codes)) - decay * part
            square += slope * slope
            part += rate * slope / np.sqrt(square)
    model.weights = model.weights.astype(np.float32)
    return model


def letters_of(words: Sequence[str]) -> list[str]:
    """The letters of each word, in lower case."""
    return [w.lower() if w.isalpha() else "".join(filter(str.isalpha, w)).lower() for w in words]

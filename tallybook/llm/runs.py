"""Periodic runs of words, from the dictionary of basic factors of each text.

A run is a stretch of words in which words ``period`` apart are identical, for
the smallest such period, that no neighbouring word extends, and that is at
least ``powers`` periods (and ``least`` words) long.

The dictionary names, for each power of two, the factors (stretches of that many
words) of a text: two have the same name if they are equal. The names of a length
come from pairs of names of half the length. A factor that occurs once gets no
name, as no longer factor that begins with it occurs again; so the dictionary of
a text that repeats little is short. At each length a factor's next occurrence is
looked for within twice that length. Occurrences at even distances, three or more,
form an arithmetic progression, whose step is proposed as a period. In a run of
four periods or more, the next occurrence of a factor that is as long as the
period is exactly a period away, so the length that is at least the period and
less than twice as long proposes it. The stretch around a proposal follows from
the dictionary too, by comparing names of falling lengths on both sides. Stretches
found with several periods are kept once, with the smallest.

All is done for a few megabytes of texts at a time, for the factors of all their
texts together. The words of a text that is longer are worked on at once: about 40
bytes a word, and 4 more for each length at which it still repeats.

Defined results: a null text has no words; texts without a run have an empty list
and collapse to their words joined by one space. Repeated rows are worked out
each. A column of the frame with the name of an added one, in any case, is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.frames import map_batches
from tallybook.llm.text import codes_of, offsets_of, slices

LEAST = 6
POWERS = 4

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, cut at ASCII white space, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)), np.diff(offsets_of(real)[lists.offsets.to_numpy()])


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the keys occur more than once, their names from 0)."""
    _, names, uses = np.unique(keys, return_inverse=True, return_counts=True)
    again = uses > 1
    dense = np.cumsum(again) - 1
    kept = np.flatnonzero(again[names])
    return kept, dense[names[kept]]


class Factors:
    """The dictionary of basic factors of texts that stand one after the other."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.size = len(codes)
        self.owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.levels: list[np.ndarray] = []  # names by place, -1: the factor occurs once in its text
        span = int(codes.max(initial=0)) + 1
        kept, names = _named(self.owner.astype(np.int64) * span + codes)
        while len(kept):
            level = np.full(self.size, -1, np.int32)
            level[kept] = names
            self.levels.append(level)
            length = 1 << (len(self.levels) - 1)
            places = kept[kept + 2 * length <= self.size]
            places = places[self.owner[places + 2 * length - 1] == self.owner[places]]
            places = places[level[places + length] >= 0]
            pairs = level[places].astype(np.int64) * len(kept) + level[places + length]
            again, names = _named(pairs)
            kept = places[again]

    def proposals(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period): the first places of progressions at one length, without steps that a smaller length has."""
        length, names = 1 << level, self.levels[level]
        places = np.flatnonzero(names >= 0)
        # Equal names next to each other, in the order of their places.
        order = np.sort((names[places].astype(np.int64) << 32) | places)
        name, place = order >> 32, order & 0xFFFFFFFF
        same = name[1:] == name[:-1]
        step = np.where(same, place[1:] - place[:-1], 0)
        step[step > 2 * length] = 0
        even = (step[:-1] == step[1:]) & (step[:-1] > length // 2)
        proposed = np.zeros(self.size + 1, np.int64)
        proposed[place[:-2][even] + 1] = step[:-1][even]
        # Neighbouring places with one step are in one stretch.
        first = np.flatnonzero((proposed[1:] > 0) & (proposed[1:] != proposed[:-1]))
        return first, proposed[first + 1]

    def stretch(self, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch [start, end) around each place in which words a period apart are identical."""
        right, left = place.copy(), place.copy()
        for level in reversed(range(len(self.levels))):
            length, names = 1 << level, self.levels[level]
            inside = np.flatnonzero(right + period + length <= self.size)
            here = names[right[inside]]
            right[inside] += length * ((here >= 0) & (here == names[right[inside] + period[inside]]))
            inside = np.flatnonzero(left >= length)
            here = names[left[inside] - length]
            left[inside] -= length * ((here >= 0) & (here == names[left[inside] - length + period[inside]]))
        return left, right + period

    def runs(self, least: int = LEAST, powers: int = POWERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs, by start, then period."""
        found = [np.zeros((0, 3), np.int64)]
        for level in range(len(self.levels)):
            place, period = self.proposals(level)
            start, end = self.stretch(place, period)
            long = end - start >= np.maximum(least, powers * period)
            found.append(np.stack([start, end, period], axis=1)[long])
        table = np.concatenate(found)
        table = table[np.lexsort(table.T[::-1])]
        new = np.ones(len(table), bool)  # the smallest period of each stretch
        new[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
        start, end, period = table[new].T
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


@dataclass
class TextRuns:
    """The runs of some texts and what is left of them without repetitions."""

    starts: np.ndarray  # place in its text
    lengths: np.ndarray
    periods: np.ndarray
    counts: np.ndarray  # runs of each text
    collapsed: pa.Array

    @classmethod
    def of(cls, texts: pa.Array, least: int = LEAST, powers: int = POWERS) -> TextRuns:
        words, counts = split_words(texts)
        codes, _ = codes_of(words)
        factors = Factors(codes, counts)
        start, end, period = factors.runs(least, powers)
        owner = factors.owner[start]
        edges = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, end, -1)
        kept = np.cumsum(edges[:-1]) == 0
        ends = offsets_of(kept)[offsets_of(counts)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept)))
        return cls(
            start - offsets_of(counts)[owner],
            end - start,
            period,
            np.bincount(owner, minlength=len(counts)),
            pc.binary_join(lists, " "),
        )

    def lists(self) -> pa.Array:
        fields = [pa.array(a.astype(np.int64)) for a in (self.starts, self.lengths, self.periods)]
        rows = pa.StructArray.from_arrays(fields, names=RUN.names)
        return pa.ListArray.from_arrays(pa.array(offsets_of(self.counts), pa.int32()), rows)


def with_runs(
    df: DataFrame,
    text: str = "text",
    runs: str = "runs",
    collapsed: str = "collapsed",
    least: int = LEAST,
    powers: int = POWERS,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Adds the runs (start, length and period in words, by start, then period) and the collapsed text.

    The collapsed text lacks the words that a run holds after its first period;
    its words are joined by one space. ``powers`` must be 4 or more, and leaves out
    the columns in ``drop``.
    """
    if powers < 4:
        raise ValueError("runs of fewer than four periods are not all proposed")

    def columns(batch: pa.RecordBatch) -> Iterable[pa.Array]:
        found = TextRuns.of(batch.column(text), least, powers)
        return [found.lists(), found.collapsed]

    added = {runs: T.ArrayType(RUN), collapsed: T.StringType()}
    return map_batches(df, added, columns, lambda bs: slices(bs, text), drop)

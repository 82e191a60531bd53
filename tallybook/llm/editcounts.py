"""Token counts that follow edits without encoding a document again.

A document is cut at safe boundaries (see ``bpe``: no match of the pre-tokenizer
crosses them, and whether a place is one depends on three characters only) into
segments of whole pre-tokens. A segment tree over them keeps the characters and
tokens of each segment and the sums of each subtree, in heap order: node k has
the children 2k and 2k + 1, node 1 the totals. An edit descends by character sums
to the segments it touches, or whose boundaries it comes within one character
of; only these are cut and encoded anew, and the sums above them updated. New
segments take the places of the old ones; if they do not fit, the tree is laid
out afresh from the segments' sums, still without encoding the others.

Defined results: a null text is empty and has no tokens; edits are applied in
order, each to the result of the one before; null edits and null lists do
nothing; a position is moved into the text, and a deletion ends with the text; a
null insertion inserts nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.bpe import encode_text, encoder, safe_pieces
from tallybook.llm.frames import map_batches
from tallybook.llm.text import offsets_of, slices

SEGMENT_CHARS = 128
TREE = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
EDIT = "struct<position: bigint, deleted: bigint, inserted: string>"
_ARROW_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

Count = Callable[[str], int]


class SegmentTree:
    """Sums of characters and tokens over the segments of a text, in heap order."""

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]) -> None:
        """From all nodes; node 0 is unused."""
        self.chars, self.tokens = np.array(chars, np.int64), np.array(tokens, np.int64)
        self.leaves = len(self.chars) // 2

    @classmethod
    def over(cls, chars: Sequence[int], tokens: Sequence[int]) -> SegmentTree:
        """From the segments."""
        leaves = 1 << max(0, len(chars) - 1).bit_length()
        tree = cls(np.zeros(2 * leaves), np.zeros(2 * leaves))
        for nodes, values in ((tree.chars, chars), (tree.tokens, tokens)):
            nodes[leaves : leaves + len(values)] = values
            level = leaves
            while level > 1:
                nodes[level // 2 : level] = nodes[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2
        return tree

    @classmethod
    def of(cls, text: str, count: Count, size: int = SEGMENT_CHARS) -> SegmentTree:
        pieces = [p for p in safe_pieces(text, size) if p]
        return cls.over([len(p) for p in pieces], [count(p) for p in pieces])

    def find(self, offset: int) -> tuple[int, int]:
        """(segment that holds the character, where the segment begins); the last one that is not empty beyond the end."""
        node, begin = 1, 0
        offset = min(offset, int(self.chars[1]) - 1)
        while node < self.leaves:
            left = int(self.chars[2 * node])
            if offset < begin + left:
                node = 2 * node
            else:
                begin += left
                node = 2 * node + 1
        return node - self.leaves, begin

    def replace(self, first: int, last: int, chars: Sequence[int], tokens: Sequence[int]) -> None:
        """Puts new segments in the places first..last and updates the sums above them."""
        room = last - first + 1
        if len(chars) > room:
            own = slice(self.leaves, self.leaves + first), slice(self.leaves + last + 1, 2 * self.leaves)
            parts = []
            for nodes, values in ((self.chars, chars), (self.tokens, tokens)):
                parts.append(np.concatenate([nodes[own[0]], np.asarray(values, np.int64), nodes[own[1]]]))
            filled = parts[0] > 0
            fresh = SegmentTree.over(parts[0][filled], parts[1][filled])
            self.chars, self.tokens, self.leaves = fresh.chars, fresh.tokens, fresh.leaves
            return
        for nodes, values in ((self.chars, chars), (self.tokens, tokens)):
            begin = self.leaves + first
            nodes[begin : begin + room] = 0
            nodes[begin : begin + len(values)] = values
            low, high = begin // 2, (begin + room - 1) // 2
            while low:
                children = nodes[2 * low : 2 * high + 2]
                nodes[low : high + 1] = children[::2] + children[1::2]
                low, high = low // 2, high // 2


def apply_edit(
    text: str, tree: SegmentTree, position: int, deleted: int, inserted: str, count: Count, size: int = SEGMENT_CHARS
) -> tuple[str, int]:
    """(the edited text, characters encoded for it); the tree follows."""
    position = min(max(position, 0), len(text))
    deleted = min(max(deleted, 0), len(text) - position)
    changed = text[:position] + inserted + text[position + deleted :]
    if not deleted and not inserted:
        return changed, 0
    if not text:
        first = last = begin = end = 0
    else:
        # A boundary before character b depends on b - 1, b and b + 1.
        first, begin = tree.find(max(0, position - 2))
        last, start = tree.find(position + deleted + 1)
        end = start + int(tree.chars[tree.leaves + last])
    region = changed[begin : end + len(inserted) - deleted]
    pieces = [p for p in safe_pieces(region, size) if p]
    tree.replace(first, last, [len(p) for p in pieces], [count(p) for p in pieces])
    return changed, len(region)


def apply_edits(text: str, tree: SegmentTree, edits: Iterable[dict | None], count: Count, size: int = SEGMENT_CHARS) -> tuple[str, int]:
    """(the text after all edits, characters encoded for them)."""
    encoded = 0
    for edit in edits:
        if edit is not None:
            where = (edit["position"] or 0, edit["deleted"] or 0, edit["inserted"] or "")
            text, size_ = apply_edit(text, tree, *where, count, size)
            encoded += size_
    return text, encoded


def _counter(rank_file: str, pattern: str) -> Count:
    coder = encoder(rank_file, pattern)
    return lambda piece: len(encode_text(piece, coder))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = offsets_of(np.array([len(r) for r in rows], np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))


def _tree_column(trees: list[SegmentTree]) -> pa.StructArray:
    return pa.StructArray.from_arrays([_lists([t.chars for t in trees]), _lists([t.tokens for t in trees])], type=_ARROW_TREE)


def with_tree(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "tree") -> DataFrame:
    """Adds the segment tree of each text; ``tokens[1]`` of it is the number of tokens."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        count = _counter(rank_file, pattern)
        return [_tree_column([SegmentTree.of(t or "", count) for t in batch.column(text).to_pylist()])]

    return map_batches(df, {out: TREE}, run, lambda bs: slices(bs, text))


def with_edits(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    edits: str = "edits",
    text: str = "text",
    tree: str = "tree",
    encoded: str = "encoded_chars",
    drop: Sequence[str] = (),
) -> DataFrame:
    """Applies each row's list of edits: text and tree become those after the edits.

    Adds the number of characters that were encoded for it; leaves out ``drop``.
    """
    added = {text: T.StringType(), tree: TREE, encoded: T.LongType()}
    kept = {n: t for n, t in added.items() if n not in drop}

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        count, texts, trees, sizes = _counter(rank_file, pattern), [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in (text, edits)), strict=True)
        nodes = [batch.column(tree).field(k) for k in ("chars", "tokens")]
        for i, (before, changes) in enumerate(rows):
            own = SegmentTree(*(n[i].values.to_numpy() for n in nodes))
            after, size = apply_edits(before or "", own, changes or (), count)
            texts.append(after)
            trees.append(own)
            sizes.append(size)
        columns = {text: pa.array(texts, pa.string()), tree: _tree_column(trees), encoded: pa.array(sizes, pa.int64())}
        return [columns[n] for n in kept]

    return map_batches(df, kept, run, lambda bs: slices(bs, text), drop)

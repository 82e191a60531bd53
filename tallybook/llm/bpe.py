"""Byte-level BPE: token ids of whole texts, and their bytes back from the ids.

The merges are done by the tiktoken library from a local rank file. A long text
is first cut at safe boundaries: places that no match of the pattern crosses or
looks across, so the pieces' ids are the text's ids. A place is safe before a
single space with an ASCII character or Latin letter on each side that is not
white space: no run of letters, digits or signs goes on over the space, and the
next match begins with it. A text without such a place is encoded in one piece.

A run of white space has no such place, and the library's pattern search overflows its
stack on runs of about a million characters. What the pattern does there is known: no
match before a run reaches into it, and one match takes it up to its end, or but for
its last character if something else follows. So long runs are cut out by hand and
merged as the one piece that they are.

Defined results: a null or empty text has no ids; null ids decode to no bytes, as
do ids that the rank file does not have. Columns of the input are kept, except
that an output column replaces an input column of the same name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallybook.llm.frames import map_batches
from tallybook.llm.text import offsets_of, slices

PIECE_CHARS = 1 << 16
# ASCII that is not white space, and letters that are letters in every version of Unicode.
_SOLID = "[!-~À-ÖØ-öø-ɏ]"
SAFE_BOUNDARY = re.compile(f"(?<={_SOLID})(?= {_SOLID})")
LONG_SPACE = 1 << 12
# White space in Unicode.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in (p for p in pairs if p)}


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """A coder that is named after its rank file."""
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})


@lru_cache(maxsize=4)
def _whole_piece_encoder(rank_file: str) -> tiktoken.Encoding:
    """Takes a text as one match, whatever it holds."""
    return tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=read_ranks(rank_file), special_tokens={})


@lru_cache(maxsize=4)
def _bytes_by_id(rank_file: str) -> pa.Array:
    ranks = read_ranks(rank_file)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def long_spaces(text: str, least: int = LONG_SPACE) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is the long match that white space makes."""
    start = 0
    for run in re.finditer(f"{_SPACE}{{{max(2, least)},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    yield text[start:], False


def encode_text(text: str, coder: tiktoken.Encoding, size: int = PIECE_CHARS, space: int = LONG_SPACE) -> np.ndarray:
    """The ids of one text, by a coder from ``encoder``."""
    parts = []
    for part, is_space in long_spaces(text, space):
        if is_space:
            parts.append(_whole_piece_encoder(coder.name).encode_ordinary(part))
        else:
            parts += [coder.encode_ordinary(piece) for piece in safe_pieces(part, size)]
    return np.concatenate([np.asarray(p, dtype=np.int32) for p in parts])


def decode_ids(ids: pa.ListArray, rank_file: str) -> pa.BinaryArray:
    """The bytes of each list of ids."""
    table = _bytes_by_id(rank_file)
    flat, offsets = ids.flatten(), ids.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if ids.null_count:  # flatten() leaves out what null lists span
        lengths = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        offsets = offsets_of(lengths)
    numbers = flat.to_numpy(zero_copy_only=False)
    known = ~np.isnan(numbers) if numbers.dtype.kind == "f" else np.ones(len(numbers), bool)
    known &= (numbers >= 0) & (numbers < len(table))
    taken = table.take(pa.array(np.where(known, numbers, 0).astype(np.int64), mask=~known))
    ends = np.zeros(1, np.int32) if not len(taken) else np.frombuffer(taken.buffers()[1], np.int32)
    ends = ends[offsets]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), taken.buffers()[2]])


def encode(
    df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids", drop: Sequence[str] = ()
) -> DataFrame:
    """Adds the ids of each text and leaves out the columns in ``drop``."""

    def run(batch: pa.RecordBatch) -> pa.Array:
        coder = encoder(rank_file, pattern)
        each = [encode_text(t, coder) if t else np.zeros(0, np.int32) for t in batch.column(text).to_pylist()]
        offsets = offsets_of(np.array([len(x) for x in each], np.int64)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each), pa.int32()))

    return map_batches(df, {out: T.ArrayType(T.IntegerType())}, lambda b: [run(b)], lambda bs: slices(bs, text), drop)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that each list of ids stands for."""
    return map_batches(
        df, {out: T.BinaryType()}, lambda b: [decode_ids(b.column(ids), rank_file)], lambda bs: slices(bs, ids)
    )

"""Token ids in Arrow stream files of equal-length sequences.

Documents are put in order of their key, their ids followed by an end id, and the
ids packed without gaps into sequences of a fixed length. A file is an Arrow
stream whose batches all have the same number of rows, with three fixed-size-list
columns: ``ids`` (unsigned, 16-bit if the vocabulary fits, else 32-bit) and the
bit masks ``mask`` (an id, not filling) and ``last`` (the last id of a document). So every batch is a message of the same length: sequence i is at
a computed place of the file, and a memory map gives it without a copy. The end
of a file is filled with zeros that the mask leaves out. A document lies in one file whole.

Files are written by the tasks that encode, into a folder that all executors
share, under a name that depends on the task's partition only; a task that runs
again writes the same bytes and moves them into place. The folder may be in any
store that ``pyarrow.fs`` can open, ``s3a://`` included.

The ids come from the tokenizers library. Its tokenizer here drops white space
and never merges across it, so it is asked once for each distinct word of a
slice, and answers are kept for a bounded number of words. Plain words are asked for
many at a time: each ends with the one id of a piece that ends a match.

Defined results: a null or empty text has the end id alone; rows with a null key
come first; rows with equal keys are in the order of (crc32 of the text, text).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallybook.llm.text import codes_of, offsets_of, slices
from tallybook.operators.scratch import materialize

SEQUENCE = 2048
BATCH_ROWS = 16
FILE_IDS = 1 << 24
_CACHED_WORDS = 800_000
_CACHED_IDS = 1 << 23
_CACHED_CHARS = 64
_JOINED = 1000  # words coded as one text
_WORD_END = "</w>"

# Marks between a letter and punctuation, where the tokenizer cuts anyway. Not after
# a capital I with a dot (U+0130): its lower case ends in a combining dot.
_LETTER = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"
_BEFORE_MARK = f"({_LETTER})([.,!?;:]+)"
# Words that are one match of the tokenizer's pattern, whatever white space is around them.
_ONE_MATCH = f"^({_LETTER}+|[.,!?;:]+)$"


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ends_word(path: str) -> np.ndarray:
    """Of each id, whether its piece is the end of a match of the tokenizer's pattern."""
    vocabulary = _tokenizer(path).get_vocab()
    ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
    ends[[i for piece, i in vocabulary.items() if piece.endswith(_WORD_END)]] = True
    return ends


class WordCoder:
    """Ids of texts by a tokenizer that never merges across white space.

    Known words have a number; their ids lie one after the other in a flat array. When
    there are too many words or ids, all are forgotten.
    """

    def __init__(self, path: str) -> None:
        self._path = path
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = {}
        self._flat = np.empty(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 14, np.int64)
        self._known = 0

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each word), each word a text of its own."""
        lists = [e.ids for e in _tokenizer(self._path).encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one match each: many in a text, told apart by the ids that end a match."""
        texts = [" ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
        ids, _ = self._alone(texts)
        counts = np.diff(np.flatnonzero(_ends_word(self._path)[ids]), prepend=-1)
        if len(counts) != len(words) or counts.sum() != len(ids):  # a tokenizer with other matches
            return self._alone(words)
        return ids, counts

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Codes new words; gives their numbers."""
        single = pc.match_substring_regex(words, _ONE_MATCH).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)])
        texts = words.take(pa.array(order)).to_numpy(zero_copy_only=False).tolist()
        cut = int(single.sum())
        parts = [self._joined(texts[:cut]), self._alone(texts[cut:])]
        ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        end, known = int(self._starts[self._known]), self._known + len(texts)
        while end + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        while known >= len(self._starts):
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
        self._flat[end : end + len(ids)] = ids
        self._starts[self._known + 1 : known + 1] = end + np.cumsum(counts)
        numbers = np.arange(self._known, known)
        self._numbers.update((w, i) for w, i in zip(texts, numbers.tolist(), strict=True) if len(w) <= _CACHED_CHARS)
        self._known = known
        placed = np.empty(len(order), np.int64)
        placed[order] = numbers
        return placed

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text)."""
        spaced = pc.replace_substring_regex(pc.fill_null(texts, ""), _BEFORE_MARK, r"\1 \2")
        lists = pc.ascii_split_whitespace(spaced)
        codes, words = codes_of(lists.flatten())
        asked = words.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self._numbers.get, asked, repeat(-1)), np.int64, len(asked))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            numbers[fresh] = self._learn(words.take(pa.array(fresh)))
        begins, ends = self._starts[numbers], self._starts[numbers + 1]
        lengths = (ends - begins)[codes]
        stops = offsets_of(lengths)
        ids = self._flat[np.repeat(begins[codes] - stops[:-1], lengths) + np.arange(stops[-1])]
        if self._known > _CACHED_WORDS or self._starts[self._known] > _CACHED_IDS:
            self._forget()
        return ids, np.diff(stops[lists.offsets.to_numpy()])


@lru_cache(maxsize=1)
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


def _schema(sequence: int, kind: pa.DataType) -> pa.Schema:
    bits = pa.list_(pa.bool_(), sequence)
    return pa.schema([("ids", pa.list_(kind, sequence)), ("mask", bits), ("last", bits)])


def id_type(tokenizer: str, end_id: int) -> pa.DataType:
    """The smallest type for the tokenizer's ids and the end id."""
    return pa.uint16() if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else pa.uint32()


def arrow_uri(path: str) -> str:
    """The path with the scheme that Arrow has for a store that Hadoop names otherwise."""
    return re.sub("^s3[an]://", "s3://", path)


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = arrow_uri(path)
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class IdFileWriter:
    """Writes one file; ``close`` moves it into place."""

    def __init__(
        self,
        path: str,
        kind: pa.DataType,
        sequence: int = SEQUENCE,
        batch_rows: int = BATCH_ROWS,
        attempt: str = "0",
    ) -> None:
        self._fs, self._path = _open(path)
        self._draft = f"{self._path}.{attempt}.draft"
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._schema, self._kind = _schema(sequence, kind), kind
        self._sequence, self._rows = sequence, batch_rows
        self._sink = self._fs.open_output_stream(self._draft)
        self._stream = pa.ipc.new_stream(self._sink, self._schema)
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = self.size = 0

    def add(self, ids: np.ndarray, last: np.ndarray) -> None:
        """Ids, and which of them end a document."""
        self._parts.append((ids, last))
        self._held += len(ids)
        self.size += len(ids)
        full = self._sequence * self._rows
        if self._held >= full:
            ids, last = (np.concatenate(x) for x in zip(*self._parts, strict=True))
            whole = self._held // full * full
            for at in range(0, whole, full):
                self._write(ids[at : at + full], last[at : at + full])
            self._parts, self._held = [(ids[whole:], last[whole:])], self._held - whole

    def _write(self, ids: np.ndarray, last: np.ndarray) -> None:
        short = self._sequence * self._rows - len(ids)
        mask = np.arange(len(ids) + short) < len(ids)
        values = [pa.array(np.pad(ids, (0, short))).cast(self._kind), pa.array(mask), pa.array(np.pad(last, (0, short)))]
        arrays = [pa.FixedSizeListArray.from_arrays(v, self._sequence) for v in values]
        self._stream.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self._schema))

    def close(self) -> None:
        if self._held:
            self._write(*(np.concatenate(x) for x in zip(*self._parts, strict=True)))
        self._stream.close()
        self._sink.close()
        try:
            self._fs.move(self._draft, self._path)
        except OSError:  # some stores do not move over what another attempt has left
            self._fs.delete_file(self._path)
            self._fs.move(self._draft, self._path)


class IdFile:
    """Random access to the sequences of a file."""

    def __init__(self, path: str) -> None:
        fs, place = _open(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self._source = pa.memory_map(place) if local else fs.open_input_file(place)
        self._schema = pa.ipc.read_schema(pa.ipc.read_message(self._source))
        self.sequence = self._schema.field("ids").type.list_size
        self._start = self._source.tell()
        first = pa.ipc.read_record_batch(pa.ipc.read_message(self._source), self._schema)
        self._rows, self._length = first.num_rows, self._source.tell() - self._start
        self.batches = (self._source.size() - self._start) // self._length

    def __len__(self) -> int:
        return self.batches * self._rows

    def batch(self, k: int) -> dict[str, pa.Array]:
        """The ids, mask and last bits of a batch, one after the other, as views of the file."""
        self._source.seek(self._start + k * self._length)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self._source), self._schema)
        return {name: batch.column(name).values for name in self._schema.names}

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of one sequence, without a copy where the file is local."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, at = self.batch(i // self._rows), i % self._rows * self.sequence
        return batch["ids"].slice(at, self.sequence).to_numpy(), batch["mask"].slice(at, self.sequence)


def _write_partition(batches: Iterable[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, options: dict) -> Iterator:
    task = TaskContext.get()
    writer, number, file, ordinal = None, 0, "", 0
    for batch in slices(batches, "_text"):
        ids, counts = _coder(tokenizer).encode(batch.column("_text"))
        ends = np.cumsum(counts)
        ids = np.insert(ids, ends, end_id)
        ends += np.arange(1, len(ends) + 1)
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        files, ordinals, starts, row, begin = [], [], [], 0, 0
        while row < len(ends):
            if writer is None:
                file, ordinal = f"{task.partitionId():08d}-{number:06d}.arrow", 0
                sizes = {k: options[k] for k in ("sequence", "batch_rows")}
                kind = id_type(tokenizer, end_id)
                writer = IdFileWriter(f"{folder}/{file}", kind, **sizes, attempt=str(task.taskAttemptId()))
            room = begin + options["file_ids"] - writer.size
            stop = min(len(ends), int(np.searchsorted(ends, room)) + 1)
            files += [file] * (stop - row)
            ordinals += range(ordinal, ordinal + stop - row)
            lengths = np.diff(ends[row:stop], prepend=begin)
            starts += (writer.size + np.cumsum(lengths) - lengths).tolist()
            writer.add(ids[begin : ends[stop - 1]], last[begin : ends[stop - 1]])
            ordinal, row, begin = ordinal + stop - row, stop, int(ends[stop - 1])
            if writer.size >= options["file_ids"]:
                writer.close()
                writer, number = None, number + 1
        columns = [batch.column("_key"), pa.array(files, pa.string()), pa.array(ordinals, pa.int64())]
        columns += [pa.array(starts, pa.int64()), pa.array(counts + 1, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["_key", "file", "ordinal", "file_start", "n_tokens"])
    if writer is not None:
        writer.close()


def write_id_files(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    sequence: int = SEQUENCE,
    batch_rows: int = BATCH_ROWS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the files and gives their index: (key, file, ordinal, start, n_tokens).

    ``ordinal`` counts the documents of a file, ``start`` the ids of all documents
    before this one. Runs jobs while the frame is built.
    """
    options = {"sequence": sequence, "batch_rows": batch_rows, "file_ids": file_ids}
    rows = df.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    crc = F.crc32(F.col("_text").cast("binary"))
    # Two rows with the same key may lie in different files: a key may be very frequent.
    placed = rows.withColumn("_crc", crc).repartitionByRange("_key", "_crc").sortWithinPartitions("_key", "_crc", "_text")
    fields = [("_key", df.schema[key].dataType), ("file", T.StringType())]
    fields += [(n, T.LongType()) for n in ("ordinal", "file_start", "n_tokens")]
    schema = T.StructType([T.StructField(*f) for f in fields])
    run = lambda batches: _write_partition(batches, folder, tokenizer, end_id, options)
    index = materialize(placed.drop("_crc").mapInArrow(run, schema), "id-index")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = index.groupBy(F.col("file").alias("_file")).agg(F.sum("n_tokens").alias("_ids"))
    files = files.select("_file", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    joined = index.join(files, F.col("file") == F.col("_file"))
    return joined.select(
        F.col("_key").alias(key), "file", "ordinal", (F.col("_before") + F.col("file_start")).alias("start"), "n_tokens"
    )


def _read_files(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for names in batches:
        for name in names.column(0).to_pylist():
            file, crc, size, sizes, crcs = IdFile(f"{folder}/{name}"), 0, 0, [], []
            for k in range(file.batches):
                batch = file.batch(k)
                octets, at = memoryview(np.ascontiguousarray(batch["ids"].to_numpy(), "<u4")).cast("B"), 0
                for end in (np.flatnonzero(batch["last"].to_numpy(zero_copy_only=False)) + 1).tolist():
                    sizes.append(size + end - at)
                    crcs.append(zlib.crc32(octets[4 * at : 4 * end], crc))
                    crc, size, at = 0, 0, end
                rest = at + batch["mask"].slice(at).true_count
                crc, size = zlib.crc32(octets[4 * at : 4 * rest], crc), size + rest - at
            columns = [pa.array([name] * len(sizes)), pa.array(range(len(sizes)), pa.int64())]
            columns += [pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "ordinal", "n_tokens", "ids_crc32"])


def read_id_files(index: DataFrame, folder: str) -> DataFrame:
    """(file, ordinal, n_tokens, ids_crc32) of each document, from the files that the index names. Runs a job.

    About one file a task: adaptive execution does not put partitions of a given number together.
    """
    names = index.select("file").distinct()
    files = names.repartition(max(1, names.count()))
    schema = "file string, ordinal bigint, n_tokens bigint, ids_crc32 bigint"
    return files.mapInArrow(lambda batches: _read_files(batches, folder), schema)

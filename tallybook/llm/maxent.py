"""A hashed maximum-entropy language model with a class-factored softmax.

Log-probability of a token = log p(class | history) + log p(token | class).

Classes. The most frequent words (the head) are told apart by which very frequent
words stand near them: k-means over those counts gives topics. A few of the most
frequent words are classes of their own. All other words form the tail; the topic
of a tail word is that of the words with the same last letters (hashed). So the
classes are: single words, head topics, tail topics, the end of a text, and the
unknown word.

p(class | history) is a maximum-entropy softmax over classes. Its features are a
constant, the word before (an n-gram), the word before that (a skip), both
together (hashed) and the classes three and four words back (a skip, hashed).
Weights are trained by gradient steps: every task goes once over its texts in
minibatches, and the tasks' weights are averaged row by row, weighted by how
often a task met the row, as a tree of bounded groups.

p(token | class) is the token's count less a discount, over the class's. What the
discount takes from the tail topics is what the unknown word gets as a target in
training, so the model gives unseen words their share. Probabilities add up to
one over the training tokens and one unknown word, the same events as those of
the add-half unigram model that the score is compared with.

Counts cover all training texts. Head words, weights and topics have fixed bounds;
tail words, of which there is no bound, are joined to their counts by hash.

Defined results: a null or empty text is one token, its end; without training
texts both scores are those of the unigram model without counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.text import codes_of, offsets_of, slices, words_of
from tallybook.operators.scratch import materialize

HEAD_WORDS = 1 << 16
NEAR_WORDS = 64  # very frequent words that tell topics apart
TOPICS = 16
SINGLES = 14
BUCKETS = 1 << 13  # of last letters
LETTERS = 3
CLASSES = SINGLES + 2 * TOPICS + 2
END_CLASS, UNKNOWN = CLASSES - 2, CLASSES - 1
CONTEXT_WORDS = 4000
CONTEXTS = 1 << 12  # words that count as contexts, and a class for each other word
START = CONTEXTS - 1  # the context before a text
PAIR_ROWS = 1 << 13
SKIP_ROWS = 1 << 12
# Rows of weights: constant, word before, word before that, both, classes further back.
_FIRST_ROW = np.cumsum([0, 1, CONTEXTS, CONTEXTS, PAIR_ROWS])
ROWS = int(_FIRST_ROW[-1]) + SKIP_ROWS
_ROW_TYPE = np.min_scalar_type(ROWS)
BATCH = 1 << 14
RATE = 0.15
_FAN = 8  # tasks whose weights are averaged together
END = "\n"  # no word, as words hold no white space


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.right(word, F.lit(LETTERS))), F.lit(BUCKETS)).cast("int")


def _signed(word: str) -> int:
    value = xxhash.xxh64_intdigest(word, 42)
    return value - (1 << 64) if value >> 63 else value


# -- words and counts


def _word_counts(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        flat, _ = words_of(batch.column("text"))
        codes, words = codes_of(flat)
        counts = np.bincount(codes, minlength=len(words))
        words, counts = pa.concat_arrays([words, pa.array([END])]), np.append(counts, batch.num_rows)
        yield pa.RecordBatch.from_arrays([words, pa.array(counts.astype(np.int64))], names=["word", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n, hash) of all texts, the end of a text included."""
    rows = texts.select("text").mapInArrow(_word_counts, "word string, n bigint")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counts.withColumn("hash", F.xxhash64("word")), "word-counts")


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words from some count on, ``most`` of them at least, so that only few are left to be sorted."""
    size = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()  # 512 rows at most
    found = 0
    for row in sorted(sizes, key=lambda r: -r["size"]):
        found += row["words"]
        if found >= most:
            return counts.filter(size >= row["size"])
    return counts


@dataclass
class Vocabulary:
    """The head words, most frequent first, and totals of all words."""

    words: list[str]
    counts: np.ndarray
    tokens: int
    distinct: int
    discount: float
    most: int = HEAD_WORDS
    topic: np.ndarray | None = None  # of each head word
    bucket_topic: np.ndarray | None = None

    @property
    def end_id(self) -> int:
        """Ids: ranks of head words, then buckets of tail words, then the end."""
        return self.most + BUCKETS

    @cached_property
    def rank(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}

    @classmethod
    def of(cls, counts: DataFrame, most: int = HEAD_WORDS) -> Vocabulary:
        ones = F.sum((F.col("n") == 1).cast("bigint"))
        twos = F.sum((F.col("n") == 2).cast("bigint"))
        total, distinct, one, two = counts.agg(F.sum("n"), F.count(F.lit(1)), ones, twos).first()
        head = _frequent(counts.filter(F.col("word") != END), most).orderBy(F.desc("n"), "word").limit(most)
        head = head.select("word", "n").toArrow()
        discount = min(0.9, max(0.1, (one or 0) / max(1, (one or 0) + 2 * (two or 0))))
        return cls(head.column("word").to_pylist(), head.column("n").to_numpy(), total or 0, distinct, discount, most)


@dataclass
class Tokens:
    """The tokens of some texts, each text with its end."""

    ids: np.ndarray  # rank of a head word, bucket of a tail word, or the end (see Vocabulary.end_id)
    words: np.ndarray  # place of each token's word among the distinct words, -1 for the end
    distinct: list[str]
    owner: np.ndarray  # text of each token
    place: np.ndarray  # number of each token in its text
    lengths: np.ndarray


def tokens_of(texts: pa.Array, vocabulary: Vocabulary) -> Tokens:
    flat, counts = words_of(texts)
    codes, words = codes_of(flat)
    distinct = words.to_numpy(zero_copy_only=False).tolist()
    ids = np.fromiter(map(vocabulary.rank.get, distinct, repeat(-1)), np.int64, len(distinct))
    tail = np.flatnonzero(ids < 0)
    letters, endings = codes_of(pc.utf8_slice_codeunits(words.take(pa.array(tail)), -LETTERS))
    buckets = np.fromiter((_signed(e) % BUCKETS for e in endings.to_pylist()), np.int64, len(endings))
    ids[tail] = vocabulary.most + buckets[letters]
    lengths = counts + 1
    ends = offsets_of(lengths)
    is_end = np.zeros(ends[-1], bool)
    is_end[ends[1:] - 1] = True
    every, places = np.full(ends[-1], vocabulary.end_id), np.full(ends[-1], -1)
    every[~is_end], places[~is_end] = ids[codes], codes
    owner = np.repeat(np.arange(len(counts)), lengths)
    return Tokens(every, places, distinct, owner, np.arange(ends[-1]) - ends[:-1][owner], lengths)


# -- topics


def _near_counts(vocabulary: Vocabulary):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens = tokens_of(batch.column("text"), vocabulary)
            keys = []
            for step in (1, 2):
                a, b = tokens.ids[:-step], tokens.ids[step:]
                same = tokens.owner[:-step] == tokens.owner[step:]
                for word, near in ((a, b), (b, a)):
                    rows = same & (near < NEAR_WORDS) & (word != vocabulary.end_id)
                    keys.append(word[rows] * NEAR_WORDS + near[rows])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    return run


def _clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means centres of unit vectors by cosine; starts with the heaviest unlike ones."""
    order = np.argsort(-weight, kind="stable")[: 50 * k]
    chosen = [order[0]]
    for _ in range(k - 1):
        likeness = (x[order] @ x[chosen].T).max(axis=1)
        chosen.append(order[np.argmin(likeness)])
    centres = x[chosen].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(nearest, x[:, d] * weight, k) for d in range(x.shape[1])], axis=1)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def find_topics(texts: DataFrame, vocabulary: Vocabulary) -> None:
    """Gives each head word and each bucket of last letters a topic."""
    rows = texts.select("text").mapInArrow(_near_counts(vocabulary), "key bigint, n bigint")
    found = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    near = np.zeros(vocabulary.end_id * NEAR_WORDS, np.float32)
    near[found.column("key").to_numpy()] = found.column("n").to_numpy()
    near = np.sqrt(near.reshape(-1, NEAR_WORDS))
    seen = np.square(near).sum(axis=1)
    unit = near / np.maximum(np.sqrt(seen), 1e-12)[:, None]
    centres = _clusters(unit, np.log1p(seen), TOPICS)
    topic = (unit @ centres.T).argmax(axis=1)
    vocabulary.topic, vocabulary.bucket_topic = topic[: len(vocabulary.words)], topic[vocabulary.most :]


# -- the model


@dataclass
class Model:
    vocabulary: Vocabulary
    in_class: np.ndarray  # log10 p(token | class) of each head word
    tail_mass: np.ndarray  # discounted count of each tail topic
    unseen: np.ndarray  # share of each tail topic that the discount takes
    weights: np.ndarray

    @cached_property
    def id_class(self) -> np.ndarray:
        v = self.vocabulary
        classes = np.full(v.end_id + 1, END_CLASS)
        classes[: len(v.words)] = SINGLES + v.topic
        classes[: min(SINGLES, len(v.words))] = np.arange(min(SINGLES, len(v.words)))
        classes[v.most : v.end_id] = SINGLES + TOPICS + v.bucket_topic
        return classes

    def rows_and_classes(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(row of each feature of each token, class of each token)."""
        classes = self.id_class[tokens.ids]
        context = np.where(tokens.ids < CONTEXT_WORDS, tokens.ids, CONTEXT_WORDS + classes)

        def back(values: np.ndarray, step: int, before: int) -> np.ndarray:
            moved = np.full(len(values), before)
            moved[step:] = values[:-step] if step < len(values) else moved[step:]
            return np.where(tokens.place >= step, moved, before)

        one, two = back(context, 1, START), back(context, 2, START)
        three, four = back(classes, 3, CLASSES), back(classes, 4, CLASSES)
        mixed = (one * 0x9E3779B1 + two * 0x85EBCA77 + 0x165667B1) & 0xFFFFFFFFFFFF
        pair = (mixed ^ mixed >> 17) % PAIR_ROWS
        skip = (three * (CLASSES + 1) + four) % SKIP_ROWS
        rows = [np.zeros(len(one), np.int64), one, two, pair, skip]
        return np.stack(rows, axis=1) + _FIRST_ROW, classes

    def logits(self, rows: np.ndarray) -> np.ndarray:
        total = self.weights.take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            total += self.weights.take(rows[:, k], axis=0)
        return total

    def base(self, count: np.ndarray) -> np.ndarray:
        v = self.vocabulary
        return np.log10((count + 0.5) / (v.tokens + 0.5 * (v.distinct + 1)))


def _tail(counts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(discounted count, share that the discount takes) of each tail topic."""
    least = int(vocabulary.counts[-1]) if len(vocabulary.words) == vocabulary.most else 0
    last = vocabulary.words[-1] if vocabulary.words else ""
    below = (F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last)) if least else F.lit(False)
    tail = counts.filter(below & (F.col("word") != END)).groupBy(bucket_of(F.col("word")).alias("bucket"))
    found = tail.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toArrow()
    topic = vocabulary.bucket_topic[found.column("bucket").to_numpy()]
    n = np.bincount(topic, found.column("n").to_numpy(), TOPICS)
    taken = vocabulary.discount * np.bincount(topic, found.column("words").to_numpy(), TOPICS)
    return np.maximum(n - taken, 1e-9), taken / np.maximum(n, 1)


def _starting_model(counts: DataFrame, vocabulary: Vocabulary) -> Model:
    tail_mass, unseen = _tail(counts, vocabulary)
    model = Model(vocabulary, np.zeros(0), tail_mass, unseen, np.zeros((ROWS, CLASSES), np.float32))
    classes = model.id_class[: len(vocabulary.words)]
    kept = vocabulary.counts - vocabulary.discount
    model.in_class = np.log10(kept / np.bincount(classes, kept, CLASSES)[classes])
    prior = np.bincount(classes, vocabulary.counts, CLASSES)
    prior[SINGLES + TOPICS : END_CLASS] = tail_mass
    prior[UNKNOWN] = (tail_mass / np.maximum(1 - unseen, 1e-9) * unseen).sum()
    prior[END_CLASS] = max(1, vocabulary.tokens - vocabulary.counts.sum() - tail_mass.sum() - prior[UNKNOWN])
    model.weights[0] = np.log((prior + 0.5) / (prior.sum() + 0.5 * CLASSES))
    return model


def _step(model: Model, rows: np.ndarray, classes: np.ndarray, squares: np.ndarray) -> None:
    """One gradient step (with a learning rate per weight) on a minibatch."""
    error = model.logits(rows)
    error -= error.max(axis=1, keepdims=True)
    np.exp(error, out=error)
    error /= -error.sum(axis=1, keepdims=True)
    every = np.arange(len(rows))
    topic = classes - SINGLES - TOPICS
    taken = np.where((topic >= 0) & (topic < TOPICS), model.unseen[np.clip(topic, 0, TOPICS - 1)], 0).astype(np.float32)
    error[every, classes] += 1 - taken
    error[:, UNKNOWN] += taken
    for k in range(1, rows.shape[1]):
        order = np.argsort(rows[:, k].astype(_ROW_TYPE), kind="stable")  # small types are sorted by their digits
        sorted_rows = rows[order, k]
        starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        met = sorted_rows[starts]
        # Two classes as one complex number: half as many additions.
        slope = np.add.reduceat(error.take(order, axis=0).view(np.complex64), starts, axis=0).view(np.float32)
        _move(model.weights, squares, met, slope, RATE)
    _move(model.weights, squares, np.zeros(1, np.int64), error.sum(axis=0, keepdims=True), RATE / 10)


def _move(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, slope: np.ndarray, rate: float) -> None:
    """Adds the slopes of the met rows, each weight at its own rate."""
    sums = squares.take(met, axis=0)
    sums += slope * slope
    squares[met] = sums
    slope /= np.sqrt(sums, out=sums)
    slope *= rate
    weights[met] += slope


def _trainer(shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        start = shared.value
        model = Model(start.vocabulary, start.in_class, start.tail_mass, start.unseen, start.weights.copy())
        squares = np.full_like(model.weights, 1.0)
        met = np.zeros(ROWS, np.int64)
        for batch in slices(batches, "text"):
            rows, classes = model.rows_and_classes(tokens_of(batch.column("text"), model.vocabulary))
            met += np.bincount(rows.ravel(), minlength=ROWS)
            for at in range(0, len(rows), BATCH):
                _step(model, rows[at : at + BATCH], classes[at : at + BATCH], squares)
        if met.any():
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            weighted = (model.weights.astype(np.float64) * met[:, None]).astype(np.float32)
            data = [pa.array([x.tobytes()], pa.binary()) for x in (weighted, met)]
            yield pa.RecordBatch.from_arrays([part, *data], names=["part", "weights", "met"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    weights = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows["weights"])
    met = sum(np.frombuffer(x, np.int64) for x in rows["met"])
    part = int(rows["part"].iloc[0])
    return pd.DataFrame({"part": [part], "weights": [weights.astype(np.float32).tobytes()], "met": [met.tobytes()]})


def _averaged(models: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(average weights, how often each row was met), in a tree of groups of _FAN."""
    schema = "part bigint, weights binary, met binary"
    while (last := models.agg(F.max("part")).first()[0]) is not None and models.count() > 1:
        up = models.withColumn("part", F.floor(F.col("part") / _FAN))
        models = materialize(up.groupBy("part").applyInPandas(_summed, schema), "weights")
        if last < 1:
            break
    found = models.first()
    if found is None:
        return None
    met = np.frombuffer(found["met"], np.int64)
    return np.frombuffer(found["weights"], np.float32).reshape(ROWS, CLASSES) / np.maximum(met, 1)[:, None], met


def train(texts: DataFrame, counts: DataFrame, head_words: int = HEAD_WORDS) -> Model | None:
    """A model of all texts, from their word counts; None without texts. Runs jobs."""
    vocabulary = Vocabulary.of(counts, head_words)
    if not vocabulary.tokens:
        return None
    find_topics(texts, vocabulary)
    model = _starting_model(counts, vocabulary)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    trained = texts.select("text").mapInArrow(_trainer(shared), "part bigint, weights binary, met binary")
    average = _averaged(materialize(trained, "weights"))
    if average is not None:
        weights, met = average
        model.weights = np.where((met > 0)[:, None], weights, model.weights).astype(np.float32)
    return model


# -- scores


def _log10_softmax(model: Model, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of (each token's class, the unknown word)."""
    own, unknown = np.empty(len(rows)), np.empty(len(rows))
    for at in range(0, len(rows), BATCH):
        part = slice(at, at + BATCH)
        logits = model.logits(rows[part])
        top = logits.max(axis=1)
        logits -= top[:, None]
        chosen, unseen = logits[np.arange(len(logits)), classes[part]], logits[:, UNKNOWN].copy()
        norm = np.log(np.exp(logits, out=logits).sum(axis=1))
        own[part], unknown[part] = chosen - norm, unseen - norm
    return own / math.log(10), unknown / math.log(10)


_TAIL = pa.list_(
    pa.struct([("hash", pa.int64()), ("times", pa.int64()), ("topic", pa.int32()), ("known", pa.float64()), ("unknown", pa.float64())])
)


def _scorer(shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v = model.vocabulary
        head_base = model.base(v.counts)
        for batch in slices(batches, "text"):
            tokens = tokens_of(batch.column("text"), v)
            rows, classes = model.rows_and_classes(tokens)
            own, unknown = _log10_softmax(model, rows, classes)
            is_head, is_end = tokens.ids < v.most, tokens.ids == v.end_id
            score, base = np.where(is_head | is_end, own, 0), np.zeros(len(own))
            score[is_head] += model.in_class[tokens.ids[is_head]]
            base[is_head] = head_base[tokens.ids[is_head]]
            n = len(tokens.lengths)
            sums = [np.bincount(tokens.owner, x, n) for x in (base, score)]
            heads = np.bincount(tokens.owner[is_head], minlength=n)
            # The tail words of each text, each once.
            tail = np.flatnonzero(~is_head & ~is_end)
            key, group = np.unique(tokens.owner[tail] * max(1, len(tokens.distinct)) + tokens.words[tail], return_inverse=True)
            word = key % max(1, len(tokens.distinct))
            asked, asked_at = np.unique(word, return_inverse=True)
            hashes = np.fromiter((_signed(tokens.distinct[w]) for w in asked.tolist()), np.int64, len(asked))[asked_at]
            topic = np.zeros(len(key), np.int64)
            topic[group] = classes[tail] - SINGLES - TOPICS
            values = [hashes, np.bincount(group, minlength=len(key)), topic.astype(np.int32)]
            values += [np.bincount(group, x[tail], len(key)).astype(np.float64) for x in (own, unknown)]
            structs = pa.StructArray.from_arrays([pa.array(x) for x in values], fields=list(_TAIL.value_type))
            ends = np.searchsorted(key, np.arange(n + 1) * max(1, len(tokens.distinct))).astype(np.int32)
            columns = [batch.column("_row"), batch.column("doc_id"), pa.array(tokens.lengths), pa.array(heads)]
            columns += [*(pa.array(x) for x in sums), pa.ListArray.from_arrays(pa.array(ends), structs)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "n_tokens", "heads", "base", "score", "tail"])

    return run


def score(docs: DataFrame, model: Model | None, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each document. Runs jobs."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or _untrained())
    v = (model or _untrained()).vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "array<struct<hash: bigint, times: bigint, topic: int, known: double, unknown: double>>"
    schema = f"_row bigint, doc_id {kind}, n_tokens bigint, heads bigint, base double, score double, tail {tail}"
    scored = materialize(rows.mapInArrow(_scorer(shared), schema), "scores")
    below = v.tokens + 0.5 * (v.distinct + 1)
    ends = counts.filter(F.col("word") == END).select("n").first()
    end_count = ends["n"] if ends else 0
    mass = F.array(*(F.lit(float(x)) for x in shared.value.tail_mass))
    each = scored.select("_row", F.inline("tail"))
    seen = counts.select(F.col("hash").alias("_hash"), "n")
    joined = each.join(seen, F.col("hash") == F.col("_hash"), "left")
    inside = F.log10((F.col("n") - v.discount) / F.element_at(mass, F.col("topic") + 1))
    sums = joined.groupBy(F.col("_row").alias("_of")).agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / below)).alias("tail_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("known") + F.col("times") * inside).otherwise(F.col("unknown"))).alias("tail_score"),
    )
    sums = materialize(sums, "tail-scores")
    total = scored.drop("tail").join(sums, F.col("_row") == F.col("_of"), "left")
    zero = F.lit(0.0)
    end_base = math.log10((end_count + 0.5) / below)
    base = F.col("base") + end_base + F.coalesce("tail_base", zero)
    model_score = F.col("score") + F.coalesce("tail_score", zero)
    return total.select(
        "doc_id",
        "n_tokens",
        (F.col("heads") + (1 if end_count else 0) + F.coalesce("known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (base if model is None else model_score).alias("score"),
    )


def _untrained() -> Model:
    nothing = np.zeros(0, np.int64)
    vocabulary = Vocabulary([], nothing, 0, 0, 0.5, topic=nothing, bucket_topic=np.zeros(BUCKETS, np.int64))
    weights = np.zeros((ROWS, CLASSES), np.float32)
    return Model(vocabulary, np.zeros(0), np.ones(TOPICS), np.zeros(TOPICS), weights)

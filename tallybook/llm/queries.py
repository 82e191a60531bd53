"""One query for each operator, over its whole table, and the SQL where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, decontam, editcounts, idfiles, language, maxent, negatives, quality, runs, shards, simhash
from tallybook.llm import toxicity, vectors
from tallybook.llm.tagging import held_out
from tallybook.operators.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, folder, "documents", "doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, drop=["text"]), ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.ToxicityModel:
    """Learned from the labelled documents of four folds of five."""
    docs = _table(spark, folder, "documents", "doc_id", "text")
    labels = _table(spark, folder, "labels", "doc_id", "toxic").filter(~held_out("doc_id", 5, 0))
    return toxicity.learn(docs, labels)


def op2_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity_model(spark, folder), drop=["text"])
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )


def language_model(spark: SparkSession, folder: str):
    """Learned from the documents of three folds of four."""
    return language.learn(_table(spark, folder, "documents", "doc_id", "text", "lang").filter(~held_out("doc_id", 4, 2)))


def op3_language_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    found = language.with_language(docs, language_model(spark, folder), drop=["text"])
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op4_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    items = _table(spark, folder, "benchmark", "item_id", "text")
    found = decontam.with_leaks(docs, items, drop=["text"])
    return found.select("doc_id", F.inline("leaks"))


def op5_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    printed = simhash.with_fingerprint(_table(spark, folder, "documents", "doc_id", "text"), drop=["text"])
    grouped = simhash.near_duplicates(materialize(printed, "fingerprints"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_hyperplane_groups(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicate_vectors(_table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


def op7_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shards.shuffled_shards(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 8, seed=7)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document: a few characters at a place go, a piece of its own text comes."""
    size = F.char_length("text")

    def drawn(seed: int, below) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.coalesce(below, F.lit(0)) + 1)

    def edit(k: int) -> Column:
        piece = F.substring(F.col("text"), drawn(3 * k, size).cast("int") + 1, F.lit(24))
        fields = (drawn(3 * k + 1, size), drawn(3 * k + 2, F.lit(11)), piece)
        return F.struct(*(f.alias(n) for f, n in zip(fields, ("position", "deleted", "inserted"), strict=True)))

    return docs.withColumn("edits", F.array(*(edit(k) for k in range(3))))


def op8_edited_counts(spark: SparkSession, folder: str) -> DataFrame:
    coder = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = editcounts.with_tree(_with_edits(_table(spark, folder, "documents", "doc_id", "text")), *coder)
    tokens = F.col("tree.tokens")[1].cast("bigint")
    edited = editcounts.with_edits(docs.withColumn("tokens_before", tokens), *coder, drop=["edits"])
    return edited.select(
        "doc_id",
        "tokens_before",
        tokens.alias("n_tokens"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        "encoded_chars",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


def op9_maxent_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    training = docs.filter(~held_out("doc_id", 5, 1))
    counts = maxent.count_words(training)
    scored = maxent.score(docs, maxent.train(training, counts), counts)
    return scored.withColumn("held_out", held_out("doc_id", 5, 1))


def op10_arrow_id_files(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "id-files")
    docs = _table(spark, folder, "documents", "doc_id", "text")
    index = idfiles.write_id_files(docs, target, public_tokenizers.path("word_bpe_49k.json"))
    index = index.select("doc_id", F.col("file").alias("_file"), F.col("ordinal").alias("_ordinal"), "start")
    stored = idfiles.read_id_files(index.withColumnRenamed("_file", "file"), target)
    here = (F.col("file") == F.col("_file")) & (F.col("ordinal") == F.col("_ordinal"))
    # Spark takes what is read for as small as the file names, and would broadcast it.
    return index.join(stored.hint("merge"), here).select("doc_id", "start", "n_tokens", "ids_crc32")


def _with_planted_tails(docs: DataFrame) -> DataFrame:
    """In about one document of ten, all words from a place on repeat the first few words from there.

    Id and text decide which, from where and how many; documents without an id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # White space between words.
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    chosen = docs.withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when(h % 10 == 0, words))
    size, g = F.size("_words"), F.col("_g")
    chosen = chosen.withColumn("_n", F.when(size > 0, size)).withColumn("_a", (g % F.col("_n")).cast("int"))
    rest = F.col("_n") - F.col("_a")
    chosen = chosen.withColumn("_p", (F.floor(rest / (g % 8 + 3)) + 1).cast("int"))
    unit = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return chosen.select("doc_id", F.when(F.col("_n").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _with_planted_tails(_table(spark, folder, "documents", "doc_id", "text"))
    found = runs.with_runs(docs, drop=["text"])
    # Lists come by start, then period, so the first of equals is the one wanted.
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), text.alias("listed"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def quality_model(spark: SparkSession, folder: str) -> quality.QualityModel:
    """Learned from the labelled documents of two folds of three."""
    docs = _table(spark, folder, "documents", "doc_id", "text")
    labels = _table(spark, folder, "labels", "doc_id", "quality").filter(~held_out("doc_id", 3, 1))
    return quality.learn(docs, labels)


def op12_nbsvm_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    scored = quality.with_quality(docs, quality_model(spark, folder), drop=["text"])
    return scored.select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op13_slot_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.filter(F.coalesce(finite, F.lit(False))).select(
        "vec_id", moved.alias("label"), F.transform(x, lambda v: F.floor(v * 256)).alias("vector")
    )
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_toxic_spans": op2_toxic_spans,
        "op3_language_words": op3_language_words,
        "op4_benchmark_leaks": op4_benchmark_leaks,
        "op5_simhash_groups": op5_simhash_groups,
        "op6_hyperplane_groups": op6_hyperplane_groups,
        "op7_feistel_shards": op7_feistel_shards,
        "op8_edited_counts": op8_edited_counts,
        "op9_maxent_scores": op9_maxent_scores,
        "op10_arrow_id_files": op10_arrow_id_files,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_nbsvm_quality": op12_nbsvm_quality,
        "op13_slot_negatives": op13_slot_negatives,
    }


_SLOT_NEGATIVES = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) FOR x IN embedding] AS vector
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.vector, r.vector)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id <> r.vec_id
    WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT * FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS place,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_slot_negatives": _SLOT_NEGATIVES}

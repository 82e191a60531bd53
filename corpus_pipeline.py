"""The corpus pipeline: documents through stages, each written as Parquet and read again.

Every stage takes (spark, documents, folder of the tables) and returns a frame;
all but the last return the columns of ``documents``, whatever else the table
has. Rows that a stage rejects are gone for the stages after it. A stage keeps
rows with a null id and repeated rows like any others; of a group of near
duplicates the row with the smallest id stays (one of the rows without an id if
none has one). Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, decontam, language, simhash, toxicity
from tallybook.llm.frames import spare_name
from tallybook.llm.queries import language_model, toxicity_model
from tallybook.operators.scratch import materialize

TOXIC = 0.5  # scores from here on are rejected
LANGUAGE_SHARE = 0.3  # texts of which less than this is in any one language are rejected

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    score, spans = spare_name(docs, "_score"), spare_name(docs, "_spans")
    scored = toxicity.with_toxicity(docs, toxicity_model(spark, sf_dir), score=score, spans=spans)
    return scored.filter(F.col(score) < TOXIC).select(docs.columns)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are not an even mixture of all languages."""
    name, score = spare_name(docs, "_lang"), spare_name(docs, "_share")
    found = language.with_language(docs, language_model(spark, sf_dir), language=name, score=score)
    kept = (F.col(name) != language.UNDETERMINED) & (F.col(score) >= LANGUAGE_SHARE)
    return found.filter(kept).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    row, rank, mark = (spare_name(docs, n) for n in ("_row", "_rank", "_fingerprint"))
    printed = simhash.with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), out=mark)
    printed = materialize(printed, "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(row).alias("c"))
    group = spare_name(docs, "_group")
    grouped = simhash.near_duplicates(printed.select(row, mark, order.alias(rank)), rank, mark, out=group)
    first = grouped.filter(F.col(f"{group}.c") == F.col(row)).select(row)
    return printed.join(first, row, "left_semi").select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    leaks = spare_name(docs, "_leaks")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.with_leaks(docs, items, out=leaks).filter(F.size(leaks) == 0).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the token ids, and whether they decode to the text's bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    decoded = bpe.decode(bpe.encode(texts, ranks, public_tokenizers.PATTERN), ranks)
    same = F.col("decoded") == F.col("text").cast("binary")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_documents),
    ("language", known_languages),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("encoding", encoded),
]

# SQL cannot express the learned stages; tests/llm/test_pipeline.py holds each stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

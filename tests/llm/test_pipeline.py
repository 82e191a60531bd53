"""Each stage of the pipeline on what it is given, against brute force."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import language
from tallybook.llm.bpe import encoder
from tallybook.llm.queries import language_model, oracle_sql, queries, toxicity_model
from tests.llm.test_decontam import shingles, words
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_groups import brute_print, roots

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with copies, edge cases and a column with a clashing name."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    schema = table.schema.simpleString()[len("struct<") : -1]
    rows = [tuple(r) for r in table.collect()]
    text = {r[0]: r[1] for r in rows}
    extra = [(None, text[rows[0][0]]), (rows[1][0], text[rows[1][0]]), (900, None), (901, ""), (902, "12 34"), (None, None)]
    rows += [(k, t, "en", "src0", 0)[: len(rows[0])] for k, t in extra]
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "doc_id AS _score", "'x' AS ids", "source AS _row")
    return frame.coalesce(2)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def stage(spark, docs, name):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)


def test_stages_keep_the_columns_of_documents(spark, docs):
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = f(spark, docs, SMALL)
        assert kept.columns == docs.columns
        assert set(rows_of(kept)) <= set(rows_of(docs))
        assert f(spark, docs.limit(0), SMALL).collect() == []


def test_toxic_documents_go(spark, docs):
    model = toxicity_model(spark, SMALL)
    scores = model.score(pa.array([r["text"] for r in docs.collect()], pa.string()))[0]
    expected = sorted((tuple(r) for r, s in zip(docs.collect(), scores, strict=True) if s < 0.5), key=repr)
    assert rows_of(stage(spark, docs, "toxicity")) == expected


def test_documents_without_a_known_language_go(spark, docs):
    share = language.shares(language_model(spark, SMALL), pa.array([r["text"] for r in docs.collect()], pa.string()))
    kept = share.max(axis=1) >= corpus_pipeline.LANGUAGE_SHARE
    expected = sorted((tuple(r) for r, k in zip(docs.collect(), kept, strict=True) if k), key=repr)
    assert rows_of(stage(spark, docs, "language")) == expected
    assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in stage(spark, docs, "language").collect())


def test_one_of_each_group_stays(spark, docs):
    rows = docs.collect()
    prints = np.array([brute_print(r["text"]) for r in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    group = roots(len(rows), zip(*np.nonzero(near), strict=True))
    kept = stage(spark, docs, "near_duplicates").collect()
    assert len(kept) == len(set(group))
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(least.values())


def test_documents_with_benchmark_passages_go(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    planted = docs.limit(1).withColumn("text", F.lit(f"before {items[3][1]} after"))
    given = docs.union(planted).coalesce(1)
    rows = given.collect()
    known = {s for _, t in items for s in shingles(words(t))}
    suspects = [i for i, r in enumerate(rows) if r["text"] and known & set(shingles(words(r["text"])))]
    found = {suspects[i] for i, _ in leaks([(None, rows[i]["text"]) for i in suspects], items)}
    expected = sorted((tuple(r) for i, r in enumerate(rows) if i not in found), key=repr)
    assert rows_of(stage(spark, given, "decontamination")) == expected
    assert any(rows[i]["text"].startswith("before ") for i in found)


def test_the_last_stage_encodes_whole_texts(spark, docs):
    coder = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = stage(spark, docs, "encoding").collect()
    expected = sorted(((r["doc_id"], coder.encode_ordinary(r["text"] or "")) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in found), key=repr) == expected
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)


def test_the_whole_pipeline_is_its_stages(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        given = f(spark, given, SMALL)
    assert rows_of(corpus_pipeline.run(spark, SMALL)) == rows_of(given)


def test_every_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in queries()]
    assert sorted(numbers) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())

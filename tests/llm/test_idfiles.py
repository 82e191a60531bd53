from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm.idfiles import IdFile, IdFileWriter, WordCoder, read_id_files, write_id_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aBÉéİǰ̌́'st.,!?9²|  \t\n×日")), max_size=60) | st.text(max_size=30), max_size=5))
def test_words_give_the_ids_of_the_whole_text(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids, counts = WordCoder(PATH).encode(pa.array(texts, pa.string()))
    expected = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_words_asked_for_together_give_the_same_ids(monkeypatch):
    from tallybook.llm import idfiles

    monkeypatch.setattr(idfiles, "_JOINED", 7)
    monkeypatch.setattr(idfiles, "_CACHED_WORDS", 50)  # forgets between the calls
    words = ["plain", "ÀÉÎõ", "İstanbul", "e\u0301a", "x1", "<|endoftext|>", "</w>", "...", "?!", "don't", "日本", "a" * 100]
    texts = [" ".join(words[i % 12] + "z" * (i % 9) * (i % 2) for i in range(k, k + 40)) for k in range(30)]
    t, coder = Tokenizer.from_file(PATH), WordCoder(PATH)
    for part in (texts[:10], texts[10:], texts):
        ids, counts = coder.encode(pa.array(part))
        expected = [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_hadoop_schemes_are_opened_as_arrow_names_them():
    from tallybook.llm.idfiles import arrow_uri

    assert arrow_uri("s3a://bucket/ids") == "s3://bucket/ids"
    assert [arrow_uri(p) for p in ("file:/x", "/s3a://x", "hdfs://n/x")] == ["file:/x", "/s3a://x", "hdfs://n/x"]


def test_every_sequence_is_at_a_computed_place(tmp_path):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 60_000, 1000).astype(np.uint32)
    last = np.zeros(1000, bool)
    writer = IdFileWriter(str(tmp_path / "x" / "a.arrow"), pa.uint16(), sequence=16, batch_rows=4)
    for a in range(0, 1000, 37):
        writer.add(ids[a : a + 37], last[a : a + 37])
    writer.close()
    file = IdFile(str(tmp_path / "x" / "a.arrow"))
    assert len(file) == 64  # 16 batches of 4
    for i in (0, 1, 17, 61, 62, 63):
        got, real = file[i]
        wanted = ids[i * 16 : i * 16 + 16]
        assert got[: len(wanted)].tolist() == wanted.tolist()
        assert real.to_pylist() == [True] * len(wanted) + [False] * (16 - len(wanted))
        assert not got.flags.owndata  # a view of the memory map
    with pytest.raises(IndexError):
        file[64]
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["a.arrow"]


def test_files_of_nulls_ties_and_long_texts(spark, tokenizer, tmp_path):
    rows = [(5, None), (2, "a b c"), (2, "a b c"), (2, "other"), (None, "first, by key"), (9, "long text. " * 9000), (7, "")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, file string")
    folder = f"file://{tmp_path}/ids"
    index = write_id_files(df.repartition(3), folder, PATH, sequence=64, batch_rows=2, file_ids=6)
    index = index.cache()
    stored = {(r["file"], r["ordinal"]): (r["n_tokens"], r["ids_crc32"]) for r in read_id_files(index, folder).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] or ""))
    start, expected = 0, []
    for key, text in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], *stored[(r["file"], r["ordinal"])]) for r in index.orderBy("start").collect()]
    assert got == expected
    assert len({r["file"] for r in index.collect()}) > 1


def test_files_are_read_back_in_many_tasks(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS doc_id", "'some words' AS text")
    index = write_id_files(df, str(tmp_path / "ids"), PATH, sequence=8, batch_rows=1, file_ids=6).cache()
    files = index.select("file").distinct().count()
    read = read_id_files(index, str(tmp_path / "ids")).select("file", F.spark_partition_id().alias("task")).distinct()
    tasks = [r["n"] for r in read.groupBy("task").agg(F.count("file").alias("n")).collect()]
    assert files >= 8 and sum(tasks) == files
    assert max(tasks) <= 3


def test_special_strings_in_a_text_have_the_ids_of_the_plain_library():
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "Word.<|endoftext|>,next", "<|startoftext|><|endoftext|>", "<|endoftext", "x<|ENDOFTEXT|>!"]
    texts += ["É<|startoftext|>\u0301 ok\t<|endoftext|>.", "it's<|endoftext|>'s"]
    ids, counts = WordCoder(PATH).encode(pa.array(texts))
    expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert 49407 in expected[0]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_an_empty_table_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    index = write_id_files(df, str(tmp_path / "none"), PATH)
    assert index.collect() == []
    assert read_id_files(index, str(tmp_path / "none")).collect() == []

from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm.bpe import decode, encode, encode_text, encoder, long_spaces, safe_pieces

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("ab '\tstre.,!1 \n é日‍")), max_size=200) | st.text(max_size=60), st.sampled_from([1, 3, 20]))
def test_pieces_give_the_ids_of_the_whole_text(text, size):
    coder = encoder(RANKS, PATTERN)
    assert "".join(safe_pieces(text, size)) == text
    assert encode_text(text, coder, size).tolist() == coder.encode_ordinary(text)


def test_a_text_without_boundaries_is_one_piece():
    assert list(safe_pieces("x" * 5000, 10)) == ["x" * 5000]


def test_round_trip_of_nulls_repeats_and_clashing_columns(spark):
    texts = [None, "", "Hé, world  \n\n don't", "日本語 <|endoftext|> 🙂", "a" * 3000, "b c " * 60_000]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(2, texts[2], "again"), (None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = decode(encode(df, RANKS, PATTERN), RANKS).collect()
    coder = encoder(RANKS, PATTERN)
    assert len(found) == len(rows)
    for r in found:
        assert r["ids"] == coder.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert decode(encode(df.limit(0), RANKS, PATTERN), RANKS).collect() == []


def test_ids_that_the_ranks_lack_give_no_bytes(spark):
    rows = [([1, None, 10**6, -5, 2],), (None,), ([],)]
    found = decode(spark.createDataFrame(rows, "ids array<int>"), RANKS).collect()
    coder = encoder(RANKS, PATTERN)
    assert [bytes(r["decoded"]) for r in found] == [coder.decode_bytes([1, 2]), b"", b""]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("a1' \t\n\r\x0b\x85\u2003\x1c.é")), max_size=80), st.sampled_from([1, 2, 4]))
def test_white_space_cut_by_hand_gives_the_ids_of_the_whole_text(text, least):
    coder = encoder(RANKS, PATTERN)
    assert "".join(part for part, _ in long_spaces(text, least)) == text
    assert encode_text(text, coder, 5, least).tolist() == coder.encode_ordinary(text)


def test_millions_of_white_space_characters(spark):
    coder = encoder(RANKS, PATTERN)
    runs = [" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 700_000, "\u2003 " * 600_000]
    texts = [*runs, *(f"word{r}word 1{r}\n" for r in runs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    for r in decode(encode(df, RANKS, PATTERN), RANKS).collect():
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    for piece in (" ", "\n", " \n\t", "\u2003 "):
        short = f"word{piece * 60_000}word"  # what the library can do by itself
        assert encode_text(short, coder).tolist() == coder.encode_ordinary(short)

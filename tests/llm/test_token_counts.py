"""Token counts against the libraries themselves, one text at a time."""

import random
import re

import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import queries, token_counts

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
PARTS = ["a", "word", " ", "  ", "\n", "\t", "'s", "'", "'ll", "7", "½", "_", "x1", "日本", "é", "é", "<|endoftext|>", "<s>", " ", "\u0085", "\x1c", "▁", "!", "😀", "\r\n"]


def plain(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(sp.encode(t))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", NAMES)
def test_pieces_and_lots(name):
    """However a text is cut and lots are made, the count is that of the whole text."""
    one, c = plain(name), token_counts.TokenCounter(public_tokenizers.path(name))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=6), st.integers(1, 12), st.integers(1, 64))
    def check(texts, chars, lot):
        assert list(c.count(pa.array(texts, pa.string()), chars, lot)) == [one(t) for t in texts]

    check()


def test_long_texts_are_cut():
    c = token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "some words, over and over\n" * 5000
    assert max(map(len, c.pieces(text))) < token_counts.PIECE_CHARS + 100 and "".join(c.pieces(text)) == text
    assert c.pieces("x" * 100_000) == ["x" * 100_000]
    assert token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json")).pieces(text) == [text]
    p = token_counts.TokenCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert " ".join(p.pieces(text)) == text and len(p.pieces(text)) > 5


@pytest.mark.parametrize("name", NAMES)
def test_column(spark, name):
    r = random.Random(3)
    texts = [None, "", " ", "x" * 40_000, "<|endoftext|> a", "<|endoftext|>" * 3, *["".join(r.choices(PARTS, k=r.choice([3, 300, 9000]))) for _ in range(40)], "twice", "twice"]
    one = plain(name)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {x["doc_id"]: x["n"] for x in df.select("doc_id", token_counts.counted(F.col("text"), public_tokenizers.path(name)).alias("n")).collect()}
    assert got == {i: one(t or "") for i, t in enumerate(texts)}
    assert df.limit(0).select(token_counts.counted(F.col("text"), public_tokenizers.path(name))).count() == 0


def test_other_files():
    with pytest.raises(ValueError):
        token_counts.counted(F.lit("x"), "vocabulary.txt")


def test_registered(spark, tmp_path):
    one = plain("byte_bpe_50k.json")
    rows = [(1, None), (2, ""), (3, "größe " * 600), (3, "größe"), (None, "no id"), (4, "word " * 512), (5, "word " * 513)]
    spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)
    assert got == sorted(((k, len((t or "").encode()), one(t or ""), one(t or "") > 512) for k, t in rows), key=repr)
    assert any(re.match("True", str(x[3])) for x in got)

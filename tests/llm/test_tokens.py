"""Byte-level BPE and token counts against the public libraries."""

import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkproof.llm import bpe, token_count
from inkproof.llm.queries import op3_bpe, op8_token_count

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
ODD = [None, "", " ", "\x00", "a" * 5000, "é" * 3000, "\n\n x", "🙂‍🙂", "'s''S", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "　\x85\x1c"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def _random_texts(n):
    rng = random.Random(5)
    letters = [*map(chr, range(0x250)), *"   \n\t''sltrevedm", " ", "　", "一", "🙂", "́", "٠"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]


def test_model_holds_the_vocabulary():
    codec = bpe.codec(RANKS, PATTERN)
    assert codec.model.get_piece_size() == len(codec.ranks) + 1
    assert codec.model.get_score(7) == -codec.order[7]
    assert codec.model.id_to_piece(300) == bpe.letters(codec.token[codec.order[300]])


def test_encodes_as_the_library(library):
    codec = bpe.codec(RANKS, PATTERN)
    for text in [*_random_texts(2000), *filter(None, ODD), "ab1é" * 2000]:
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_columns(spark, library):
    frame = spark.createDataFrame([(n, t, "x") for n, t in enumerate(ODD)], "doc_id long, text string, ids string")
    done = frame.select("doc_id", "text", bpe.encode_ids(F.col("text"), RANKS, PATTERN).alias("coded"))
    done = done.withColumn("back", bpe.decode_ids(F.col("coded"), RANKS, PATTERN))
    for row in done.collect():
        assert bytes(row.back).decode() == (row.text or "")
        assert len(row.coded) // 4 == len(library.encode_ordinary(row.text or ""))


def test_unknown_id_is_an_error():
    with pytest.raises(KeyError):
        bpe.codec(RANKS, PATTERN).decode(struct.pack("<I", 60000))


def test_query_bpe(spark, library):
    import hashlib

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op3_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_counts_as_the_library(spark):
    tokenizer, counter = Tokenizer.from_file(JSON), token_count.PieceCounter(JSON, PATTERN)
    texts = [*_random_texts(2000), *ODD, *ODD, "x <|endoftext|> <|endoftext|", "<|endoftext|>", "y" * 200_000, "ab " * 100_000]
    want = [len(e) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for text, many in zip(texts, want):
        found, special = counter.tokens(text or "")
        assert special + sum(map(counter.pieces, found)) == many
    rows = [(None if n == 7 else n, t, "x") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    want = sorted((-1 if key is None else key, len((t or "").encode()), many) for (key, t, _), many in zip(rows, want))
    for frequent in (1 << 16, 50, 0):
        got = token_count.count_tokens(docs.repartition(5), JSON, PATTERN, frequent=frequent).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_pre_tokens_are_counted_once_and_joined(spark):
    docs = spark.createDataFrame([(1, "a b a b zzz"), (2, "b")], "doc_id long, text string")
    known = {r.token: (r.times, r.pieces) for r in token_count._distinct(docs, JSON, PATTERN).collect()}
    assert known["a"] == (1, 1) and known[" b"] == (2, 1) and known[" zzz"][0] == 1
    plan = token_count.count_tokens(docs, JSON, PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (each" in plan and "token" in plan and "Generate explode" in plan


def test_query_token_count(spark):
    folder, tokenizer = "/root/testdata/sf0.01", Tokenizer.from_file(JSON)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in op8_token_count(spark, folder).collect():
        text = texts.pop(row.doc_id)
        many = len(tokenizer.encode(text, add_special_tokens=False))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), many, many > 1024)
    assert not texts


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert empty.select(bpe.encode_ids(F.col("text"), RANKS, PATTERN)).collect() == []
    assert token_count.count_tokens(empty, JSON, PATTERN).collect() == []

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tickbars.llm import bpe
from tickbars.llm.queries import op9_byte_bpe, vocabulary

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


@pytest.fixture(scope="module")
def known(vocab):
    ranks = {key: rank for key, rank in zip(vocab.keys, vocab.ranks)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocab):
    assert sorted(vocab.table.slot(k) for k in vocab.keys) == list(range(len(vocab.keys)))
    assert vocab.rank(b"not in it at all") is None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_perfect_hash_of_few_keys(n):
    keys = [b"k%d" % i for i in range(n)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(n))


ODD = [
    "", " ", "\n\n  \t x", "a" * 5000, "é" * 300, "　　x", "it's we'll I'M", "1234 5678", "<|endoftext|>",
    "\U0001f600\U0001f600 ok", "ab" * 2000 + "!!!???", "  .", "日本語テキスト", "\x00\x01", " " * 3000 + "z",
]


def test_ids_are_those_of_the_library(vocab, known):
    encoder = bpe.Encoder(vocab)
    for text in ODD + ODD:  # the second time from memory
        ids = encoder.encode(text).tolist()
        assert ids == known.encode_ordinary(text), text[:20]
        assert encoder.decode(ids) == text.encode()
    lists = pa.array([encoder.encode(t).tolist() for t in ODD] + [None, []], pa.list_(pa.int32()))
    want = [t.encode() for t in ODD] + [b"", b""]
    assert encoder.decode_lists(lists).to_pylist() == want
    assert encoder.decode_lists(lists[3:7]).to_pylist() == want[3:7] and encoder.decode_lists(lists[:0]).to_pylist() == []


def test_query_over_all_documents(spark, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in docs:
        ids = known.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = op9_byte_bpe(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(docs)
    assert {tuple(r) for r in rows} == want


def test_nulls_repeats_and_no_rows(spark, vocab):
    schema = "text string, ids string, doc_id bigint, n_tokens int"
    docs = spark.createDataFrame([(None, "x", 1, 0), ("a b", "x", None, 0), ("a b", "y", 2, 1), ("a b", "y", 2, 1)], schema)
    got = bpe.round_trip(docs, vocab).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 2), (1, 0), (2, 2), (2, 2)]
    assert bpe.round_trip(docs.where("false"), vocab).count() == 0
    assert bpe.decode_ids(docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), vocab).first().decoded == b""

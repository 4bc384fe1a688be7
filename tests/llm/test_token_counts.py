"""Token counts through the digest cache, against the library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from herdspark.llm import token_cache
from herdspark.llm.queries import byte_bpe_50k
from tests.llm.test_packing import ODD

SCHEMA = "doc_id bigint, text string, n_bytes int, n_tokens int, content string, task string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def frame(spark, texts, parts=3):
    rows = [(i, t, -1, -1, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def expected(tokenizer, texts, limit=1024):
    out = []
    for i, text in texts:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        out.append((i, len((text or "").encode()), n, n > limit))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sent", [0, 1000])
def test_counts_equal_the_library(spark, tokenizer, tmp_path, sent):
    rng = random.Random(5)
    odd = ODD + ["".join(rng.choice("aB é1'\n\t. 语🙂") for _ in range(80)) for _ in range(60)]
    texts = list(enumerate([*odd, None, None, "word " * 30_000, "z" * 40_000, "same", "same", "<|endoftext|>"]))
    texts += [(None, "same"), (None, None), (3, odd[3]), (3, "other")]
    got = token_cache.token_counts(frame(spark, texts), byte_bpe_50k(), str(tmp_path / "cache"), sent_digests=sent)
    assert found(got) == expected(tokenizer, texts)


def test_limit_is_exclusive(spark, tokenizer):
    texts = [(1, "a" + " a" * 1023), (2, "a" + " a" * 1024)]
    assert found(token_cache.token_counts(frame(spark, texts), byte_bpe_50k())) == [(1, 2047, 1024, False), (2, 2049, 1025, True)]
    assert expected(tokenizer, texts)[1][2] == 1025


def test_only_distinct_misses_are_encoded(spark, tokenizer, tmp_path):
    cache, version = str(tmp_path / "cache"), token_cache.version_digest(byte_bpe_50k())

    def appended():
        rows = spark.read.parquet(cache)
        return rows.count(), rows.select("tokenizer", "content").distinct().count()

    first = [(i, f"text {i % 4}") for i in range(40)]
    assert found(token_cache.token_counts(frame(spark, first), byte_bpe_50k(), cache)) == expected(tokenizer, first)
    assert appended() == (4, 4)
    more = first + [(100, "text 9"), (101, "text 9"), (102, None)]
    assert found(token_cache.token_counts(frame(spark, more), byte_bpe_50k(), cache)) == expected(tokenizer, more)
    assert appended() == (6, 6)
    docs = frame(spark, more)
    digests = spark.read.parquet(cache).select("content")
    assert token_cache.fill_cache(docs, digests, byte_bpe_50k(), cache, version) == 0
    # Another version of the tokenizer knows none of these counts.
    assert token_cache.fill_cache(docs, digests, byte_bpe_50k(), cache, "other") == 6
    assert appended() == (12, 12)


def test_stored_counts_are_used_and_may_repeat(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), token_cache.version_digest(byte_bpe_50k())
    docs = frame(spark, [(1, "hello"), (2, "hello")])
    digest = docs.selectExpr("sha2(text, 256) AS content").first()["content"]
    for _ in range(2):
        stored = spark.createDataFrame([(version, digest, 77), ("old", digest, 5)], token_cache.CACHE_SCHEMA)
        stored.write.mode("append").parquet(cache)
    assert found(token_cache.token_counts(docs, byte_bpe_50k(), cache)) == [(1, 5, 77, False), (2, 5, 77, False)]


def test_a_text_that_most_rows_share_has_a_key_in_every_task(spark, tokenizer):
    texts = [(i, "hot" if i % 3 else f"text {i}") for i in range(600)]
    assert found(token_cache.token_counts(frame(spark, texts, 7), byte_bpe_50k())) == expected(tokenizer, texts)


def test_empty_table(spark):
    assert found(token_cache.token_counts(frame(spark, []), byte_bpe_50k())) == []


def test_query_equals_brute_force(spark, tokenizer):
    from herdspark.llm.queries import op12_token_counts

    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(op12_token_counts(spark, sf)) == expected(tokenizer, texts)

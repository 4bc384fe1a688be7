"""Token counts through a cache of content digests.

A count is stored under two digests: one of the normalised content and one of
the tokenizer's version (its file, its library and how it is called). Contents
are joined with the counts stored for the version; of those not found, each
distinct content is encoded once and its count is appended to the cache. The
answer is then read from the cache alone, so a run that was broken off goes on
where its last append ended, and two runs that append the same count do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.llm.common import slices, text_of
from herdspark.llm.packing import word_encoder
from herdspark.session import checkpoint_root, cut_lineage

TOKEN_LIMIT = 1024
CACHE_SCHEMA = "tokenizer string, content string, n_tokens bigint"
#: Missing digests sent to every task instead of being joined by key: at most 64 bytes each, 6.4 MB in all.
SENT_DIGESTS = 100_000
#: Texts of a batch that are Python strings at the same time.
ROWS = 64


def version_digest(tokenizer: tuple[str, str, str]) -> str:
    """The digest of everything a count depends on besides the content."""
    import tokenizers

    digest = hashlib.sha256(f"tokenizers {tokenizers.__version__}, no added special tokens\n".encode())
    with open(tokenizer[0], "rb") as file:
        while piece := file.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def stored_counts(df: DataFrame, cache: str, version: str) -> DataFrame:
    """(content, n_tokens): the counts stored for a version, once each; a missing cache is made first."""
    spark = df.sparkSession
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(cache)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_contents(contents: DataFrame, tokenizer: tuple[str, str, str]) -> DataFrame:
    """(content, n_tokens) of the rows (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(*tokenizer)
        for batch in batches:
            counts = [len(encode(text)) // 4 for text in slices(batch.column(1), ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return contents.select("content", "text").mapInArrow(run, "content string, n_tokens bigint")


def fill_cache(
    docs: DataFrame, contents: DataFrame, tokenizer: tuple[str, str, str], cache: str, version: str,
    normalised: Callable[[], Column] = text_of, sent_digests: int = SENT_DIGESTS,
) -> int:
    """Encode the contents of ``docs`` that the cache lacks and append them; returns how many there were.

    ``contents`` (content) are the digests of the texts. Copies of a text are
    brought together in each task before texts are shuffled, so a text that a
    third of all rows share is shuffled once a task. Few missing digests go to
    the tasks that scan the texts; many are joined by key with the distinct texts.
    """
    stored = stored_counts(docs, cache, version)
    missing = cut_lineage(contents.distinct().join(stored, "content", "left_anti"))
    n_missing = missing.count()
    if not n_missing:
        return 0
    texts = docs.select(F.sha2(normalised().cast("binary"), 256).alias("content"), normalised().alias("text"))
    if n_missing <= sent_digests:
        texts = texts.join(F.broadcast(missing), "content", "left_semi")
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    if n_missing > sent_digests:
        distinct = distinct.join(missing, "content", "left_semi")
    counted = encode_contents(distinct, tokenizer).withColumn("tokenizer", F.lit(version))
    counted.select("tokenizer", "content", "n_tokens").write.mode("append").parquet(cache)
    return n_missing


def token_counts(
    docs: DataFrame, tokenizer: tuple[str, str, str], cache: str | None = None, limit: int = TOKEN_LIMIT,
    normalised: Callable[[], Column] = text_of, sent_digests: int = SENT_DIGESTS,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per document.

    ``tokenizer`` names the tokenizer's file, the rank file of its vocabulary and
    the pattern that cuts words. ``cache`` is a folder that all executors share;
    without one a new folder under ``spark.checkpoint.dir`` is used. ``normalised``
    gives the content that is digested and encoded; as it is, a null text counts
    as empty and nothing else changes. Empty texts have no token. Repeated rows
    and rows without id are answered each; an empty table gives no rows; other
    columns are not read.

    Documents find their count by (digest, task that read them): a digest that
    very many documents share is spread over as many keys as tasks saw it.
    """
    cache = cache or f"{checkpoint_root(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
    version = version_digest(tokenizer)
    text = normalised()
    keyed = cut_lineage(
        docs.select(
            "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("content"),
            F.spark_partition_id().alias("task"),
        )
    )
    places = keyed.groupBy("content", "task").agg(F.count(F.lit(1)).alias("n"))
    fill_cache(docs, places.select("content"), tokenizer, cache, version, normalised, sent_digests)
    counts = places.select("content", "task").join(stored_counts(docs, cache, version), "content")
    return keyed.join(counts, ["content", "task"]).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdspark.llm import (
    block_dedup,
    conversations,
    decontaminate,
    langid,
    licenses,
    packing,
    pii,
    secret_scan,
    sharding,
    simhash,
    spelling,
    token_cache,
    url_filter,
)
from herdspark.llm.registry import query
from herdspark.plans.registry import table


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


@query("op5_licenses", licenses.check_sql())
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def byte_bpe_50k() -> tuple[str, str, str]:
    """The tokenizer's file, its rank file and the pattern that splits a text."""
    path = public_tokenizers.path
    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe_50k())


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query("op6_secrets", secret_scan.check_sql())
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predictions(docs, langid.learn(docs, ~langid.held_out()))


@query("op8_url_filter", url_filter.check_sql())
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
FOLDED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op9_decontamination",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED.format('text')}, '{WORD}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({FOLDED.format('text')}, '{WORD}') AS w FROM benchmark),
    i AS (SELECT *, least(len(w), {decontaminate.WINDOW}) AS size FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS words
        FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM i)),
    sizes AS (SELECT DISTINCT size FROM i),
    places AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS words
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes)),
    hits AS (SELECT p.doc_id, p.size, p.s, x.item_id FROM places p JOIN windows x USING (size, words)),
    covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query(
    "op10_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run begins with an empty cache, so its figures hold every distinct text."""
    return token_cache.token_counts(table(spark, sf_dir, "documents"), byte_bpe_50k())


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))

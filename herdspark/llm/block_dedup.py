"""Exact duplicate detection by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are
sorted and numbered; then adjacent numbers are paired and the distinct pairs
sorted and numbered again, until one number is left per document. Two documents
of as many blocks have the same number exactly if their bytes are the same:
names are given to whole blocks and whole pairs, never to digests of them.

Only the distinct blocks of a task travel with their bytes. Documents find the
names of their blocks by a 128-bit address; the table of names shows whether two
different blocks share an address, and if so all addresses are drawn anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.llm.common import bytes_of, keep_rows
from herdspark.session import cut_lineage

BLOCK_BYTES = 16_384
MAX_SALTS = 8


def blocks_of(raw: Column, size: int) -> Column:
    """The blocks of a byte string; an empty one has one empty block."""
    last = F.greatest(F.ceil(F.octet_length(raw) / size).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size))
    )


def _address(block: Column, salt: int) -> list[Column]:
    return [
        F.xxhash64(F.lit(2 * salt), block).alias("a"),
        F.xxhash64(F.lit(2 * salt + 1), block).alias("b"),
    ]


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers sorted distinct keys: part of the shuffle, then place in the sorted part."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(a, b, name) of every distinct block, and the salt under which (a, b) is unique."""
    for salt in range(MAX_SALTS):
        blocks = docs.select(F.explode(blocks_of(bytes_of(), size)).alias("block")).distinct()
        names = cut_lineage(_named(blocks, ["block"]).select(*_address(F.col("block"), salt), "name"))
        if names.groupBy("a", "b").count().filter("count > 1").isEmpty():
            return names, salt
    raise RuntimeError("no salt gave every block an address of its own")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, sha, blocks, name): (blocks, name) is the same for equal texts only.

    Null counts as the empty text. Rows are told apart by ``row``, so repeated
    rows and null or repeated ids are all answered.
    """
    names, salt = block_names(docs, block_bytes)
    address = F.transform(
        blocks_of(bytes_of(), block_bytes), lambda b: F.struct(*_address(b, salt))
    )
    rows = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            F.sha2(bytes_of(), 256).alias("sha"), address.alias("at"),
        ).withColumn("blocks", F.size("at"))
    )
    short = rows.filter("blocks = 1").select("row", "doc_id", "sha", "blocks", F.col("at")[0]["a"].alias("a"), F.col("at")[0]["b"].alias("b"))
    parts = [short.join(names, ["a", "b"]).select("row", "doc_id", "sha", "blocks", "name")]
    most = rows.agg(F.max("blocks")).first()[0] or 0
    if most > 1:
        long = rows.filter("blocks > 1")
        sequence = (
            long.select("row", "blocks", F.posexplode("at"))
            .select("row", "blocks", F.col("pos").alias("place"), "col.a", "col.b")
            .join(names, ["a", "b"])
            .select("row", "blocks", "place", "name")
        )
        done = []
        left = F.col("blocks")
        while most > 1:
            sequence, left, most = _paired(sequence), F.ceil(left / 2), (most + 1) // 2
            done.append(sequence.filter(left == 1).select("row", "name"))
            sequence = sequence.filter(left > 1)
        finished = done[0]
        for more in done[1:]:
            finished = finished.unionByName(more)
        parts.append(long.select("row", "doc_id", "sha", "blocks").join(finished, "row"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def _paired(sequence: DataFrame) -> DataFrame:
    """One round: a name for each two neighbours; a last one without partner pairs with -1."""
    pairs = cut_lineage(
        sequence.groupBy("row", "blocks", F.floor(F.col("place") / 2).alias("half")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
        )
    )
    names = cut_lineage(_named(pairs.select("first", "second").distinct(), ["first", "second"]))
    return pairs.join(names, ["first", "second"]).select("row", "blocks", F.col("half").alias("place"), "name")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays (null is the smallest). Of repeated
    rows with one id and text exactly one is marked kept. An empty table gives
    no rows. Other columns of the table, whatever their names, are not read.
    """
    found = cut_lineage(identities(docs.select("doc_id", "text"), block_bytes))
    groups = cut_lineage(
        found.groupBy("blocks", "name").agg(
            F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        )
    )
    return found.join(groups, ["blocks", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without copies, all columns kept: the largest doc_id of equal texts stays."""
    kept = exact_duplicates(docs, block_bytes).filter("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    return keep_rows(docs, kept)

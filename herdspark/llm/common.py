"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A-Z lower-cased, every other byte kept.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: As FOLD, and every ASCII byte but digits and letters becomes a space.
WORDS = bytes(
    32 if b < 128 and not chr(b).isalnum() else FOLD[b] for b in range(256)
)

_GAP = re.compile(rb"[\x20\x09-\x0D]")
CHUNK_BYTES = 1 << 20


def folded(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bytes_of(name: str = "text") -> Column:
    return text_of(name).cast("binary")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def word_chunks(raw: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number at a time.

    ``table`` maps every separator to white space. A chunk ends between two
    words, so each word is whole and appears once; a single word is never cut.
    """
    if len(raw) <= CHUNK_BYTES:
        yield raw.translate(table).split()
        return
    start = 0
    while start < len(raw):
        stop = start + CHUNK_BYTES
        piece = raw[start:stop].translate(table)
        while stop < len(raw):
            more = raw[stop : stop + CHUNK_BYTES].translate(table)
            gap = _GAP.search(more)
            if gap:
                piece += more[: gap.start()]
                stop += gap.start()
                break
            piece += more
            stop += CHUNK_BYTES
        yield piece.split()
        start = stop


def slices(column, rows: int = 256) -> Iterator:
    """Python values of an Arrow column, a few rows at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, sha); one of each if rows repeat.

    ``kept`` holds a key once. Whole texts are shuffled once, by (sha, doc_id).
    Rows that share id and text are one document: one of them stays.
    """
    sha, key, mark = fresh(docs, "sha"), fresh(docs, "key"), fresh(docs, "mark")
    keyed = docs.withColumn(sha, F.sha2(bytes_of(), 256))
    other = kept.select(F.col("sha").alias(key), F.col("doc_id").alias(mark))
    same = (F.col(sha) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(mark))
    found = keyed.join(other, same, "left_semi")
    repeated = docs.select("doc_id", F.sha2(bytes_of(), 256).alias(sha)).groupBy("doc_id", sha).count()
    if not repeated.filter("count > 1").isEmpty():
        found = found.dropDuplicates([sha, "doc_id"])
    return found.drop(sha)

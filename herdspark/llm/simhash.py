"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints with four
differing bits differ by at most one bit in the first segment or in the second,
or by none in the third: two and two and one would be five. The first two are
indexed once for each of their bits with that bit blanked, the third as it is. So
linked fingerprints meet in a bucket of an equality join and are verified there.

Buckets of more than ``SMALL`` fingerprints are not joined with themselves. They
answer with a spanning forest of their links, never with all pairs; beyond
``BLOCK`` fingerprints a bucket is split into blocks, and each two blocks are
compared in a task of their own, so that memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.llm.common import FOLD, bytes_of, keep_rows, slices, word_chunks
from herdspark.llm.components import connected
from herdspark.session import cut_lineage

SHINGLE_WORDS = 4
MAX_BITS = 4
#: (first bit, bits, blanked bits) of the segments; these widths make the fewest chance meetings.
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
SMALL = 32
BLOCK = 4096
SEED = 42


def fingerprint(raw: bytes, k: int = SHINGLE_WORDS) -> int:
    """A bit is set if it is set in more than half of the k-word shingle hashes.

    Fewer words than k are one shingle; no word gives zero.
    """
    digest = xxhash.xxh64_intdigest
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_chunks(raw, FOLD):
        tail += words
        if len(tail) >= k:
            shingles = zip(*(tail[i:] for i in range(k)), strict=False)
            hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, len(tail) - k + 1)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
            tail = tail[len(tail) - k + 1 :]
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, sha, fp): the fingerprint of each whole text as a signed long."""
    source = docs.select("doc_id", F.sha2(bytes_of(), 256).alias("sha"), bytes_of().alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(raw, k) for raw in slices(batch.column(2))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "sha", "fp"]
            )

    schema = T.StructType([source.schema["doc_id"], source.schema["sha"], T.StructField("fp", T.LongType())])
    return source.mapInArrow(run, schema)


def variant_keys(fp: Column) -> Column:
    """The segments' keys: a number for the segment and blanked bit, and the segment without that bit."""
    keys = []
    for start, width, blanked in SEGMENTS:
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        for bit in range(width) if blanked else [None]:
            shown = segment if bit is None else segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("bigint"))
            keys.append((shown + F.lit(len(keys) << 23).cast("bigint")).cast("int"))
    return F.array(*keys)


def _spanning(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints, by breadth-first search."""
    left = fps
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            near = np.bitwise_count(left ^ a) <= max_bits
            if near.any():
                found = left[near]
                yield from ((int(a), int(b)) for b in found)
                frontier.extend(found)
                left = left[~near]


def _forest(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (key, one, two); those already implied in this task are left out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while root.setdefault(x, x) != x:
            path.append(x)
            x = root[x]
        for p in path:
            root[p] = x
        return x

    def links(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]) if len(fps) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(fps)])
        two = starts[sizes == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits if len(two) else np.zeros(0, bool)
        pairs = [(int(fps[i]), int(fps[i + 1])) for i in two[near]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            pairs.extend(_spanning(fps[start : start + size], max_bits))
        for a, b in pairs:
            ra, rb = find(a), find(b)
            if ra != rb:
                root[rb] = ra
                out.append((a, b))
        ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    held_g, held_f = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not len(batch):
            continue
        g = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        f = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        g, f = np.concatenate([held_g, g]), np.concatenate([held_f, f])
        last = np.flatnonzero((g != g[-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        held_g, held_f = g[cut:], f[cut:]
        if cut:
            yield links(g[:cut], f[:cut])
    yield links(held_g, held_f)


def links(fps: DataFrame, max_bits: int = MAX_BITS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints at ``max_bits`` or fewer differing bits."""
    if max_bits > MAX_BITS:
        raise ValueError("these segments find four differing bits at most")
    variants = fps.select("fp", F.explode(variant_keys(F.col("fp"))).alias("key"))
    large = cut_lineage(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small))
    few = variants.join(large, "key", "left_anti")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    met = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), "key")
    joined = met.filter((F.col("u") < F.col("v")) & close).select("u", "v")
    members = variants.join(large, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    dealt = members.select(
        "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fp"
    )
    sorted_ = dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return joined.unionByName(sorted_.mapInArrow(lambda batches: _forest(batches, max_bits), "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, sha, fingerprint, component_id, root), one row per document.

    ``component_id`` is the smallest doc_id reachable over links, the document's
    own included; ``root`` is one fingerprint of the component. Null and empty texts have fingerprint zero and are linked like
    any other. Repeated rows are answered each; rows without id take part, and a
    component of such rows alone has a null id. An empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs.select("doc_id", "text"), k))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(fps.select("fp"), max_bits))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(placed.join(least, "root").select("fp", "component_id", "root"))
    return rows.join(classes, "fp").select(
        "doc_id", "sha", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root"
    )


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component stays, the smallest id; all columns kept.

    Of rows that share this id one stays; a component without ids keeps one row.
    """
    found = near_duplicates(docs, k, max_bits)
    kept = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha")).alias("keep")
    )
    return keep_rows(docs, kept.select("keep.doc_id", "keep.sha"))

"""Sharding by a hierarchical tree of weighted hash draws.

A document descends region, rack and shard. At each level every child draws an
exponential number from the hash of the document's id and the child's name,
divided by the child's weight; the least draw wins. A child's chance is its share
of the weight, and a child whose weight changes wins documents from its siblings
or loses them to these, while draws among unchanged siblings stay as they were.
So documents move only into or out of subtrees whose weights change.

The first shards form racks of regions; a further shard opens a region of its
own. Thus one more shard takes documents into itself and moves no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdspark.llm.common import bytes_of
from herdspark.session import cut_lineage

#: Of the racked shards: shards in a rack, racks in a region, and shards in all.
RACK_SHARDS, REGION_RACKS, RACKED_SHARDS = 4, 3, 24
SHARDS = 24
ROW_BYTES = 8
_LEAST_U = 2.0**-53


def tree(shards: int, weights: dict[int, float] | None = None) -> dict[str, dict[str, dict[int, float]]]:
    """region -> rack -> shard -> weight for a number of shards; weight 1 unless given."""
    out: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        if shard < RACKED_SHARDS:
            rack = shard // RACK_SHARDS
            region, rack = f"region {rack // REGION_RACKS}", f"rack {rack}"
        else:
            region = rack = f"shard {shard}"
        out.setdefault(region, {}).setdefault(rack, {})[shard] = (weights or {}).get(shard, 1.0)
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential number with the child's weight as its rate."""
    top = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((top.cast("double") + 0.5) * F.lit(_LEAST_U)) / F.lit(float(weight))


def _winner(key: Column, level: str, children: list[tuple[int, str, float]]) -> Column:
    """The number of the child with the least draw; the lower number on a tie."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = [F.struct(_draw(key, f"{level}/{name}", weight).alias("d"), F.lit(n).alias("n")) for n, name, weight in children]
    return F.least(*draws)["n"]


def with_shard(df: DataFrame, key: str, layout: dict[str, dict[str, dict[int, float]]], name: str) -> DataFrame:
    """Adds the shard of each row; each level draws among the children of the node chosen above only."""
    key_text = F.col(key).cast("string")
    regions = [(i, r, sum(sum(s.values()) for s in racks.values())) for i, (r, racks) in enumerate(layout.items())]
    df = df.withColumn(f"{name}_region", _winner(key_text, "region", [c for c in regions if c[2] > 0]))
    rack, shard, racks_seen = F.lit(None).cast("int"), F.lit(None).cast("int"), 0
    for i, (_, racks) in enumerate(layout.items()):
        children = [(racks_seen + j, r, sum(s.values())) for j, (r, s) in enumerate(racks.items())]
        children = [c for c in children if c[2] > 0]
        if children:
            rack = F.when(F.col(f"{name}_region") == i, _winner(key_text, "rack", children)).otherwise(rack)
        racks_seen += len(racks)
    df = df.withColumn(f"{name}_rack", rack)
    leaves = [shards for racks in layout.values() for shards in racks.values()]
    for j, shards in enumerate(leaves):
        children = [(s, f"shard {s}", w) for s, w in shards.items() if w > 0]
        if children:
            shard = F.when(F.col(f"{name}_rack") == j, _winner(key_text, "shard", children)).otherwise(shard)
    return df.withColumn(name, shard)


def assign_shards(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack), one row per document.

    ``size`` is the UTF-8 bytes of the text, null none, and ``ROW_BYTES`` more. The law is
    ``key``: doc_id and shard count alone decide, so equal texts may part and
    rows with one id (also a null id) stay together. ``slot`` numbers a shard's
    rows by doc_id, gapless from 0; repeated rows get a slot each. ``grown_shard`` is
    the shard if there were one more. An empty table gives no rows.
    """
    text = bytes_of()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = with_shard(rows, "doc_id", tree(shards, weights), "shard")
    rows = with_shard(rows, "doc_id", tree(shards + 1, weights), "grown_shard")
    # Slots without a task per shard: ranges of (shard, doc_id) are sorted apart, and the
    # few (range, shard) counts say where each range begins.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = cut_lineage(
        rows.repartitionByRange(parts, "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32")
        .withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    )
    per_part = sorted_.groupBy("shard", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select(
        "shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    # A range partition holds one shard, or the ends of a few: a bounded table.
    return sorted_.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") + F.col("shift")).alias("slot"), "grown_shard",
        F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"),
    )

"""The shard tree: law, movement, slots."""

import math
import zlib

import xxhash
from pyspark.sql import functions as F

from herdspark.llm import sharding

SCHEMA = "doc_id bigint, text string, shard string, place int"


def docs(spark, n=6000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.repeat(F.lit("a"), (F.col("id") % 50).cast("int"))).alias("text"), F.lit("x").alias("shard"), F.lit(1).alias("place"))


def shards(df, **kw):
    return {r["doc_id"]: r for r in sharding.assign_shards(df, **kw).collect()}


def draw(key, name, weight):
    value = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(str(key).encode(), 42))
    return -math.log(((value >> 11) + 0.5) * 2.0**-53) / weight


def plain_shard(key, layout):
    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    pick = lambda level, children: min(children, key=lambda c: draw(key, f"{level}/{c[0]}", c[1]))[0] if len(children) > 1 else children[0][0]
    region = pick("region", [(r, total(k)) for r, k in layout.items() if total(k)])
    rack = pick("rack", [(k, sum(s.values())) for k, s in layout[region].items() if sum(s.values())])
    return int(pick("shard", [(f"shard {s}", w) for s, w in layout[region][rack].items() if w]).split()[1])


def test_against_a_plain_descent(spark):
    weights = {3: 2.0, 7: 0.5, 11: 0.0}
    found = shards(docs(spark, 500), weights=weights)
    for i, r in found.items():
        assert r["shard"] == plain_shard(i, sharding.tree(24, weights))
        assert r["grown_shard"] == plain_shard(i, sharding.tree(25, weights))
        text = ("é" + "a" * (i % 50)).encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text)


def test_growth_only_fills_the_new_shard(spark):
    for n in (24, 27):
        found = shards(docs(spark), shards=n)
        moved = [r for r in found.values() if r["shard"] != r["grown_shard"]]
        assert moved and all(r["grown_shard"] == n for r in moved)
        assert abs(len(moved) - 6000 / (n + 1)) < 80
        more = shards(docs(spark), shards=n + 1)
        assert all(more[i]["shard"] == r["grown_shard"] for i, r in found.items())


def test_movement_is_confined(spark):
    before, after = shards(docs(spark)), shards(docs(spark), weights={5: 3.0})
    moved = [(before[i]["region"], before[i]["rack"], after[i]["region"], after[i]["rack"]) for i in before if before[i]["shard"] != after[i]["shard"]]
    # Shard 5 is in region 0, rack 1: moves lead into that region, or between its racks or that rack's shards.
    assert moved and all(m[2] == 0 for m in moved)
    assert all(m[3] == 1 for m in moved if m[0] == 0)


def test_slots_and_balance(spark):
    found = shards(docs(spark))
    by = {}
    for r in found.values():
        by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    assert sorted(by) == list(range(24))
    for rows in by.values():
        assert [s for s, _ in sorted(rows)] == list(range(len(rows)))
        assert sorted(rows) == sorted(rows, key=lambda x: x[1])
        assert 150 < len(rows) < 350


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "s", 1), (1, "", "s", 1), (1, "", "s", 1), (None, "é", "s", 1), (None, None, "s", 1)], SCHEMA)
    rows = sharding.assign_shards(df).collect()
    assert sorted(r["size"] for r in rows) == [8, 8, 8, 8, 10]
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5
    assert sharding.assign_shards(df.limit(0)).count() == 0

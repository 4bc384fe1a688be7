"""Exact and near duplicates against brute force."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from herdspark.llm import block_dedup, simhash
from herdspark.llm.components import connected

SCHEMA = "doc_id bigint, text string, lang string, name string, a bigint, row string"


def rows_of(texts):
    return [(i, t, "en", "n", 1, "r") for i, t in enumerate(texts)]


def expected_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out.append((r[0], keep, len(ids), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_duplicates(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(40))) for _ in range(40)]
    long = "x" * 100 + "é" * 50
    texts += texts[:15] + [None, "", "", long, long, long + "y", "y" + long, "x" * 8, "x" * 16, "x" * 17]
    rows = rows_of(texts)
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (8, 1 << 14):
        found = block_dedup.exact_duplicates(df, size).collect()
        assert sorted([(r[0], r[1], r[2], r[4]) for r in found], key=repr) == expected_exact(rows)
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)


def test_exact_duplicates_of_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (2, None)]
    df = spark.createDataFrame([(i, t, "en", "n", 1, "r") for i, t in rows], SCHEMA)
    found = block_dedup.exact_duplicates(df).collect()
    assert len(found) == 7
    kept = sorted((r["doc_id"], r["text_sha256"]) for r in found if r["kept"] and r["doc_id"] is not None)
    assert [k[0] for k in kept] == [1, 1, 2]
    assert sum(r["kept"] for r in found) == 4
    left = block_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(
        [(1, "a"), (1, "b"), (None, "c"), (2, None)], key=repr
    )


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert block_dedup.exact_duplicates(df).count() == 0
    assert block_dedup.drop_exact_duplicates(df).count() == 0
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0


def test_addresses_are_drawn_anew(spark, monkeypatch):
    real = block_dedup._address
    monkeypatch.setattr(
        block_dedup, "_address",
        lambda b, salt: [F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")] if salt == 0 else real(b, salt),
    )
    rows = rows_of(["p", "q", "p", None])
    found = block_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted([(r[0], r[1], r[2], r[4]) for r in found], key=repr) == expected_exact(rows)


def plain_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def noisy_texts(rng, groups=12, copies=8, length=120):
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(length)] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  "]).join(words).title())
    return texts


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = noisy_texts(rng) + [None, "", " \n", "one", "ONE", "one two three", "one two three four", "a\x85b c d"]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [
        (i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    roots = plain_components(pairs, range(len(texts)))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert found == {i: (f"{prints[i]:016x}", roots[i]) for i in range(len(texts))}
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == set(roots.values())


def test_long_texts_are_read_in_chunks(monkeypatch):
    from herdspark.llm import common

    text = " ".join(noisy_texts(random.Random(1), 2, 2))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(common, "CHUNK_BYTES", 50)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_links_of_split_buckets(spark):
    """A large group within few bits: buckets are split and no link between components is lost."""
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    for c in centres:
        for _ in range(150):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = plain_components(pairs, range(len(prints)))
    for small, block in ((4, 7), (4, 4096), (10_000, 7)):
        edges = {(r["u"], r["v"]) for r in simhash.links(df, small=small, block=block).collect()}
        at = {s: i for i, s in enumerate(signed)}
        assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in edges)
        assert plain_components([(at[u], at[v]) for u, v in edges], range(len(prints))) == want


def test_connected(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)] + [(500, 600 + i) for i in range(50)]
    nodes = {n for pair in links for n in pair} - {300}
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = plain_components([p for p in links if p[0] != p[1]], nodes)
    assert {n: found.get(n, n) for n in nodes} == want
    assert connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "other words here now"), (3, "")]
    df = spark.createDataFrame([(i, t, "en", "n", 1, "r") for i, t in rows], SCHEMA)
    found = simhash.near_duplicates(df)
    assert sorted((r["component_id"] for r in found.collect()), key=repr) == sorted([1, 1, 1, None, 3], key=repr)
    left = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()), key=repr)
    assert left == sorted([(1, "a b c d e"), (None, "other words here now"), (3, "")], key=repr)

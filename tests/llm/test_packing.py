"""Packing: exact round trip, tiers and edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from herdspark.llm import packing
from herdspark.llm.queries import byte_bpe_50k

SCHEMA = "doc_id bigint, text string, length bigint, part int, tier string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\nb", "\n \n", "\t a b  c", "don't 'll we've",
    "x" * 5000, "é " * 300, "1 22 333!! ?", "a\0b c\0 d", " \x1c b", "a\x1c b", "<|endoftext|> a", "日本語 テキスト 🙂 end",
    "a\x85 b", "a \x85b", "tab\tsep  two", "end.\nNext line.\n",
]


def test_ids_equal_the_library(tokenizer):
    encode = packing.word_encoder(*byte_bpe_50k())
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "B", " ", "\n", "é", "1", "'", "s", "\t", ".", " ", "\x1c"]) for _ in range(60)) for _ in range(300)]
    for text in texts + texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, texts, tokenizer):
    tokens = {i: ids_of(tokenizer, t) for i, t in texts}
    seen = {i: [] for i in tokens}
    sequences = {}
    for r in rows:
        ids = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] > 0 and r["doc_tokens"] == len(tokens[r["doc_id"]])
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"], r["sequence_id"]))
    assert all(sorted(seen[i]) == list(range(len(tokens[i]))) for i in tokens)
    padding = 0
    for found in sequences.values():
        end = 0
        for offset, length, _, _ in sorted(found):
            assert offset == end
            end += length
        tier = found[0][2]
        assert end <= tier and (end == tier or tier == 1024)
        padding += tier - end
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def test_round_trip(spark, tokenizer):
    rng = random.Random(4)
    texts = list(enumerate(ODD + [None] + [" ".join(rng.choice(["cat", "dog", "über", "x1"]) for _ in range(int(rng.expovariate(1 / 400)))) for _ in range(300)]))
    df = spark.createDataFrame([(i, t, 1, 1, "x") for i, t in texts], SCHEMA).repartition(5)
    rows = packing.pack(df, byte_bpe_50k()).collect()
    padding = check(rows, texts, tokenizer)
    assert padding < 1024 + 0.01 * sum(r["length"] for r in rows)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "same", 1, 1, "x")] * 3 + [(None, None, 1, 1, "x")], SCHEMA)
    rows = packing.pack(df, byte_bpe_50k()).collect()
    assert sorted(r["length"] for r in rows) == [1, 2, 2, 2]
    assert len({r["offset"] for r in rows}) == 4 and len({r["sequence_id"] for r in rows}) == 1
    assert packing.pack(df.limit(0), byte_bpe_50k()).count() == 0


def test_plan_places_every_piece_once():
    rng = random.Random(8)
    for _ in range(50):
        counts = {rng.randrange(1, 1025): rng.randrange(1, 500) for _ in range(rng.randrange(1, 200))}
        used = dict.fromkeys(counts, 0)
        fill = {}
        for n, first, end, per, sequence, at, tier in packing.plan(counts):
            assert first == used[n] and (end - first) % per == 0
            used[n] = end
            for s in range(sequence, sequence + (end - first) // per):
                fill.setdefault(s, []).append((at, per * n, tier))
        assert used == counts
        for parts in fill.values():
            end = 0
            for at, size, tier in sorted(parts):
                assert at == end
                end += size
            assert end == tier or (tier == 1024 and end < 1024)


def test_step_groups_hold_one_tier_and_are_even(spark, tokenizer):
    """More than a step's worth of sequences in two tiers, in two patterns each."""
    word = "a"
    assert ids_of(tokenizer, " ".join([word] * 9)) == ids_of(tokenizer, word)[:1] + ids_of(tokenizer, " a")[:1] * 8 + [0]
    sizes = [1024] * 90 + [600, 424] * 60 + [512] * 150 + [300, 212] * 170
    df = spark.createDataFrame([(i, " ".join([word] * (n - 1)), 1, 1, "x") for i, n in enumerate(sizes)], SCHEMA).repartition(3)
    patterns, steps = {}, {}
    for r in packing.pack(df, byte_bpe_50k()).collect():
        patterns.setdefault((r["step_group"], r["tier"], r["sequence_id"]), []).append(r["length"])
    for (step, tier, _), lengths in patterns.items():
        steps.setdefault(step, []).append((tier, tuple(sorted(lengths))))
    assert sorted(steps) == list(range(len(steps)))
    by_tier = {}
    for step, found in steps.items():
        tiers = {tier for tier, _ in found}
        assert len(tiers) == 1 and sum(tier for tier, _ in found) <= packing.STEP_TOKENS
        by_tier.setdefault(tiers.pop(), []).append([pattern for _, pattern in found])
    assert len(by_tier) >= 2 and all(len(by_tier[t]) >= 2 for t in (1024, 512))
    for tier, groups in by_tier.items():
        total = sum(map(len, groups))
        assert len(groups) == -(-total // (packing.STEP_TOKENS // tier))
        assert max(map(len, groups)) - min(map(len, groups)) <= 1
        for pattern in {p for g in groups for p in g}:
            counts = [g.count(pattern) for g in groups]
            assert max(counts) - min(counts) <= 1

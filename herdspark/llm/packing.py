"""Hierarchical multi-length packing of tokenised documents.

Documents are cut into full windows of the longest context and a rest. Rests are
routed to tiers by their length. Tiers are packed from the longest window to the
shortest: a window starts with pieces of its own tier and its gap is filled with
the longest pieces of shorter tiers that fit. Short windows are kept only when
they come out exactly full, so they need no padding; what is left over is packed
into windows of the longest tier.

The plan is made over counts of lengths, which are as many as the longest window
has tokens however large the corpus is. A piece finds its place by its rank
among the pieces of its length. Token ids never leave the task that made them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.llm.common import slices, text_of
from herdspark.session import cut_lineage

TIERS = (1024, 512, 256, 128)
END_ID = 0
#: Tokens of one training step at most; a step has sequences of one tier.
STEP_TOKENS = 65_536
CACHED_WORDS = 300_000
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=1)
def word_encoder(json_path: str, ranks_path: str, pattern: str) -> Callable[[str], bytes]:
    """Text to token ids, as little-endian unsigned 32-bit numbers.

    The ids are those of the ``tokenizers`` file. A space before a non-space
    always begins a new token group of this vocabulary, so a text may be cut
    before such spaces and equal parts are encoded once. Parts are encoded with
    the rank file of the same vocabulary. Texts that hold the special token's
    string go to the ``tokenizers`` library whole.
    """
    import numpy as np
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(json_path)
    before_word = regex.compile(r"(?= \S)", flags=regex.V1)
    odd_space = regex.compile(r"\s\s")
    known: dict[str, bytes] = {}

    def packed(part: str) -> bytes:
        return np.array(encode(part), "<u4").tobytes()

    def lookup(parts: list[str]) -> bytes:
        out = list(map(known.get, parts))
        if None in out:
            if len(known) + len(parts) > CACHED_WORDS:
                known.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    part = parts[i]
                    out[i] = ids = known.get(part) or packed(part)
                    if len(part) < 64:
                        known[part] = ids
        return b"".join(out)

    def ids(text: str) -> bytes:
        if SPECIAL in text:
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if odd_space.search(text):
            return lookup([p for p in before_word.split(text) if p])
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else before_word.split(text)
        return lookup([p for p in parts if p])

    return ids


def pieces_of(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each full window and of the rest."""
    return [
        (at // 4, min(window, (len(ids) - at) // 4), zlib.crc32(ids[at : at + 4 * window]))
        for at in range(0, len(ids), 4 * window)
    ]


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], window: int = TIERS[0]) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), one row per piece; null text counts as empty."""
    source = docs.select("doc_id", text_of().alias("text"))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(*tokenizer)
        for batch in batches:
            rows, columns = [], [[], [], [], []]
            for row, text in enumerate(slices(batch.column(1), 64)):
                ids = encode(text) + end
                for start, length, crc in pieces_of(ids, window):
                    rows.append(row)
                    for column, value in zip(columns, (start, length, crc, len(ids) // 4), strict=True):
                        column.append(value)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *longs]))


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, per_sequence, sequence_from, offset, tier).

    Pieces of ``length`` with rank r in [rank_from, rank_to) go to sequence
    ``sequence_from + (r - rank_from) // per_sequence``; the n-th of them there
    starts at ``offset + n * length``. Each step builds one pattern of lengths as
    often as the counts allow, so the number of steps follows the number of
    lengths and not the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    sequences = 0

    def fill(window: int, first: int) -> dict[int, int]:
        pattern, gap, most = {first: 1}, window - first, first
        while gap:
            # The longest piece that fits: same tier first, then shorter tiers.
            fits = [n for n in lengths if n <= min(gap, most) and left[n] > pattern.get(n, 0)]
            if not fits:
                break
            n = fits[0]
            times = min(gap // n, left[n] - pattern.get(n, 0))
            pattern[n] = pattern.get(n, 0) + times
            gap -= times * n
        return pattern

    def take(pattern: dict[int, int], tier: int) -> None:
        nonlocal sequences
        times = min(left[n] // k for n, k in pattern.items())
        offset = 0
        for n, k in pattern.items():
            rows.append((n, used[n], used[n] + times * k, k, sequences, offset, tier))
            used[n] += times * k
            left[n] -= times * k
            offset += n * k
        sequences += times
        for n in [n for n in pattern if not left[n]]:
            del left[n]
            lengths.remove(n)

    lengths = sorted(left, reverse=True)
    bounds = [*tiers, 0]
    for tier, shorter in zip(tiers, bounds[1:], strict=True):
        refused: set[int] = set()
        while own := [n for n in lengths if shorter < n <= tier and n not in refused]:
            pattern = fill(tier, own[0])
            if tier == tiers[0] or sum(n * k for n, k in pattern.items()) == tier:
                take(pattern, tier)
            else:
                refused.add(own[0])
    while lengths:
        take(fill(tiers[0], lengths[0]), tiers[0])
    return rows


def dealt_steps(rows: list[tuple[int, int, int, int, int, int, int]], step_tokens: int = STEP_TOKENS) -> list[tuple[int, ...]]:
    """The plan's rows with (tier_from, tier_steps, first_step) added.

    ``tier_from`` numbers the sequences within their tier, in plan order; the n-th
    of a tier goes to step ``first_step + n % tier_steps``. Equal patterns are
    neighbours in the plan, so the steps of a tier differ by at most one sequence,
    and by at most one of each pattern. A tier has as few steps as hold its
    sequences; steps are numbered from the longest tier to the shortest.
    """
    blocks = {first: (tier, (end - start) // per) for _, start, end, per, first, _, tier in rows}
    sequences: dict[int, int] = {}
    before = {}
    for first, (tier, times) in sorted(blocks.items()):
        before[first] = sequences.get(tier, 0)
        sequences[tier] = before[first] + times
    steps, first_step, used = {}, {}, 0
    for tier in sorted(sequences, reverse=True):
        steps[tier] = -(-sequences[tier] // max(1, step_tokens // tier))
        first_step[tier] = used
        used += steps[tier]
    return [(*row, before[row[4]], steps[row[6]], first_step[row[6]]) for row in rows]


PLAN_SCHEMA = (
    "p_length bigint, rank_from bigint, rank_to bigint, per_sequence bigint, sequence_from bigint, at bigint, tier int, "
    "tier_from bigint, tier_steps bigint, first_step bigint"
)


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group).

    One row per piece; every document, an empty one too, has at least the end id.
    Sequences of the longest tier are padded to it, those of shorter tiers are
    exactly full. A step group holds sequences of one tier, at most ``STEP_TOKENS``
    tokens; the groups of a tier are even in size and in patterns of lengths.
    Repeated rows are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = cut_lineage(
        pieces(docs, tokenizer, tiers[0]).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    )
    per_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = spark.createDataFrame(dealt_steps(plan(counts, tiers)), PLAN_SCHEMA)
    inside = Window.partitionBy("length", "part").orderBy("place")
    ranked = (
        cut.withColumn("own", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "part"])
        .withColumn("rank", F.col("earlier") + F.col("own"))
    )
    nth = F.col("rank") - F.col("rank_from")
    # At most a few rows for each length up to the longest window: a bounded table.
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(F.broadcast(steps), here)
    nth_sequence = F.floor(nth / F.col("per_sequence")).cast("bigint")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence_from") + nth_sequence).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per_sequence")) * F.col("length")).alias("offset"),
        "tier",
        (F.col("first_step") + F.pmod(F.col("tier_from") + nth_sequence, F.col("tier_steps"))).alias("step_group"),
    )

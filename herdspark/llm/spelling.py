"""Spelling variants: words one edit apart, found by blocked Gram matrices.

A word's letters are counted. Words one edit apart differ by two in the squared
distance of their counts if a letter is replaced, and by one if one is inserted
or deleted. Squared distances of whole blocks come from one product of count
matrices; pairs at most two apart are kept, and their edits verified.

Words are blocked by length and, within a length, by how many letters fall into
each of ``GROUPS`` classes: one edit takes at most one letter from one class and
adds at most one to another. A cell therefore meets itself, the ten cells of its
length and the five of the next length that one edit leads to, each pair of
cells in one place. The home words of a place are split into blocks of
``BLOCK``; the visiting words stream past them, so a task holds one block and one
chunk however many words a cell has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.llm.common import slices, text_of
from herdspark.session import cut_lineage

#: The letters of a word: a-z and U+00C0 to U+00FF; A-Z are lower-cased before.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = re.compile("[a-zÀ-ÿ]+")
NOT_RUN = re.compile("[^a-zÀ-ÿ]")
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is this many times as frequent as its variant.
FORM_TIMES = 5
#: One in so many (document, word) places loses a letter.
DAMAGED = 199
GROUPS = 5
BLOCK = 2048
CHUNK_CHARS = 1 << 20
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Characters of candidate pairs that are compared at the same time.
COMPARED_CHARS = 1 << 22

COLUMN = np.full(256, -1, np.int64)
COLUMN[[ord(c) for c in LETTERS]] = range(len(LETTERS))


def runs(text: str) -> Iterator[list[str]]:
    """The lower-cased letter runs of a text, a bounded number at a time; no run is cut."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = 0
    while start < len(text):
        stop = start + CHUNK_CHARS
        if stop < len(text):
            end = NOT_RUN.search(text, stop)
            stop = end.start() if end else len(text)
        yield RUN.findall(text, start, stop)
        start = stop


def damaged(run: str, seed: int, times: int = DAMAGED) -> str:
    """The run, without one letter if its hash, continued from the document's, says so."""
    h = zlib.crc32(run.encode(), seed)
    if times and h % times == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, times: int = DAMAGED) -> DataFrame:
    """(word, n): how often each word occurs in all texts."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of().alias("text"))

    def table(counts: Counter) -> pa.RecordBatch:
        held = {w: n for w, n in counts.items() if len(w) >= MIN_LENGTH}
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), slices(batch.column(1)), strict=True):
                seed, found = zlib.crc32(f"{doc_id}:".encode()), Counter()
                for part in runs(text):
                    found.update(part)
                for word, n in found.items():
                    counts[damaged(word, seed, times)] += n
                if len(counts) > HELD_WORDS:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _class_counts(word: Column) -> list[Column]:
    """How many letters of a word fall into each class; the classes deal the letters out in turn."""
    return [F.length(word) - F.length(F.translate(word, LETTERS[g::GROUPS], "")) for g in range(GROUPS)]


def _cell(counts: list[Column]) -> Column:
    return F.concat_ws(",", *counts)


def _places(counts: list[Column]) -> Column:
    """(cell, side) of every place where a word with these class counts is home (0) or visits (1).

    It visits the cells that lead here by one more letter, and those that lead
    here by one letter moved from an earlier class to a later one.
    """
    out = [F.struct(_cell(counts).alias("cell"), F.lit(0).alias("side"))]
    for later in range(GROUPS):
        fewer = [c - 1 if g == later else c for g, c in enumerate(counts)]
        for earlier in [None, *range(later)]:
            home = [c + 1 if g == earlier else c for g, c in enumerate(fewer)]
            out.append(F.when(counts[later] > 0, F.struct(_cell(home).alias("cell"), F.lit(1).alias("side"))))
    return F.filter(F.array(*out), lambda place: place.isNotNull())


def places(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(place, side, word, n): home words and visitors of every place with a block of home words."""
    counted = words.select("word", "n", *(c.alias(f"c{g}") for g, c in enumerate(_class_counts(F.col("word")))))
    counts = [F.col(f"c{g}") for g in range(GROUPS)]
    cells = counted.groupBy(_cell(counts).alias("cell")).agg(F.count(F.lit(1)).alias("words"))
    large = cells.filter(F.col("words") > block).select("cell", F.ceil(F.col("words") / block).cast("int").alias("blocks"))
    sent = counted.select("word", "n", F.explode(_places(counts)).alias("place")).select("word", "n", "place.*")
    sent = sent.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # A home word visits the earlier blocks of its own cell, so two blocks meet once.
    last = F.when(F.col("side") == 0, own).otherwise(F.col("blocks") - 1)
    sent = sent.withColumn("last", last).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    side = F.when((F.col("side") == 0) & (F.col("block") == F.col("last")), 0).otherwise(1)
    return sent.select(F.concat_ws("/", "cell", "block").alias("place"), side.alias("side"), "word", "n")


class Block:
    """Some words of one length or of two adjacent ones: characters and letter counts."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.words, self.n = words, n
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.lengths.max())
        flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        row = np.repeat(np.arange(len(words)), self.lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.chars = np.zeros((len(words), width), np.uint8)
        self.chars[row, at] = flat
        letters = len(LETTERS)
        self.counts = np.bincount(row * letters + COLUMN[flat], minlength=len(words) * letters).reshape(-1, letters)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.chars[rows], self.lengths[rows], self.n[rows]


def exact_type(length: int) -> type:
    """The number type in which a product of count matrices of such long words is exact."""
    return np.float32 if length < 2000 else np.float64 if length < 40_000_000 else np.int64


def squared_distances(a: Block, b: Block) -> np.ndarray:
    """All squared distances of letter counts, from one product: |x|^2 - 2xy + |y|^2."""
    kind = exact_type(max(a.chars.shape[1], b.chars.shape[1]))
    x, y = a.counts.astype(kind), b.counts.astype(kind)
    ones = [np.ones((len(m), 1), kind) for m in (x, y)]
    squares = [(m * m).sum(axis=1, keepdims=True) for m in (x, y)]
    return np.hstack([-2 * x, squares[0], ones[0]]) @ np.hstack([y, ones[1], squares[1]]).T


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of characters without padding: b is as long as a or one longer, and one edit away."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= a.shape[1]


def near_pairs(home: Block, other: Block) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (in home, in other) of the pairs one edit apart; a block with itself gives each pair once."""
    close = squared_distances(home, other) <= 2
    if home is other:
        close &= np.tri(len(home.words), k=-1, dtype=bool).T
    i, j = np.nonzero(close)
    length = int(home.lengths[0])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, COMPARED_CHARS // (length + 1))
    for more in (0, 1):
        there = other.lengths[j] == length + more
        p, q = i[there], j[there]
        for at in range(0, len(p), step):
            u, v = p[at : at + step], q[at : at + step]
            near = one_edit(home.chars[u], other.chars[v, : length + more])
            found.append((u[near], v[near]))
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def _meet(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows (place, side, word, n) sorted by place and side."""

    def rows(home: Block, other: Block) -> pa.RecordBatch:
        i, j = near_pairs(home, other)
        a, b = [home.words[k] for k in i], [other.words[k] for k in j]
        ends = pa.array(a + b, pa.string()), pa.array(b + a, pa.string())
        return pa.RecordBatch.from_arrays([*ends, pa.array(np.r_[other.n[j], home.n[i]])], ["word", "near", "near_n"])

    place, home, words, n = None, None, [], []
    for batch in batches:
        if not len(batch):
            continue
        key, side = batch.column(0), batch.column(1).to_numpy()
        moved = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        starts = np.r_[0, 1 + np.flatnonzero(moved | (side[1:] != side[:-1])), len(key)]
        for start, stop in zip(starts[:-1], starts[1:], strict=True):
            here = key[int(start)].as_py()
            if here != place:
                if home is None and words:
                    home = Block(words, np.array(n, np.int64))
                    yield rows(home, home)
                place, home, words, n = here, None, [], []
            if side[start] == 0:
                words += batch.column(2).slice(start, stop - start).to_pylist()
                n += batch.column(3).slice(start, stop - start).to_pylist()
                continue
            if home is None and words:
                home = Block(words, np.array(n, np.int64))
                yield rows(home, home)
            for at in range(start, stop if home else start, chunk):
                size = min(chunk, stop - at)
                other = batch.column(2).slice(at, size).to_pylist()
                yield rows(home, Block(other, batch.column(3).slice(at, size).to_numpy()))
    if home is None and words:
        home = Block(words, np.array(n, np.int64))
        yield rows(home, home)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every pair of different words one edit apart, once in each direction."""
    dealt = places(words, block).repartition("place").sortWithinPartitions("place", "side")
    return dealt.mapInArrow(lambda batches: _meet(batches, block), "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each round follows twice as many forms; counts grow along
    them at least ``FORM_TIMES``-fold, so the rounds are few."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if stepped.filter("next IS NOT NULL").isEmpty():
            return now
        now = stepped.drop("next")


def spelling_variants(
    docs: DataFrame, min_count: int = MIN_COUNT, form_times: int = FORM_TIMES, times: int = DAMAGED, block: int = BLOCK
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of ``MIN_LENGTH`` or more letters and ``min_count`` occurrences.

    A word's form is its most frequent near word, of ties the least in code point
    order, if that is ``form_times`` as frequent as the word; its root is where
    forms lead. ``times`` is how rarely a letter is deleted (0: never). Null and
    empty texts have no words. A document without id damages as one with an empty
    id. Repeated rows count each; other columns are not read. A table without such
    words gives no rows.
    """
    words = cut_lineage(word_counts(docs, times).filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= min_count)))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    met = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(met, "word", "left").withColumn("found", -F.col("best.less"))
    enough = F.col("found") >= form_times * F.col("n")
    rows = cut_lineage(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("found")).alias("form_n"),
        )
    )
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of the items' words is built once; the words of every document
are streamed through it, keeping the length of the longest suffix that occurs in
some item. Where this length reaches the window, the window's words are hit. An
item shorter than the window is a window itself.

Words that no item holds reset the automaton, so only runs of item words are
walked. The automaton of a part of the benchmark is bounded by ``PART_WORDS``;
a larger benchmark is cut into parts, which are scanned one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.llm.common import WORDS, bytes_of, fresh, slices, word_chunks

WINDOW = 10
#: Words of the items of one automaton; about 150 MB at most in a Python worker.
PART_WORDS = 200_000
#: A document of which more than this share is hit goes as a whole.
MAX_COVERAGE = 0.5


class Automaton:
    """The suffix automaton of all items, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.short: dict[tuple[bytes, ...], set[str]] = {}
        for name, words in items:
            if 0 < len(words) < window:
                self.short.setdefault(tuple(words), set()).add(name)
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[int, set[str]] = {}
        for name, words in items:
            state = length = 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= window:
                    self.items.setdefault(self.window_state(state), set()).add(name)
        self.short_lengths = sorted({len(w) for w in self.short})
        self.shortest = min([window if self.items else 1 << 30, *self.short_lengths])
        self.known = frozenset(self.next[0])

    def _extend(self, last: int, word: bytes) -> int:
        follow, link, longest = self.next, self.link, self.longest
        if word in follow[last]:
            there = follow[last][word]
            if longest[there] == longest[last] + 1:
                return there
            return self._split(last, there, word)
        new = len(follow)
        follow.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at != -1 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at != -1:
            there = follow[at][word]
            link[new] = there if longest[there] == longest[at] + 1 else self._split(at, there, word)
        return new

    def _split(self, at: int, there: int, word: bytes) -> int:
        follow, link, longest = self.next, self.link, self.longest
        copy = len(follow)
        follow.append(dict(follow[there]))
        link.append(link[there])
        longest.append(longest[at] + 1)
        link[there] = copy
        while at != -1 and follow[at].get(word) == there:
            follow[at][word] = copy
            at = link[at]
        return copy

    def step(self, state: int, length: int, word: bytes) -> tuple[int, int]:
        """The longest suffix that occurs in an item after one more word."""
        follow, link = self.next, self.link
        while state and word not in follow[state]:
            state = link[state]
            length = self.longest[state]
        there = follow[state].get(word)
        return (0, 0) if there is None else (there, length + 1)

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words."""
        while self.longest[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, raw: bytes, table: bytes = WORDS) -> tuple[int, list[list[int]], set[str]]:
        """(words, merged spans [first, end) of hit words, items with an occurring window)."""
        total, spans, found = 0, [], set()
        state = length = 0
        recent: list[bytes] = []
        runs = re.compile(rb"\x01{%d,}|\A\x01+|\x01+\Z" % min(self.shortest, 60_000))
        step, window = self.step, self.window

        def hit(end: int, size: int) -> None:
            if spans and spans[-1][1] >= end - size:
                while len(spans) > 1 and spans[-2][1] >= end - size:
                    spans.pop()
                spans[-1] = [min(spans[-1][0], end - size), end]
            else:
                spans.append([end - size, end])

        for words in word_chunks(raw, table):
            flags = bytes(map(self.known.__contains__, words))
            for run in runs.finditer(flags):
                if run.start():
                    state = length = 0
                    recent = []
                for at in range(*run.span()):
                    word = words[at]
                    state, length = step(state, length, word)
                    if self.short:
                        recent = [*recent[1 - window :], word]
                        for size in self.short_lengths:
                            if length >= size and (names := self.short.get(tuple(recent[-size:]))):
                                found |= names
                                hit(total + at + 1, size)
                    if length >= window:
                        found |= self.items[self.window_state(state)]
                        hit(total + at + 1, window)
            if flags and not flags[-1]:
                state = length = 0
                recent = []
            total += len(words)
        return total, spans, found


def benchmark_parts(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> list[Broadcast]:
    """The items' words in broadcast parts of ``part_words`` each at most.

    The driver holds one part at a time. Long items are cut, overlapping by a
    window less one, so that every window lies whole in some part.
    """
    spark = benchmark.sparkSession
    parts: list[Broadcast] = []
    now: list[tuple[str, list[bytes]]] = []
    room = part_words
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), bytes_of().alias("raw"))
    for row in rows.toLocalIterator():
        words = [w for chunk in word_chunks(bytes(row["raw"]), WORDS) for w in chunk]
        name = row["item_id"] or ""
        for start in range(0, max(1, len(words) - window + 1), part_words // 2):
            cut = words[start : start + part_words // 2 + window - 1]
            if len(cut) > room and now:
                parts.append(spark.sparkContext.broadcast(now))
                now, room = [], part_words
            if cut:
                now.append((name, cut))
                room -= len(cut)
    return [*parts, spark.sparkContext.broadcast(now)]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _scanner(parts: list[Broadcast], window: int):
    """A function from a text to (words, merged spans, items) over all parts; one automaton is held at a time."""
    held: dict[int, Automaton] = {}

    def scan(raws: list[bytes]) -> list[tuple[int, list[list[int]], set[str]]]:
        out: list[tuple[int, list[list[int]], set[str]]] = [(0, [], set())] * len(raws)
        for k, part in enumerate(parts):
            if k not in held:
                held.clear()
                held[k] = Automaton(part.value, window)
            for i, raw in enumerate(raws):
                n, spans, found = held[k].scan(raw)
                out[i] = (n, _merged(out[i][1] + spans) if out[i][1] else spans, out[i][2] | found)
        return out

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans), one row per document.

    ``spans`` are the hit stretches as ``first:end`` word numbers. Null text has
    no words; an item of no words has no window; a null item_id reads as empty.
    Repeated rows are answered each; with an empty benchmark nothing is hit.
    """
    source = docs.select("doc_id", bytes_of().alias("raw"))
    parts = benchmark_parts(benchmark, window, part_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(parts, window)
        for batch in batches:
            values = slices(batch.column(1), 64)
            rows = []
            while raws := list(islice(values, 512)):
                for n, spans, items in scan(raws):
                    hit = sum(end - first for first, end in spans)
                    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                    rows.append((n, hit, len(items), digest, hit > 0, ",".join(f"{a}:{b}" for a, b in spans)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    schema = T.StructType(
        [
            source.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()), T.StructField("spans", T.StringType()),
        ]
    )
    return source.mapInArrow(run, schema)


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(raw: bytes, spans: list[list[int]]) -> bytes:
    """The text without the given stretches of words and what stands between their words."""
    out, kept, todo = [], 0, iter(spans)
    first, end = next(todo)
    start = 0
    for i, word in enumerate(_WORD.finditer(raw)):
        if i == first:
            start = word.start()
        if i == end - 1:
            out.append(raw[kept:start])
            kept = word.end()
            first, end = next(todo, (-1, -1))
    return b"".join([*out, raw[kept:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, part_words: int = PART_WORDS
) -> DataFrame:
    """The documents without hit spans, all columns kept, ``n_chars`` counted anew.

    A document of which more than ``max_coverage`` of the words are hit goes as a
    whole. After a cut the text is scanned again until nothing is hit, as a cut
    brings words together. Documents without hits stay as they are, byte by byte.
    """
    parts = benchmark_parts(benchmark, window, part_words)

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scan = _scanner(parts, window)
        for column in batches:
            out: list[bytes | None] = []
            values = slices(column, 64)
            while raws := list(islice(values, 512)):
                texts: list[bytes | None] = [None] * len(raws)
                for i, (n, spans, _) in enumerate(scan([r or b"" for r in raws])):
                    if sum(end - first for first, end in spans) > max_coverage * n:
                        texts[i] = b"\xff"
                        continue
                    changed = raws[i]
                    while spans:
                        changed = without_spans(changed, spans)
                        _, spans, _ = scan([changed])[0]
                        texts[i] = changed
                out.extend(texts)
            yield pa.array(out, pa.binary())

    cleaned = F.arrow_udf(clean, T.BinaryType()).asNondeterministic()  # else Spark runs it once more for the filter
    mark = fresh(docs, "cleaned")
    # Null: untouched. The byte FF, which no UTF-8 text holds: the document goes.
    marked = docs.withColumn(mark, cleaned(F.col("text").cast("string").cast("binary")))
    stays = marked.filter(F.col(mark).isNull() | (F.col(mark) != F.lit(b"\xff")))
    text = F.coalesce(F.decode(F.col(mark), "UTF-8"), F.col("text"))
    out = stays.withColumn("text", text)
    if "n_chars" in docs.columns:
        counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(mark).isNotNull(), counted).otherwise(F.col("n_chars")))
    return out.drop(mark)

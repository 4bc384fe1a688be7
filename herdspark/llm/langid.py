"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of the whole text, weighted by TF-IDF and
scaled to unit length. Inverse document frequencies count every training
document. The weights are trained with the follow-the-regularised-leader update
and elastic-net penalties on a bounded sample of labelled texts; a part of the
sample is set aside to calibrate the temperature of the probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.llm.common import fresh, slices
from herdspark.session import cut_lineage

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
#: Bound of the sample: distinct texts of each language, and languages.
SAMPLE_PER_LANGUAGE = 400
MAX_LANGUAGES = 128
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
CALIBRATION_SHARE = 5
UNKNOWN = "und"
#: A document whose language is less certain than this is rejected by the filter.
MIN_SCORE = 0.3
_CHUNK = 1 << 18
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point below 2^16 as its lower-case letter; others as a space."""
    lower = (ord(chr(i).lower()[0]) if chr(i).isalpha() else 32 for i in range(1 << 16))
    return np.fromiter(lower, np.uint32, 1 << 16)


def gram_counts(text: str) -> tuple[np.ndarray, bool]:
    """(counts of hashed character n-grams, whether the text has a letter)."""
    table = _letters()
    counts = np.zeros(BUCKETS, np.int64)
    lettered = False
    tail = np.full(1, 32, np.uint32)
    for start in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[start : start + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = codes >= 1 << 16
        if wide.any():
            letters = np.where(wide, 32, table[np.where(wide, 32, codes)])
            for i in np.flatnonzero(wide):
                if chr(codes[i]).isalpha():
                    letters[i] = codes[i]
        else:
            letters = table[codes]
        lettered = lettered or bool((letters != 32).any())
        letters = np.concatenate([tail, letters])
        space = letters == 32
        keep = ~(space & np.r_[False, space[:-1]])
        letters = letters[keep]
        old = min(len(tail), len(letters))
        for n in GRAMS:
            # A chunk counts the n-grams that end in it; those of the carried tail are counted already.
            first = max(0, old - n + 1)
            size = len(letters) - n + 1 - first
            if size <= 0:
                continue
            hashed = np.full(size, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                hashed = (hashed ^ letters[first + k : first + k + size]) * _MULTIPLIERS[k]
                hashed ^= hashed >> np.uint32(15)
            counts += np.bincount(hashed & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        tail = letters[-(max(GRAMS) - 1) :]
    return counts, lettered


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, TF-IDF values of unit length)."""
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    norm = math.sqrt(float(values @ values))
    return at, values / norm if norm else values


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ``und`` and 0 without a letter."""
        if text is None or not self.languages:
            return UNKNOWN, 0.0
        counts, lettered = gram_counts(text)
        if not lettered:
            return UNKNOWN, 0.0
        at, values = weighted(counts, self.idf)
        chances = softmax((values @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def train_ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (buckets + 1, classes) of the FTRL-proximal update with L1 and L2 penalties.

    The last row is the bias. Weights whose gradient sum stays within the L1
    penalty are exactly zero.
    """
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))

    def current(rows: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(samples)):
            at, values = samples[i]
            rows, x = np.r_[at, BUCKETS], np.r_[values, 1.0]
            w = current(rows)
            error = softmax(x @ w)
            error[labels[i]] -= 1.0
            gradient = np.outer(x, error)
            square = gradient * gradient
            z[rows] += gradient - (np.sqrt(n[rows] + square) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] += square
    return current(np.arange(BUCKETS + 1))


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        chances = softmax(scores / math.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(chances, 1e-12)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id reads as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, hash) of each text with a letter; and of the task the document frequencies (null lang)."""
    frequency = np.zeros(BUCKETS, np.int64)
    documents = 0
    names = ["lang", "hash", "documents", "at", "counts"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    for batch in batches:
        rows = []
        for row, text in enumerate(slices(batch.column(0), 64)):
            counts, lettered = gram_counts(text)
            if lettered:
                frequency[np.flatnonzero(counts)] += 1
                rows.append(row)
        documents += len(rows)
        taken = pa.array(rows, pa.int64())
        empty = [pa.nulls(len(rows), k) for k in kinds[2:]]
        yield pa.RecordBatch.from_arrays([batch.column(1).take(taken), batch.column(2).take(taken), *empty], names)
    at = np.flatnonzero(frequency)
    last = (None, 0, documents, at, frequency[at])
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds, strict=True)], names)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, hash, at, counts): the n-gram counts of each text with a letter, once in a task."""
    seen: set[tuple[int, str]] = set()
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    for batch in batches:
        rows = zip(slices(batch.column(0), 64), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        for text, lang, key in rows:
            if (key, lang) in seen:
                continue
            counts, lettered = gram_counts(text)
            if lettered:
                seen.add((key, lang))
                at = np.flatnonzero(counts)
                one = zip((lang, key, at, counts[at]), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in one], ["lang", "hash", "at", "counts"])


def learn(docs: DataFrame, training: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the rows where ``training`` holds and text and lang are not null.

    The sample is the ``per_language`` distinct texts of each language with the
    smallest hashes among those with a letter; so it is the same however the
    table is partitioned, and copies count once. Its size, and that of the
    statistics brought to the driver, do not grow with the table. Only text and
    lang are learned from.
    """
    rows = docs.filter(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    learned = cut_lineage(
        keyed.mapInArrow(_frequencies, "lang string, hash bigint, documents bigint, at array<int>, counts array<bigint>")
    )
    sums = learned.filter("lang is null")
    total = sums.agg(F.sum("documents")).first()[0] or 0
    frequency = np.zeros(BUCKETS)
    for at, n in sums.select(F.explode(F.arrays_zip("at", "counts")).alias("x")).groupBy("x.at").agg(F.sum("x.counts")).collect():
        frequency[at] = n
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
    unique = cut_lineage(learned.filter("lang is not null").select("lang", "hash").distinct())
    languages = [r[0] for r in sorted(found)]
    within = F.lit(False)
    for lang in languages:
        least = [r[0] for r in unique.filter(F.col("lang") == lang).orderBy("hash").limit(per_language).select("hash").collect()]
        if least:
            within = within | ((F.col("lang") == lang) & (F.col("hash") <= least[-1]))
    texts = keyed.filter(within).mapInArrow(_sampled, "lang string, hash bigint, at array<int>, counts array<bigint>")
    chosen = texts.dropDuplicates(["lang", "hash"]).collect()
    samples, labels, aside = [], [], []
    for lang, key, at, counts in sorted(chosen, key=lambda r: (r[0], r[1])):
        values = (1.0 + np.log(np.array(counts, float))) * idf[at]
        samples.append((np.array(at), values / np.linalg.norm(values)))
        labels.append(languages.index(lang))
        aside.append(key % CALIBRATION_SHARE == 0)
    labels_, aside_ = np.array(labels, int), np.array(aside, bool)
    fitted = [s for s, a in zip(samples, aside, strict=True) if not a]
    weights = train_ftrl(fitted, labels_[~aside_], len(languages))
    scores = np.array([v @ weights[at] + weights[-1] for (at, v), a in zip(samples, aside, strict=True) if a])
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), calibrate(scores, labels_[aside_]))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document; the prediction reads the whole text only.

    ``und`` with score 0 for null texts, texts without a letter, and all texts if
    no language was learned. Repeated rows are answered each.
    """
    source = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS and MAX_LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            found = [predict(text) for text in slices(batch.column(2), 64)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    schema = T.StructType(
        [*source.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return source.mapInArrow(run, schema)


def keep_known_languages(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a language the model is sure of, all columns kept.

    Rejected are null texts, texts without a letter, and texts whose likeliest
    language has a calibrated probability below ``min_score``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def certainty(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([shared.value.predict(text)[1] for text in slices(column, 64)], pa.float64())

    score = F.arrow_udf(certainty, T.DoubleType()).asNondeterministic()
    mark = fresh(docs, "certainty")
    if not model.languages:
        return docs.filter(F.lit(False))
    return docs.withColumn(mark, score(F.col("text").cast("string"))).filter(F.col(mark) >= min_score).drop(mark)

"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from herdspark.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n string, form int"


def one_edit(a, b):
    """By trying every edit of the shorter word."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, min_count=5, form_times=5, times=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if times and h % times == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= min_count}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= form_times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out)


def found(spark, rows, parts=3, **settings):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(parts)
    result = spelling.spelling_variants(docs, **settings)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, result.collect()))


def crowd(seed, documents, letters="abé"):
    """Documents of many similar words with very uneven counts."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(300)]
    return [(i, " ".join(rng.choices(stock, [(k + 1) ** -1.3 for k in range(len(stock))], k=150))) for i in range(documents)]


@pytest.mark.parametrize("block", [3, 17, 2048])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, block, seed):
    rows = crowd(seed, 120)
    expected = plain(rows)
    assert sum(r[1] is not None for r in expected) > 5 and any(r[4] > 1 for r in expected)
    assert found(spark, rows, block=block) == expected


def test_forms_chain_to_a_root(spark):
    rows = [(1, "kitten " * 125), (2, "kittens " * 25), (3, "kittenss " * 5), (4, "mittens " * 5), (5, "kitted " * 26)]
    got = {r[0]: r for r in found(spark, rows, times=0)}
    assert got["kittenss"] == ("kittenss", "kittens", "kitten", 5, 1, 25)
    assert got["kittens"] == ("kittens", "kitten", "kitten", 25, 3, 125)
    assert got["mittens"][1:3] == ("kittens", "kitten")
    assert got["kitted"] == ("kitted", None, "kitted", 26, 1, None)
    assert sorted(got.values()) == plain(rows, times=0)


def test_ties_take_the_least_word(spark):
    rows = [(1, "zebraaa zebraab zebraac\n" * 25 + "zebraa " * 5)]
    got = {r[0]: r for r in found(spark, rows, times=0)}
    assert got["zebraa"] == ("zebraa", "zebraaa", "zebraaa", 5, 3, 25)
    assert got["zebraaa"][1] is None and got["zebraaa"][4] == 3


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  12 -- "), (None, "ÉTUDEs étudeS " * 5), (None, "ÉTUDEs " * 3), (4, "STRASSE×÷ÿ " * 9),
            (4, "STRASSE×÷ÿ " * 9), (5, "naïveté naïveté İstanbul ſtrange straße " * 6), (6, "short " * 50)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, times=3) == plain(rows, times=3)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "none")]) == []


def test_very_long_words_and_texts(spark):
    long = "ab" * 30_000
    rows = [(1, f"{long} {long}c {long[1:]} b{long[1:]} " * 5), (2, "filler words " * 200_000)]
    assert found(spark, rows, times=0) == plain(rows, times=0)


def test_runs_are_not_cut_at_chunks(monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK_CHARS", 5)
    text = "Abcdefgh ij. ÉÈklmnop 1 q"
    assert sum(spelling.runs(text), []) == ["abcdefgh", "ij", "ÉÈklmnop", "q"]


def test_products_are_exact_for_long_words():
    for size in (10, 1999, 2001, 300_000):
        words = ["a" * size, "a" * (size - 1) + "b", "ab" * (size // 2) + "a" * (size % 2), "a" * size + "b"]
        block = spelling.Block(words, np.ones(4, np.int64))
        counts = [Counter(w) for w in words]
        expected = [[sum((x[c] - y[c]) ** 2 for c in "ab") for y in counts] for x in counts]
        assert spelling.squared_distances(block, block).astype(object).tolist() == expected
    assert spelling.exact_type(40_000_000) is np.int64


def test_each_pair_meets_once(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefghé") for _ in range(rng.randint(6, 8))) for _ in range(400)})
    words += sorted({w[:3] + w[4:] for w in words if len(w) > 6} - set(words))
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    pairs = [(r["word"], r["near"]) for r in spelling.near_words(frame, 7).collect()]
    expected = {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and a != b and one_edit(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected and len(expected) > 300


def test_query_equals_brute_force(spark):
    from herdspark.llm.queries import op11_spelling_variants

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = plain(rows)
    assert len(expected) > 100
    assert sorted(map(tuple, op11_spelling_variants(spark, sf).collect())) == expected

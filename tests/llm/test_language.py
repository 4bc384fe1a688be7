"""Language identification: held-out accuracy, training method, odd rows."""

import random
from collections import Counter

import numpy as np

from herdspark.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, score string, certainty int"
SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["ción", "os", "ñe"]}


def made(rng, lang, words=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def table(spark, n=240):
    rng = random.Random(1)
    rows = [(i, made(rng, lang), lang, "x", 1) for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_held_out_accuracy_and_calibration(spark):
    df, rows = table(spark)
    model = langid.learn(df, ~langid.held_out())
    assert model.languages == sorted(SYLLABLES)
    found = {r["doc_id"]: r for r in langid.predictions(df, model).collect()}
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert 30 < len(held) < 90
    assert sum(found[r[0]]["lang_pred"] == r[2] for r in held) == len(held)
    assert all(0.5 < r["score"] <= 1 for r in found.values())
    assert (model.weights == 0).mean() > 0.5


def test_same_model_however_the_table_is_dealt(spark):
    df, _ = table(spark)
    a, b = (langid.learn(df.repartition(n), ~langid.held_out(), per_language=20) for n in (2, 7))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.idf, b.idf) and a.temperature == b.temperature


def test_odd_rows(spark):
    df, _ = table(spark)
    odd = [(None, "ka lo mi", None, "x", 1), (900, None, "aa", "x", 1), (901, "", "bb", "x", 1), (902, "12 ?! \n", "aa", "x", 1), (903, "ka", None, "x", 1), (903, "ka", None, "x", 1)]
    odd = spark.createDataFrame(odd, SCHEMA)
    model = langid.learn(df.unionAll(odd), ~langid.held_out())
    found = langid.predictions(odd, model).collect()
    assert [r["lang_pred"] for r in found] == ["aa", "und", "und", "und", "aa", "aa"]
    assert all(r["score"] == 0 for r in found if r["lang_pred"] == "und")
    left = langid.keep_known_languages(odd, model)
    assert left.columns == odd.columns and left.count() == 3
    none = langid.learn(odd.filter("lang is null"), ~langid.held_out())
    assert {(r["lang_pred"], r["score"]) for r in langid.predictions(odd, none).collect()} == {("und", 0.0)}
    assert langid.keep_known_languages(odd, none).count() == 0
    assert langid.predictions(odd.limit(0), model).count() == 0


def test_chunks_count_the_same(monkeypatch):
    text = made(random.Random(3), "cc", 300) + " 😀 𝒜bc  x 1 2 y" * 3
    whole, lettered = langid.gram_counts(text)
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(langid, "_CHUNK", size)
        counts, also = langid.gram_counts(text)
        assert np.array_equal(whole, counts) and lettered and also


def test_counts_against_plain_grams():
    letters = "".join(c.lower() if c.isalpha() else " " for c in " Ab, c12d É")
    letters = " " + letters
    while "  " in letters:
        letters = letters.replace("  ", " ")
    want = sum(max(0, len(letters) - n + 1 - (1 if n == 1 else 0)) for n in langid.GRAMS)
    assert langid.gram_counts(" Ab, c12d É")[0].sum() == want


def test_temperature():
    scores = np.array([[4.0, 0.0], [4.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    sure = langid.calibrate(scores, np.array([0, 0, 0, 1]))
    unsure = langid.calibrate(scores, np.array([0, 0, 1, 1]))
    assert sure < 1 < unsure
    assert abs(langid.softmax(np.array([4.0, 0.0]) / unsure)[0] - 0.75) < 0.01


def test_copies_and_texts_without_letters_take_no_place_in_the_sample(spark, monkeypatch):
    rng = random.Random(4)
    hot = made(rng, "aa")
    rows = [(i, hot, "aa") for i in range(3000)] + [(3000 + i, made(rng, "aa"), "aa") for i in range(40)]
    rows += [(4000 + i, f"{i} 12 ?", "bb") for i in range(3000)] + [(7000 + i, made(rng, "bb"), "bb") for i in range(15)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    taken = Counter()
    train, calibrate = langid.train_ftrl, langid.calibrate

    def training(samples, labels, classes):
        taken.update(labels.tolist())
        return train(samples, labels, classes)

    def calibrating(scores, labels):
        taken.update(labels.tolist())
        return calibrate(scores, labels)

    monkeypatch.setattr(langid, "train_ftrl", training)
    monkeypatch.setattr(langid, "calibrate", calibrating)
    model = langid.learn(df, df["doc_id"].isNotNull(), per_language=20)
    assert model.languages == ["aa", "bb"] and taken == {0: 20, 1: 15}
    texts = [made(rng, lang) for lang in ("aa", "bb") for _ in range(20)]
    assert [model.predict(t)[0] for t in texts] == ["aa"] * 20 + ["bb"] * 20

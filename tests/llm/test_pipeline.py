"""The corpus pipeline, every stage on its predecessor's result, against brute force."""

import random

import corpus_pipeline
import public_tokenizers
from tests.llm.test_decontamination import plain, words
from tests.llm.test_dedup import plain_components, plain_fingerprint
from tests.llm.test_language import made
from tests.llm.test_packing import check
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(rng):
    items = [(i, " ".join(made(rng, "aa", 14).split())) for i in range(4)]
    texts = [(made(rng, lang, rng.randrange(30, 200)), lang) for _ in range(60) for lang in [rng.choice(["aa", "bb", "cc"])]]
    texts += [texts[0]] * 4 + [texts[5]] * 2
    for t, lang in texts[10:20]:
        parts = t.split()
        parts[len(parts) // 2] = "ka"
        texts.append((" ".join(parts), lang))
    texts += [(made(rng, "aa", 60) + " " + items[1][1] + " " + made(rng, "aa", 60), "aa"), (items[2][1], "aa")]
    texts += [("1234 !!", "aa"), (None, "bb"), ("", None), (made(rng, "cc", 50), None)]
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)], items


def test_every_stage(spark, tmp_path):
    rows, items = corpus(random.Random(6))
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        results[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {n: {r["doc_id"]: r for r in results[n].collect()} for n in names[:-1]}
    assert all(results[n].columns == columns for n in names[:-1])

    known, exact, near, clean = (kept[n] for n in names[:-1])
    assert set(known) == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    last = {}
    for i in sorted(known):
        last[known[i]["text"]] = i
    assert set(exact) == set(last.values())
    prints = {i: plain_fingerprint(r["text"]) for i, r in exact.items()}
    pairs = [(i, j) for i in exact for j in exact if j < i and (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = plain_components(pairs, sorted(exact))
    assert set(near) == set(roots.values())
    for i, r in near.items():
        n, hit, *_ = plain(r["text"], items)
        assert (i in clean) == (hit <= 0.5 * n)
        if i in clean and not hit:
            assert clean[i] == r
        elif i in clean:
            assert not plain(clean[i]["text"], items)[1] and len(words(clean[i]["text"])) >= n - hit - 20
    assert len(clean) < len(near) < len(exact) < len(known) < len(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(results[names[-1]].collect(), [(i, r["text"]) for i, r in clean.items()], tokenizer)


def test_run_equals_the_stages(spark, tmp_path):
    rows, items = corpus(random.Random(7))
    folder = str(tmp_path)
    spark.createDataFrame(rows[:30], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns)
    assert {r["doc_id"] for r in found.select("doc_id").collect()} <= {r[0] for r in rows}
    assert corpus_pipeline.ORACLE_SQL is None

"""Decontamination against a plain scan of windows."""

import hashlib
import random
import re

from herdspark.llm import common, decontaminate

DOCS = "doc_id bigint, text string, n_chars bigint, spans string, cleaned string"
ITEMS = "item_id bigint, text string, raw string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window=10):
    doc, hit, named = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(len(w), window)
        for s in range(len(w) - size + 1) if w else ():
            for p in range(len(doc) - size + 1):
                if doc[p : p + size] == w[s : s + size]:
                    hit.update(range(p, p + size))
                    named.add(str(item_id) if item_id is not None else "")
    return len(doc), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def made(seed=1):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "é", "dd"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(11, 30)))) for i in range(12)]
    items += [(50, "zeta eta theta"), (51, "Zeta ETA, theta iota"), (52, ""), (53, None), (54, "uno"), (None, "nine words " * 8), (0, items[0][1])]
    docs = [" ".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(60)]
    for i in range(30):
        source = items[rng.randrange(12)][1].split()
        start = rng.randrange(len(source))
        docs.append(", ".join(["x"] * rng.randrange(5) + source[start:] + ["y"] * rng.randrange(3) + ["ZETA", "eta-theta"] + source[:start]))
    docs += [None, "", "?!", "uno", "UNO uno dos", items[0][1], items[0][1] * 2, "zeta eta", "nine words " * 9]
    return docs, items


def test_contamination(spark, monkeypatch):
    docs, items = made()
    df = spark.createDataFrame([(i, d, len(d or ""), "s", "c") for i, d in enumerate(docs)] + [(None, docs[-1], 1, "s", "c")], DOCS)
    bench = spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS)
    want = sorted([(i, *plain(d, items)) for i, d in enumerate(docs)] + [(None, *plain(docs[-1], items))], key=repr)
    for part_words in (decontaminate.PART_WORDS, 60):
        found = decontaminate.contamination(df, bench, part_words=part_words).drop("spans").collect()
        assert sorted(map(tuple, found), key=repr) == want
    assert sum(w[5] for w in want) > 20


def test_chunks(monkeypatch):
    docs, items = made(2)
    automaton = decontaminate.Automaton([(str(i), [w.encode() for w in words(t)]) for i, t in items])
    whole = [automaton.scan((d or "").encode()) for d in docs]
    for size in (1, 7, 40):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        assert [automaton.scan((d or "").encode()) for d in docs] == whole


def test_decontaminate(spark):
    docs, items = made(3)
    clean = "x1 x2 x3 " * 40
    docs += [clean, clean + items[1][1] + " and " + clean]
    df = spark.createDataFrame([(i, d, len(d or ""), "s", "c") for i, d in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS)
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns
    rows = {r["doc_id"]: r for r in left.collect()}
    for i, d in enumerate(docs):
        n, hit, *_ = plain(d, items)
        assert (i in rows) == (hit <= 0.5 * n)
        if not hit:
            assert rows[i]["text"] == d and rows[i]["n_chars"] == len(d or "")
        elif i in rows:
            assert not plain(rows[i]["text"], items)[1] and rows[i]["n_chars"] == len(rows[i]["text"])
    assert rows[len(docs) - 1]["text"].startswith(clean) and rows[len(docs) - 1]["text"].endswith("and " + clean)


def test_empty(spark):
    docs, items = made()
    df = spark.createDataFrame([(1, docs[0], 1, "s", "c")], DOCS)
    bench = spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    none = decontaminate.contamination(df, bench.limit(0)).first()
    assert none["n_hit"] == 0 and not none["contaminated"] and none["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.decontaminate(df, bench.limit(0)).first()["text"] == docs[0]

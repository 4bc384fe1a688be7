"""License, secret and personal-data scans against plain Python."""

import hashlib
import random
import re

import pytest

from herdspark.llm import common, licenses, pii, secret_scan

SCHEMA = "doc_id bigint, text string, row string, spans int, kind string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "r", 1, "k") for i, t in texts], SCHEMA)


def by_form(text, kinds):
    """Base spans by the plain patterns: leftmost, non-overlapping, failing matches dropped."""
    out = []
    for number, (kind, pattern, ok) in enumerate(kinds):
        out += [(m.start(), number, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return [s for _, _, s in sorted(out)]


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def digits(m):
    return re.sub(r"[^0-9]", "", m[0])


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def noise(rng, parts, n):
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def card(rng, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def test_personal_data_by_form(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "x.y@", "@", ".", "d.e", "1.2.3.4", "256", ".0", "00012.1.1.1", " ", "-", "+1", "(555) 1234-567", "é", "\n", "9", card(rng, 16), card(rng, 14), "+49 30 1234567", "_", "😀"]
    texts = list(enumerate(noise(rng, parts, 500) + [None, "", "1" * 500 + ".1.1.1", "4" * 40, "a" * 9000 + "@", "a@b..c", "a@b.c.d@e.f", "a@b.c_@x.y", "+" * 50 + "1 2345678901"]))
    rows = {r["doc_id"]: r for r in pii.scan(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in texts:
        want = by_form(t or "", PII)
        assert [s for s in rows[i]["spans"].split(",") if s and s.split(":")[0] in pii.KINDS] == want, repr(t)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind, _, _ in PII:
            assert rows[i][f"n_{kind}"] == sum(s.startswith(kind + ":") for s in want)


def plain_telling(texts, support, least):
    import math
    from collections import Counter, defaultdict

    words, near, around, size = Counter(), Counter(), defaultdict(set), Counter()
    for t in texts:
        words.update(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()))
        for entity, place, term, _, _ in pii.nearby_terms(t, pii.base_spans(t)):
            near[entity, term] += 1
            around[entity, term].add(place)
            size[entity] += 1
    total = sum(words.values())
    return {
        k for k, n in near.items()
        if len(around[k]) >= support
        and math.log2(total * min(n, words[k[1]]) / (words[k[1]] * size[k[0]])) / math.log2(total / size[k[0]]) >= least
    }


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "elit"]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [f"{say(6)} Zorro {say(1)} hidden.one@mail.example {say(2)} mask {say(20)}" for _ in range(6)]
    texts += [f"{say(40)} mask {say(5)}" for _ in range(60)]
    texts += ["copied words near other@mail.example again"] * 50
    assert len(plain_telling(texts, 3, pii.GENERALISE)) == 1
    for shared in (pii.MAX_SHARED_TERMS, 0):
        rows = pii.scan(frame(spark, enumerate(texts)), max_shared=shared).collect()
        told = [(r["doc_id"], s.split(":")) for r in rows for s in r["spans"].split(",") if s.startswith(("general", "removed"))]
        assert sorted(i for i, _ in told) == list(range(6))
        assert {texts[i][int(s[1]) : int(s[2])] for i, s in told} == {"Zorro"}
        assert all(r["n_terms"] == (r["doc_id"] < 6) for r in rows)
    clean = {r["doc_id"]: r for r in pii.sanitise(frame(spark, enumerate(texts))).collect()}
    assert all("Zorro" not in clean[i]["text"] and "[EMAIL]" in clean[i]["text"] for i in range(6))
    assert clean[10]["text"] == texts[10] and clean[0]["kind"] == "k"


def test_terms_are_marked_wherever_they_give_the_entity_away(spark):
    """Far from the value in its documents; and by itself where the value is not mentioned."""
    rng = random.Random(3)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "elit"]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [f"{say(30)} Zorro {say(40)} hidden.one@mail.example {say(40)} {'Fox' if i < 5 else ''} {say(5)} zorro" for i in range(6)]
    texts += [f"{say(20)} Zorro {say(20)}"] + [f"{say(20)} fox {say(20)}" for _ in range(2)]
    texts += [f"{say(40)}" for _ in range(400)] + ["copied words far away " + say(40) + " other@mail.example"] * 50
    for shared in (pii.MAX_SHARED_TERMS, 0):
        rows = pii.scan(frame(spark, enumerate(texts)), max_shared=shared).collect()
        told = sorted((r["doc_id"], texts[r["doc_id"]][int(s[1]) : int(s[2])], s[0]) for r in rows for s in [x.split(":") for x in r["spans"].split(",")] if s[0] in ("general", "removed"))
        # Fox stands in seven documents, five of them the entity's: it reveals less, and is masked only there.
        want = [(i, w, "removed") for i in range(6) for w in ("Zorro", "zorro")] + [(6, "Zorro", "removed")] + [(i, "Fox", "general") for i in range(5)]
        assert told == sorted(want)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, enumerate(texts))).collect()}
    assert all("orro" not in t for t in clean.values()) and "fox" in clean[7]


def test_words_cut_by_the_border_are_left_out():
    text = "abcdef ghi a@b.c jkl mnopqr"
    span = pii.base_spans(text)
    assert [t[2] for t in pii.nearby_terms(text, span, 6)] == ["ghi", "jkl"]
    assert [t[2] for t in pii.nearby_terms(text, span, 11)] == ["abcdef", "ghi", "jkl", "mnopqr"]


def test_secrets_by_form(spark):
    rng = random.Random(7)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", '"', "'", " ", ":", "=", "abc", "ABCD1234", "AKIA", "QWERTYUIOP12", "0123456789abcdef" * 2, "deadbeef", "é", "\n", "ſecret=12345678", "Zz9", "."]
    texts = list(enumerate(noise(rng, parts, 400) + [None, "", "password: token: abcdefgh", "token=secret=abcdefgh", "passwd=" + "a" * 5000, "x" * 20000]))
    rows = {r["doc_id"]: r for r in secret_scan.scan(frame(spark, texts)).collect()}
    for i, t in texts:
        want = by_form(t or "", SECRETS)
        assert [s for s in rows[i]["spans"].split(",") if s and s.split(":")[0] in secret_scan.BASE] == want, repr(t)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind, _, _ in SECRETS:
            assert rows[i][f"n_{kind}"] == sum(s.startswith(kind + ":") for s in want)


def plain_linked(text, scope):
    parts = []
    for number, part in enumerate(secret_scan.PARTS):
        for m in re.finditer(part.pattern, text):
            if len(m[part.group]) >= part.least and all(re.search(n, m[0]) for n in part.needs):
                parts.append((m.start(), number, m.end(), part))
    strong = [p for p in parts if p[3].strong]
    weak = [p for p in parts if not p[3].strong and not any(p[0] < s[2] and p[2] > s[0] for s in strong)]
    near = lambda a, b: b[0] <= a[2] + scope and b[2] >= a[0] - scope
    kept = strong + [w for w in weak if any(p[3].role in secret_scan.COMPLEMENTS[w[3].role] and near(w, p) for p in strong + weak)]
    return ",".join(f"{p[3].kind}:{p[0]}:{p[2]}" for p in sorted(kept, key=lambda p: p[:2]))


@pytest.mark.parametrize("scope", [0, 10, 40])
def test_weak_parts_need_a_complement(spark, scope):
    rng = random.Random(scope)
    parts = ["user: bob1 ", "login=alice ", "a@b.example ", "token=abcdefgh1 ", "Ab1" * 6 + " ", "https://h.example/x ", "10.0.0.1:80 ", "word " * 3, "x\n", "é "]
    texts = list(enumerate(["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(150)]))
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(frame(spark, texts), scope).collect()}
    assert rows == {i: plain_linked(t, scope) for i, t in texts}
    assert scope == 0 or (any("login" in s for s in rows.values()) and any("opaque" in s for s in rows.values()))


def test_weak_parts_alone_are_not_reported(spark):
    texts = [(0, "user: bob1 and a@b.example"), (1, "see https://h.example/x"), (2, "Ab1" * 6), (3, "user: bob1 " + "Ab1" * 6), (4, "user: bob1 " + "w " * 200 + "Ab1" * 6)]
    rows = {r["doc_id"]: r["n_linked"] for r in secret_scan.scan(frame(spark, texts)).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 3: 2, 4: 0}


def test_repeated_rows_and_no_rows(spark):
    texts = [(1, "token=abcdefgh1 a@b.example cc by"), (1, "token=abcdefgh1 a@b.example cc by"), (None, "AKIA0123456789AB"), (None, None)]
    df = frame(spark, texts)
    for scan, name in ((secret_scan.scan, "spans"), (pii.scan, "spans"), (licenses.scan, "labels")):
        rows = scan(df).collect()
        assert len(rows) == 4 and scan(df.limit(0)).count() == 0
        a, b = (r[name] for r in rows if r["doc_id"] == 1)
        assert a == b != ""
    assert sum(r["n_access"] for r in secret_scan.scan(df).collect()) == 1


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_license(text, k=licenses.K):
    words = words_of(text)
    base = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, best = {b[1] for b in base}, 0.0
    for label, template in licenses.TEMPLATES:
        t = template.split()
        votes = {}
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    votes.setdefault(i - j, set()).add(j)
        group, previous = set(), None
        for d in [*sorted(votes), None]:
            if previous is not None and (d is None or d - previous > licenses.DRIFT):
                share = len({p + x for p in group for x in range(k)}) / len(t)
                best = max(best, share)
                if share >= licenses.MIN_COVERAGE:
                    labels.add(label)
                group = set()
            if d is not None:
                group |= votes[d]
            previous = d
    starts = [b[0] for b in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[1] for b in base})), ",".join(sorted(labels)), 1.0 if base else best)


def made_licenses():
    rng = random.Random(11)
    texts = ["Licensed under CC BY-NC 4.0.", "all rights reserved all rights reserved", "CC\nBY", "ccby cc", None, "", "?!", "GNU General Public\u00a0License", "general public license"]
    for _ in range(150):
        out = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(words))
                change = rng.randrange(3)
                words[at : at + (change > 0)] = ["extra"] if change < 2 else []
                words = words or ["x"]
            out += ["w"] * rng.randrange(3) + words
        texts.append(rng.choice([" ", ", "]).join(out).upper())
    return texts


def test_licenses(spark):
    texts = made_licenses()
    rows = licenses.scan(frame(spark, enumerate(texts))).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    for r in rows:
        want = plain_license(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == want[:6], texts[r["doc_id"]]
        assert abs(r["score"] - want[6]) < 1e-12
    assert len({r["labels"] for r in rows}) > 10


def test_license_chunks(monkeypatch):
    finder = licenses.Finder({g[-1] for g in licenses.template_grams(licenses.TEMPLATES)})
    texts = [(t or "").encode() for t in made_licenses()]
    whole = [finder.find(t) for t in texts]
    for size in (1, 9, 33):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        assert [finder.find(t) for t in texts] == whole


def plain_telling_in_documents(texts, support, least):
    """By sets of distinct documents."""
    import math

    texts = sorted(set(texts))
    terms = [{t for t, _, _ in pii.words_outside(x, pii.base_spans(x))} for x in texts]
    held = [{pii.entity_of(x, *s) for s in pii.base_spans(x)} for x in texts]
    out = set()
    for entity in set().union(*held):
        own = [i for i, h in enumerate(held) if entity in h]
        for term in set().union(*(terms[i] for i in own)):
            both, alone = sum(term in terms[i] for i in own), sum(term in t for t in terms)
            if len(own) >= support and both >= support and len(own) < len(texts):
                if math.log2(len(texts) * both / (alone * len(own))) / math.log2(len(texts) / len(own)) >= least:
                    out.add((entity, term))
    return out


@pytest.mark.parametrize("shared", [0, 2, 100_000])
def test_document_counts_equal_brute_force(spark, shared):
    import random

    rng = random.Random(9)
    names = [f"person{k}@mail.example.org" for k in range(6)]
    words = [f"word{k}" for k in range(30)]
    texts = []
    for i in range(120):
        who = rng.choice(names) if rng.random() < 0.4 else ""
        told = f" nick{names.index(who)}" if who and rng.random() < 0.8 else ""
        texts.append(f"{' '.join(rng.choices(words, k=rng.randint(0, 12)))} {who}{' and ' if who else ''}{told} no {i % 50}")
    texts += texts[:40] + ["", "word1 person1@mail.example.orgword1"]
    expected = plain_telling_in_documents(texts, 3, pii.GENERALISE)
    assert any(term.startswith("nick") for _, term in expected)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = pii.disclosing_in_documents(docs, pii.mentions(docs), max_shared=shared).collect()
    assert {(r["entity"], r["term"]) for r in found} == expected


def test_very_many_values_in_one_text():
    import time

    text = " ".join(f"a{k}@b.example" for k in range(100_000))
    started = time.time()
    spans = pii.base_spans(text)
    assert len(spans) == 100_000 and list(pii.nearby_terms(text, spans)) == []
    assert time.time() - started < 30


def test_secrets_in_texts_of_very_many_labels(spark):
    long = "x@" + "a." * 100_000 + "a"
    local = "n" * 500 + "@host.example token=abcdefgh12"
    docs = spark.createDataFrame([(1, long), (2, local), (3, "." * 300_000), (4, "a" * 200_000 + "@")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    assert got[1]["spans"] == "" and got[2]["spans"].startswith("email:0:513,assign:514:")
    assert got[2]["n_assign"] == 1 and got[3]["spans"] == ""

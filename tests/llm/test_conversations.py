"""Conversation repair against a brute-force version."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from herdspark.llm import conversations as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit int, blank string"
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged_rows(rows):
    """The conversations after damage, by id, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2]))) for k, v in out.items()}


def labelled(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, marks):
    """Least (cost, audit) by Dijkstra over whole audits as strings, and its repaired rows."""
    legal = re.compile("(s?(ua)+)?")
    queue, settled = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, order, repaired = heapq.heappop(queue)
        if at == len(rows) and legal.fullmatch(order):
            return cost, audit, repaired
        # Equally cheap audits settle in ASCII order; only the last initial matters onward.
        if (at, order[-1:]) in settled:
            continue
        settled.add((at, order[-1:]))
        steps = []
        if at < len(rows):
            _, role, text = rows[at]
            extra = 3 * (marks[at] == "truncated")
            steps.append((4, "D", at + 1, "", ()))
            if marks[at] not in ("blank", "duplicate"):
                steps.append((extra, "K", at + 1, role[:1] or "?", ((role, text),)))
                steps += [(3 + extra, "R", at + 1, r[0], ((r, text),)) for r in ("user", "assistant")]
        steps += [(3, "I", at, r[0], ((r, ""),)) for r in ("user", "assistant")]
        for more, edit, to, initial, row in steps:
            longer = order + initial
            if re.fullmatch("(s?(ua)*(u)?)?", longer):
                heapq.heappush(queue, (cost + more, audit + edit, to, longer, repaired + row))


def plain(rows):
    out = []
    for conv, left in damaged_rows(rows).items():
        marks = labelled(left)
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, repaired = cheapest(left, marks)
        text = "\n".join(f"{role}:{text}" for role, text in repaired)
        counts = [sum(m == k for m in marks) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=3, **settings):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    got = c.repair_conversations(frame, **settings)
    assert got.columns == OUT
    return sorted(map(tuple, got.collect()), key=repr)


def chatter(seed, conversations, most=14):
    rng = random.Random(seed)
    texts = ["Hello.", "Well?", "no end", "  ", "", "Yes!\n", "a. b", "Hello.\t", "über.", None]
    roles = ["user", "assistant", "system", "tool", "User", "", None, "u", "sys"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, most)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."
            rows.append((conv, None if rng.random() < 0.1 else turn + 3 * (rng.random() < 0.1), role, text))
    return rows


@pytest.mark.parametrize("slice_rows", [1, 3, 4096])
def test_equals_brute_force(spark, slice_rows):
    rows = chatter(1, 150) + [(None, t, r, x) for _, t, r, x in chatter(2, 3)]
    expected = plain(rows)
    assert all(any(r[k] for r in expected) for k in range(1, 7))
    assert found(spark, rows, slice_rows=slice_rows) == expected


def test_a_conversation_of_many_tasks(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", f"Text {t}.", "open", ""])) for t in range(900)]
    assert found(spark, rows + chatter(5, 20), slice_rows=50) == plain(rows + chatter(5, 20))


def whole(rows, cut, modulus=c.MODULUS):
    """Cost and audit by slices of ``cut`` rows, without Spark; rows are (initial, deleted, truncated)."""
    walk, pieces = c.Walk(modulus), []
    for at in range(0, len(rows), cut):
        part = c.Slice(tuple(range(4)), modulus)
        for initial, deleted, truncated in rows[at : at + cut]:
            part.add(None, initial, deleted, False, truncated)
        summary = part.summary()
        walk.add(summary)
        pieces.append(summary["pieces"])
    counts, chosen, ending = walk.result()
    return counts["cost"], "".join(p[k] for p, k in zip(pieces, chosen, strict=True)) + ending


def test_slices_and_colliding_hashes_change_nothing():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(1, 60))]
        left = [(i, initial, "") for i, (initial, _, _) in enumerate(rows)]
        expected = cheapest(left, ["blank" if d else "truncated" if t else "" for _, d, t in rows])[:2]
        for cut in (1, 2, 7, 100):
            for modulus in (c.MODULUS, 3, 1):
                assert whole(rows, cut, modulus) == expected


def test_audits_compare_like_strings():
    rng, audits = random.Random(8), c.Audits(modulus=11)
    nodes = {0: [(0, ())]}
    for depth in range(1, 40):
        nodes[depth] = [(audits.after(n, s), (*p, s)) for n, p in rng.sample(nodes[depth - 1], min(8, len(nodes[depth - 1]))) for s in (1, 2, 5)]
        for x, a in nodes[depth]:
            assert audits.steps(x) == list(a)
            for y, b in nodes[depth]:
                assert audits.less(x, y) == (a < b) and audits.same(x, y) == (a == b)


def test_no_step_is_a_prefix_of_another():
    assert not any(a != b and b.startswith(a) for a in c.STEPS for b in c.STEPS)


def test_empty_repeated_and_long(spark):
    assert found(spark, []) == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "Gone.")]
    assert found(spark, rows) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == plain(rows)
    rows = [(1, 1, "user", "x. " * 500_000), (1, 2, "assistant", "é" * 500_000), (1, 2, "assistant", "é" * 500_000)] + [(2, 1, "user", "Again.")] * 70
    assert found(spark, rows) == plain(rows)


def test_query_equals_brute_force(spark):
    from herdspark.llm.queries import op13_conversation_repair

    sf = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, op13_conversation_repair(spark, sf).collect()), key=repr) == plain(rows)

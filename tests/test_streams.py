"""The stock ledger and the live view against brute force."""

import random
import types
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from herdspark.streaming import ledger, snapshot

FIELDS = "item_id string, seq bigint, op string, amount double, unit string, expected_quantity double, threshold double"


def rounded(value, unit):
    import math

    places = 1 if unit.strip().lower() in ("bag", "bags", "units", "unit") else 100
    return math.floor((value + 2.220446049250313e-16) * places + 0.5) / places


def brute_force(events):
    """One event after the other, in plain Python."""
    out = {}
    state = {}
    for item, seq, op, amount, unit, expected, _ in sorted(events, key=lambda e: (e[0], e[1])):
        unit = (unit or "").strip() or "kg"
        held = state.get(item)
        status = None
        if op == "set":
            if amount is None or not 0 <= amount <= 1_000_000:
                status = "rejected"
            else:
                state[item], status = (amount, unit), "updated"
        elif op not in ("increase", "decrease", "restock"):
            status = "rejected"
        elif held is None:
            status = "rejected"
        elif op == "restock" and (amount is None or amount <= 0):
            status = "rejected"
        else:
            raw = held[0] + amount if op == "restock" else held[0] * (0.9 if op == "decrease" else 1.1)
            new = rounded(max(raw, 0), held[1])
            if new > 1_000_000:
                status = "rejected"
            elif expected is None or held != (expected, unit):
                status = "stale"
            else:
                state[item], status = (new, unit), "updated"
        out[(item, seq)] = (status, state.get(item, (None, None)))
    return out


def random_events(seed, items=4, length=120):
    rng = random.Random(seed)
    events = []
    levels = [0.0, 10.0, 9.0, 11.0, 100.0, 90.0, 99.0, 999_999.0, 20.0, 8.1]
    for item in range(items):
        for seq in range(length):
            op = rng.choice(["set", "increase", "decrease", "decrease", "restock", "restock", "steal"])
            amount = rng.choice([None, 10.0, 0.0, 2.5, 1.0]) if op != "set" else rng.choice(levels + [-1.0])
            unit = rng.choice(["kg", "kg", "kg", " ", "bags"])
            events.append((f"i{item}", seq, op, amount, unit, rng.choice([None, *levels]), 10.0))
    return events


def as_dict(rows):
    return {(r["item_id"], r["seq"]): (r["status"], (r["quantity"], r["unit"])) for r in rows}


def test_ledger_equals_brute_force_for_every_slice_size(spark):
    events = random_events(7)
    table = spark.createDataFrame(events, FIELDS)
    wanted = brute_force(events)
    assert sum(s == "updated" for s, _ in wanted.values()) > 60
    for size in (1, 7, 1000):
        assert as_dict(ledger.ledger(table, slice_size=size).collect()) == wanted, size


def test_one_item_over_many_levels(spark):
    """Slices of one event, few to a node: sums of sums over several levels, also where no set ever comes again."""
    rng = random.Random(3)
    events = [("hot", 0, "set", 100.0, "kg", None, 10.0)]
    held = 100.0
    for seq in range(1, 300):
        right = rng.random() < 0.6
        op = rng.choice(["increase", "decrease"])
        events.append(("hot", seq * 7, op, None, "kg", held if right else 55.5, 10.0))
        if right:
            held = rounded(held * (0.9 if op == "decrease" else 1.1), "kg")
    events += random_events(5, items=2, length=40)
    wanted = brute_force(events)
    assert sum(s == "updated" for s, _ in wanted.values()) > 150
    table = spark.createDataFrame(events, FIELDS).repartition(6)
    for size, fan in ((1, 4), (50, 3)):
        assert as_dict(ledger.ledger(table, slice_size=size, fan=fan).collect()) == wanted


def test_empty_ledger(spark):
    assert ledger.ledger(spark.createDataFrame([], FIELDS)).collect() == []


def test_ledger_cases(spark):
    cases = [
        ("a", 1, "set", 1000.0, "kg", None, 100.0), ("a", 2, "decrease", None, "kg", 1000.0, 100.0),
        ("b", 1, "set", 1000.0, "kg", None, 100.0), ("b", 2, "increase", None, "kg", 1000.0, 100.0),
        ("c", 1, "set", 75.0, "kg", None, 100.0), ("c", 2, "restock", 25.0, "kg", 75.0, 100.0),
        ("d", 1, "set", 0.0, "kg", None, 10.0), ("d", 2, "decrease", None, "kg", 0.0, 10.0), ("d", 3, "restock", 42.5, "kg", 0.0, 10.0),
        ("e", 1, "set", 95.0, "kg", None, 10.0), ("e", 2, "decrease", None, "kg", 94.0, 10.0),
        ("f", 1, "set", 999_999.0, "kg", None, 10.0), ("f", 2, "restock", 5.0, "kg", 999_999.0, 10.0),
        ("g", 1, "decrease", None, "kg", 1.0, 10.0),
    ]
    rows = {(r["item_id"], r["seq"]): r for r in ledger.ledger(spark.createDataFrame(cases, FIELDS)).collect()}
    assert rows["a", 2]["quantity"] == 900.0 and rows["b", 2]["quantity"] == 1100.0
    assert rows["c", 2]["quantity"] == 100.0 and rows["c", 2]["stock_level"] == "Low"
    assert rows["d", 2]["quantity"] == 0.0 and rows["d", 2]["stock_level"] == "Out of Stock" and rows["d", 3]["quantity"] == 42.5
    assert (rows["e", 2]["status"], rows["e", 2]["quantity"]) == ("stale", 95.0)
    assert rows["f", 2]["error"] == "ABOVE_MAXIMUM" and rows["g", 1]["error"] == "ITEM_UNKNOWN"


def test_ledger_stream_over_several_batches(spark, tmp_path):
    events = random_events(11, items=3, length=60)
    for part in range(3):
        chunk = [e for e in events if e[1] // 20 == part]
        spark.createDataFrame(chunk, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        ledger.ledger_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert as_dict(spark.read.parquet(str(tmp_path / "out")).collect()) == brute_force(events)


def test_ordered_stream_waits_for_events_out_of_order(spark, tmp_path):
    """Batches deliver an item's events in disorder; outcomes are those of the order of time."""
    rng = random.Random(13)
    events = [(*e, 86_400 + 60 * e[1]) for e in random_events(17, items=3, length=45)]
    # Each event arrives up to 14 places late.
    arrival = sorted(events, key=lambda e: e[1] + rng.uniform(0, 14))
    batches = [arrival[k : k + 30] for k in range(0, len(arrival), 30)]
    batches.append([("end", 0, "set", 1.0, "kg", None, 10.0, 864_000)])
    made = f"{FIELDS}, t bigint"
    for rows in batches:
        frame = spark.createDataFrame(rows, made).withColumn("ts", F.timestamp_seconds("t"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get(ledger.STATE_STORE[0])
    spark.conf.set(*ledger.STATE_STORE)
    try:
        stream = spark.readStream.schema(f"{made}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        outcomes = ledger.ordered_ledger_stream(stream, "ts", "20 minutes")
        query = (
            outcomes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(ledger.STATE_STORE[0], before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert as_dict(got) == brute_force([e[:7] for e in events]) and len(got) == len(events)
    by_arrival = {}
    for batch in batches[:-1]:
        by_arrival.update(brute_force([(e[0], 1000 * i + e[1], *e[2:7]) for i, e in enumerate(batch)]))
    assert sum(s == "updated" for s, _ in by_arrival.values()) != sum(s == "updated" for s, _ in as_dict(got).values())


def test_live_view_keeps_the_newest(spark, tmp_path):
    fields = "id string, user_id string, ts timestamp, n bigint, note string"
    first = [("a", "u1", 1, "old"), ("b", "u2", 5, "b5"), ("a", "u1", 3, "new")]
    second = [("a", "u1", 2, "late"), ("b", "u2", 9, "b9"), ("c", "u1", 1, "c1")]
    for rows in (first, second):
        made = spark.createDataFrame(rows, "id string, user_id string, n bigint, note string").withColumn("ts", F.timestamp_seconds("n"))
        made.select("id", "user_id", "ts", "n", "note").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    view, progress = str(tmp_path / "view"), str(tmp_path / "cp")
    snapshot.start_live_view(stream, view, progress, "id", "ts", "n").awaitTermination()
    found = {r["id"]: r["note"] for r in snapshot.live_view(spark, view, "id", "ts", "n").collect()}
    assert found == {"a": "new", "b": "b9", "c": "c1"}
    mine = snapshot.live_view(spark, view, "id", "ts", "n", "user_id", "u1")
    assert sorted(r["id"] for r in mine.collect()) == ["a", "c"]
    packed = snapshot.compact_live_view(spark, view, str(tmp_path / "packed"), "id", "ts", "n")
    assert packed.count() == 3


def newest_of(changes):
    """Plain latest-wins over (time, sequence)."""
    held = {}
    for key, time, n, note, gone in changes:
        if key not in held or (time, n) > held[key][:2]:
            held[key] = (time, n, note, gone)
    return {k: v[2] for k, v in held.items() if not v[3]}


def delivered(spark, folder, batches):
    made = "id string, t bigint, n bigint, note string, gone boolean"
    for rows in batches:
        frame = spark.createDataFrame(rows, made).withColumn("ts", F.timestamp_seconds("t")).drop("t")
        frame.select("id", "ts", "n", "note", "gone").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id string, ts timestamp, n bigint, note string, gone boolean")
    return stream.option("maxFilesPerTrigger", 1).parquet(folder)


def test_live_view_merges_levels_within_the_stream(spark, tmp_path):
    """Versions in disorder, one record in a third of all rows, null ids and times; the levels stay below the fan."""
    rng = random.Random(23)
    changes = []
    for n in range(600):
        key = "hot" if n % 3 == 0 else rng.choice([None, *(f"k{i}" for i in range(40))])
        changes.append((key, rng.randrange(1, 500), n, f"v{n}", rng.random() < 0.2))
    batches = [changes[i : i + 40] for i in range(0, 600, 40)]
    stream = delivered(spark, str(tmp_path / "in"), batches)
    view, progress = str(tmp_path / "view"), str(tmp_path / "cp")
    snapshot.start_live_view(stream, view, progress, "id", "ts", "n", fan=3, removed="gone").awaitTermination()
    held = snapshot.generations(spark, view)[0]
    assert held.number == 15 and held.late == 0
    assert sorted((level for _, level in held.parts), reverse=True) == [level for _, level in held.parts] == [2, 1, 1]
    found = {r["id"]: r["note"] for r in snapshot.live_view(spark, view, "id", "ts", "n", removed="gone").collect()}
    assert found == newest_of(changes)
    kept = {folder for g in snapshot.generations(spark, view, 8) for folder, _ in g.parts}
    assert {p.name for p in (tmp_path / "view" / "parts").iterdir()} == kept
    assert len(list((tmp_path / "view" / "manifest").iterdir())) == 8


def test_live_view_forgets_removals_without_showing_older_versions(spark, tmp_path):
    day = 86_400
    first = [("a", 10 * day, 1, "a1", False), ("b", 10 * day, 2, "b1", False)]
    second = [("a", 11 * day, 3, "", True)]
    third = [("c", 30 * day, 4, "c1", False)]
    fourth = [("a", 10 * day + 5, 0, "too late", False), ("b", 29 * day, 5, "b2", False), ("d", 12 * day, 6, "late too", False)]
    stream = delivered(spark, str(tmp_path / "in"), [first, second, third, fourth])
    view, progress = str(tmp_path / "view"), str(tmp_path / "cp")
    query = snapshot.start_live_view(stream, view, progress, "id", "ts", "n", fan=3, removed="gone", keep_removed=timedelta(days=7))
    query.awaitTermination()
    held = snapshot.generations(spark, view)[0]
    assert held.late == 2
    rows = snapshot.live_view(spark, view, "id", "ts", "n").collect()
    assert {r["id"]: r["note"] for r in rows} == {"b": "b2", "c": "c1"}


def test_live_view_batch_that_runs_again(spark, tmp_path):
    """A stream whose last commit was lost repeats its batch; a new stream goes on in the same view."""
    batches = [[("a", 1, 1, "a1", False)], [("a", 2, 2, "a2", False), ("b", 1, 3, "b1", False)]]
    stream = delivered(spark, str(tmp_path / "in"), batches)
    view, progress = str(tmp_path / "view"), str(tmp_path / "cp")
    snapshot.start_live_view(stream, view, progress, "id", "ts", "n").awaitTermination()
    before = snapshot.generations(spark, view)[0]
    for lost in (tmp_path / "cp" / "commits").glob("*1*"):
        lost.unlink()
    snapshot.start_live_view(stream, view, progress, "id", "ts", "n").awaitTermination()
    assert snapshot.generations(spark, view)[0] == before
    snapshot.start_live_view(stream, view, str(tmp_path / "other"), "id", "ts", "n").awaitTermination()
    assert snapshot.generations(spark, view)[0].number == 4
    found = {r["id"]: r["note"] for r in snapshot.live_view(spark, view, "id", "ts", "n").collect()}
    assert found == {"a": "a2", "b": "b1"}


class _Kept:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def get(self):
        return self.held.get(None)

    def update(self, value):
        self.held[None] = value

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, *schemas):
        return self.states.setdefault(name, _Kept())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_events_wait_in_packs():
    """Few calls of the state store for many events, and the outcomes of the order of time."""
    events = random_events(5, items=1, length=6000)
    item = events[0][0]
    handle, processor = _Handle(), ledger.OrderedItem()
    processor.init(handle)
    frame = pd.DataFrame([
        {"item_id": item, "seq": e[1], "at_us": 1_000_000 * e[1], "op": e[2], "amount": e[3], "unit": e[4], "expected": e[5], "threshold": e[6], "result": 1.0,
         "problem": None, "kind": 1 if e[2] == "set" else 0, "q0": None, "u0": None, "q1": float(e[1]), "u1": "kg"} for e in events
    ])
    order = np.random.default_rng(2).permutation(len(frame))
    for part in np.array_split(order, 3):
        assert list(processor.handleInputRows((item,), iter([frame.iloc[part]]), None)) == []
    got = []
    for at in (2000, 2000, 9000):
        watermark = types.SimpleNamespace(getCurrentWatermarkInMs=lambda at=at: 1000 * at)
        if handle.timers and min(handle.timers) <= 1000 * at:
            handle.timers.remove(min(handle.timers))
            got += list(processor.handleExpiredTimer((item,), watermark, None))
    assert [len(g) for g in got] == [sum(e[1] <= 2000 for e in events), sum(e[1] > 2000 for e in events)]
    rows = pd.concat(got)
    assert rows["seq"].tolist() == sorted(e[1] for e in events) and not handle.timers
    last = None
    for seq, op, q in zip(rows["seq"], rows["op"], rows["state_quantity"], strict=True):
        assert (q is None or q != q) if last is None else q == last
        last = float(seq) if op == "set" else last
    assert handle.states["waiting"].calls < 40


def test_states_met_one_after_the_other_equal_the_chains():
    rng = np.random.default_rng(4)
    n = 500
    kind = rng.integers(0, 3, n) * (rng.random(n) < 0.9)
    kind = np.where((kind == 1) & (rng.random(n) < 0.9), 2, kind)
    rows = pd.DataFrame({
        "kind": kind, "q0": np.where(kind == 2, rng.integers(0, 3, n), np.nan), "u0": np.where(kind == 2, "kg", None),
        "q1": np.where(kind > 0, rng.integers(0, 3, n), np.nan), "u1": np.where(kind > 0, rng.choice(["kg", "l"], n), None),
        "place": np.arange(n), "start_quantity": 1.0, "start_unit": "kg",
    })
    q, u = ledger._states(rows, np.zeros(n, np.int64))
    met, units, _ = ledger._applied(zip(*(rows[c].tolist() for c in ledger.MAP_COLUMNS), strict=True), (1.0, "kg"))
    assert met == q.tolist() and units == u.tolist() and len(set(met)) > 1

"""Repair of damaged conversations by a persistent audit DP.

Edits turn a conversation's rows into a legal order of roles at least cost; of
equally cheap audits (the edits' initials in order) the least in ASCII order is
taken. The DP goes through the rows with one best audit for each state of the
role order. Audits are not strings but nodes of a tree: a node names its parent
and one more step, so audits share their prefixes. Two audits that tie are
compared by a search for their longest common prefix: nodes know their ancestors
at distances of powers of two and a rolling hash of the steps that lead to them;
equal hashes are verified.

A step is what happens up to and with one row: inserts, then the edit of the row.
No step is a prefix of another, so audits compare like their lists of steps.

Rows are sorted over all conversations by range, so a conversation of very many
rows lies on many tasks. Each task sums its rows up as slices: for each pair of
states before and after, the cost and the best audit. The same DP then walks the
slices of a conversation, where a step is the rank of an audit within its slice;
texts and audits stay out of it. Repaired texts are digested as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.llm.common import slices
from herdspark.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: crc32 of "conv_id:turn" modulo this names the damage of a row.
DAMAGES = 20
DROPPED, EMPTIED, UNENDED, REPEATED, USERED = range(5)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Inserts that complete the order at the end, by state.
ENDING = ("", "II", "I", "")
#: The steps in ASCII order; three inserts in a row lead to a state that one leads to.
STEPS = sorted("I" * k + edit for k in range(3) for edit in "DKR")
TOKEN = {step: i + 1 for i, step in enumerate(STEPS)}
SLICE_ROWS = 4096
MODULUS = (1 << 61) - 1
BASE = 1_000_003


class Audits:
    """Audits as nodes that share their prefixes; node 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.modulus = modulus
        self.step, self.hash, self.above = [0], [0], [[]]

    def after(self, node: int, step: int) -> int:
        """The audit ``node`` with one more step; ``above[n][k]`` is the ancestor 2**k steps before."""
        above = [node]
        while len(self.above[above[-1]]) >= len(above):
            above.append(self.above[above[-1]][len(above) - 1])
        self.above.append(above)
        self.step.append(step)
        self.hash.append((self.hash[node] * BASE + step) % self.modulus)
        return len(self.step) - 1

    def same(self, x: int, y: int) -> bool:
        """Whether two audits of equally many steps are equal; equal hashes are verified step by step."""
        if self.hash[x] != self.hash[y]:
            return False
        while x != y:
            if self.step[x] != self.step[y]:
                return False
            x, y = self.above[x][0], self.above[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether audit x comes before audit y of equally many steps."""
        if x == y:
            return False
        for k in reversed(range(len(self.above[x]))):
            if k < len(self.above[x]) and not self.same(self.above[x][k], self.above[y][k]):
                x, y = self.above[x][k], self.above[y][k]
        return self.step[x] < self.step[y]

    def steps(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.step[node])
            node = self.above[node][0]
        return out[::-1]


Best = dict[int, tuple[int, int]]


def advance(audits: Audits, best: Best, moves) -> Best:
    """The best (cost, audit) of each state after one step; ``moves(state)`` gives (next state, cost, step)."""
    found: dict[int, tuple[int, int, int]] = {}
    for state, (cost, node) in best.items():
        for onward, more, step in moves(state):
            new, old = (cost + more, node, step), found.get(onward)
            if old is None or new[0] < old[0]:
                found[onward] = new
            elif new[0] == old[0]:
                tied = node == old[1] or audits.same(node, old[1])
                if (step < old[2]) if tied else audits.less(node, old[1]):
                    found[onward] = new
    return {state: (cost, audits.after(node, step)) for state, (cost, node, step) in found.items()}


def row_moves(initial: str, deleted: bool, truncated: bool) -> tuple[list[tuple[int, int, int]], ...]:
    """For each state the (next state, cost, step) that one row allows."""
    out = []
    for state in range(4):
        moves, now = [], state
        for k in range(3):
            paid, inserts = k * INSERT, "I" * k
            moves.append((now, paid + DELETE, TOKEN[inserts + "D"]))
            if not deleted:
                paid += TRUNCATED * truncated
                moves.append((NEXT[now], paid + REROLE, TOKEN[inserts + "R"]))
                if (initial, now) in KEPT:
                    moves.append((KEPT[initial, now], paid, TOKEN[inserts + "K"]))
            now = NEXT[now]
        out.append(moves)
    return tuple(out)


class Slice:
    """Some rows of one conversation, one after another, summed up."""

    def __init__(self, starts: tuple[int, ...], modulus: int = MODULUS) -> None:
        self.audits = Audits(modulus)
        self.best: dict[int, Best] = {s: {s: (0, 0)} for s in starts}
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None
        self.known: dict[tuple, tuple] = {}

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        deleted = blank or duplicate
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not deleted
        if self.rows:
            self.illegal += (self.last, initial) not in LEGAL
        else:
            self.first = initial
        self.rows, self.last = self.rows + 1, initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        kind = (initial, deleted, truncated and not deleted)
        moves = self.known.get(kind) or self.known.setdefault(kind, row_moves(*kind))
        for start, best in self.best.items():
            self.best[start] = advance(self.audits, best, moves.__getitem__)

    def summary(self) -> dict:
        """The counts, and (state before, state after, cost, rank of the audit) with the audits by rank."""
        ways = [
            (start, end, cost, "".join(STEPS[t - 1] for t in self.audits.steps(node)))
            for start, best in self.best.items() for end, (cost, node) in best.items()
        ]
        pieces = sorted({way[3] for way in ways})
        rank = {piece: i for i, piece in enumerate(pieces)}
        names = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "first_turn", "last_turn")
        return {n: getattr(self, n) for n in names} | {
            "pieces": pieces, "ways": [(s, e, cost, rank[piece]) for s, e, cost, piece in ways]
        }


class Walk:
    """The slices of one conversation, one after another."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.audits, self.best = Audits(modulus), {START: (0, 0)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.slices = 0
        self.last = self.first_turn = self.last_turn = None

    def add(self, part: dict) -> None:
        ways: dict[int, list] = {}
        for start, end, cost, rank in part["ways"]:
            # A step names the audit by its rank and, to find the way back, both states; ranks decide first.
            ways.setdefault(start, []).append((end, cost, (rank << 4) + (start << 2) + end))
        self.best = advance(self.audits, self.best, lambda state: ways.get(state, ()))
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + part[name])
        self.illegal += self.slices > 0 and (self.last, part["first"]) not in LEGAL
        self.last, self.slices = part["last"], self.slices + 1
        if part["turns"]:
            self.turns -= part["first_turn"] == self.last_turn
            self.first_turn = part["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = part["last_turn"]

    def result(self) -> tuple[dict, list[int], str]:
        """The conversation's counts, the rank of the audit of each slice, and the inserts at the end."""
        ends = [(cost + INSERT * len(ENDING[s]), node, s) for s, (cost, node) in self.best.items()]
        least = min(cost for cost, _, _ in ends)
        chosen = None
        for cost, node, state in ends:
            if cost == least and (chosen is None or self.audits.less(node, chosen[0])):
                chosen = (node, state)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        counts = {"gaps": gaps, "cost": least} | {n: getattr(self, n) for n in ("blank", "duplicate", "truncated", "illegal")}
        return counts, [step >> 4 for step in self.audits.steps(chosen[0])], ENDING[chosen[1]]


def _null_is_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, sha, copies): the rows that are left, damaged as their hash says."""
    kind = F.crc32(F.concat(_null_is_space("conv_id"), F.lit(":"), _null_is_space("turn")).cast("binary")) % DAMAGES
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), _null_is_space("role").alias("role"),
        _null_is_space("text").alias("text"), kind.alias("kind"),
    ).filter(F.col("kind") != DROPPED)
    text = F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == UNENDED, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == USERED, "user").otherwise(F.col("role"))
    rows = rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.when(F.col("kind") == REPEATED, 2).otherwise(1).cast("bigint").alias("copies"),
    )
    return rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, sha, blank, truncated, copies, first): equal rows once, with their number.

    ``first`` says that no earlier row of the conversation has this role and text.
    """
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    ended = F.substring(shown, -1, 1).isin(*ENDS)
    same = rows.select("conv_id", "turn", "role", "sha", "copies", (shown == "").alias("blank"), (~ended).alias("truncated"))
    same = cut_lineage(same.groupBy("conv_id", "turn", "role", "sha", "blank", "truncated").agg(F.sum("copies").alias("copies")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = same.groupBy("conv_id", "role", "sha").agg(F.min(order).alias("least"))
    firsts = firsts.select(*(F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "sha")), F.col("least.turn").alias("f_turn"))
    match = F.lit(True)
    for name in ("conv_id", "turn", "role", "sha"):
        match = match & F.col(name).eqNullSafe(F.col(f"f_{name}"))
    return same.join(firsts, match, "left").select(*same.columns, F.col("f_sha").isNotNull().alias("first"))


SUMMARY = (
    "part int, number bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
    "first string, last string, first_turn bigint, last_turn bigint, pieces array<string>, "
    "ways array<struct<start: int, end: int, cost: bigint, rank: int>>"
)


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _summed(conv_type: T.DataType) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv_id", conv_type), *T.StructType.fromDDL(SUMMARY).fields])
    return schema, to_arrow_schema(schema)


def slice_table(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per slice of a conversation: its counts, ways and audits, in the order (part, number)."""
    keys = ["conv_id", "turn", "role", "sha"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    narrow = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "first", "copies")
    schema, arrow = _summed(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, conv, now, fresh_task = TaskContext.get().partitionId(), 0, [], None, None, True

        def done() -> dict:
            ways = now.summary()
            ways["ways"] = [dict(zip(("start", "end", "cost", "rank"), w, strict=True)) for w in ways["ways"]]
            return {"conv_id": conv, "part": part, "number": number} | ways

        for batch in batches:
            for conv_id, turn, initial, blank, truncated, first, copies in zip(*(slices(c, 4096) for c in batch.columns), strict=True):
                if now is None or conv_id != conv:
                    if now is not None:
                        held.append(done())
                        number += 1
                    # Only the first conversation of a task may have begun on another one.
                    now = Slice(tuple(range(4)) if fresh_task else (START,))
                    conv, fresh_task = conv_id, False
                for copy in range(copies):
                    if now.rows == slice_rows:
                        held.append(done())
                        number += 1
                        now = Slice(tuple(range(4)))
                    now.add(turn, initial, blank, copy > 0 or not first, truncated)
                if len(held) >= 256:
                    yield from _batches(held, arrow)
                    held = []
        if now is not None:
            held.append(done())
        yield from _batches(held, arrow)

    return narrow.mapInArrow(run, schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit_table(parts: DataFrame) -> DataFrame:
    """(conv_id, counts, audit) of every conversation that has slices."""
    conv_type = parts.schema["conv_id"].dataType
    schema = T.StructType(
        [T.StructField("conv_id", conv_type), T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()),
         T.StructField("chosen", T.IntegerType()), T.StructField("ending", T.StringType()),
         *(T.StructField(n, T.LongType()) for n in COUNTS)]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = [c for c in parts.columns if c != "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, walk, places, held = None, None, [], []

        def done() -> None:
            counts, chosen, ending = walk.result()
            for at, (place, rank) in enumerate(zip(places, chosen, strict=True)):
                row = {"conv_id": conv, "part": place[0], "number": place[1], "chosen": rank}
                held.append(row | counts | {"ending": ending} if at == 0 else row)

        for batch in batches:
            for values in zip(*(slices(c, 1024) for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if walk is None or row["conv_id"] != conv:
                    if walk is not None:
                        done()
                    conv, walk, places = row["conv_id"], Walk(), []
                row["ways"] = [tuple(w.values()) for w in row["ways"]]
                walk.add(row)
                places.append((row["part"], row["number"]))
                if len(held) >= 4096:
                    yield from _batches(held, arrow)
                    held = []
        if walk is not None:
            done()
        for at in range(0, len(held), 4096):
            yield from _batches(held[at : at + 4096], arrow)

    ordered = parts.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    chosen = ordered.mapInArrow(run, schema)
    pieces = parts.select("part", "number", "pieces")
    found = chosen.join(pieces, ["part", "number"]).withColumn("piece", F.col("pieces")[F.col("chosen")])
    listed = F.array_sort(F.collect_list(F.struct("part", "number", "piece")))
    audit = F.concat(F.array_join(F.transform(listed, lambda x: x["piece"]), ""), F.max("ending"))
    return found.groupBy("conv_id").agg(*(F.max(n).alias(n) for n in COUNTS), audit.alias("audit"))


class Repair:
    """Digests the repaired rows of one conversation as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.rows = audit, 0, START, 0
        self.digest = hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.rows else ''}{role}:".encode())
        for start in range(0, len(text), 1 << 20):
            self.digest.update(text[start : start + (1 << 20)].encode())
        self.rows += 1

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            self._write(("", "", "user", "assistant")[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = NEXT[self.state]
            self._write(("", "", "user", "assistant")[self.state], text)
        elif edit == "K":
            self.state = KEPT[role[:1], self.state]
            self._write(role, text)

    def finish(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the texts stream past their conversation's audit in order.

    One digest cannot be computed in parts, so a conversation's texts pass
    through one task, which holds the audit and a few rows at a time.
    """
    heads = audits.select("conv_id", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("turn"),
                          F.lit("").alias("role"), F.lit("").alias("sha"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("copies"))
    body = rows.select("conv_id", F.lit(1).alias("side"), "turn", "role", "sha", "text", "copies")
    keys = ["conv_id", "side", "turn", "role", "sha"]
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "side", "role", "text", "copies")
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in batches:
            held = []
            for conv_id, side, role, text, copies in zip(*(slices(c, 64) for c in batch.columns), strict=True):
                if side == 0:
                    if now is not None:
                        held.append({"conv_id": conv, "repaired_sha256": now.finish()})
                    conv, now = conv_id, Repair(text)
                for _ in range(copies):
                    now.row(role, text)
            yield from _batches(held, arrow)
        if now is not None:
            yield from _batches([{"conv_id": conv, "repaired_sha256": now.finish()}], arrow)

    return stream.mapInArrow(run, schema)


def repair_conversations(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conv_id.

    Rows are damaged first. Null roles and texts read as one space, and so do null
    ids and turns in the hash. Rows go by turn, null turns first; rows of one turn
    by role, then by the digest of the text, so equal rows are adjacent. Null ids
    form one conversation. A role whose first letter is none of s, u and a, an
    empty role included, can only be re-roled or deleted. A conversation without
    rows after the damage has zeros, an empty audit and the digest of nothing. An
    empty table gives no rows; other columns are not read.
    """
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    parts = cut_lineage(slice_table(cut_lineage(faults(rows)), slice_rows))
    audits = cut_lineage(audit_table(parts))
    digests = repaired_digests(rows, audits)

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("conv_id", name)

    out = conversations.select("conv_id").distinct()
    out = out.join(named(audits, "a_id"), F.col("conv_id").eqNullSafe(F.col("a_id")), "left")
    out = out.join(named(digests, "d_id"), F.col("conv_id").eqNullSafe(F.col("d_id")), "left")
    return out.select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in COUNTS[:-1]),
        F.coalesce("cost", F.lit(0)).cast("bigint").alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

"""Histogram gradient boosting: leaf-wise trees grown from sums over binned rows.

Features are cut into at most 255 bins once. A tree grows by its best leaves: rows
are summed up as (gradient, curvature, rows) per node, feature and bin, and the
driver finds the best splits in these sums. A step splits the best leaf and those
nearly as good, in the trees of all classes. Of two sibling nodes the smaller is
summed up; the other is what is left of their parent.

Sums are exact: gradients are whole multiples of a small unit, so the sums do
not depend on the order or the number of parts, and a fit gives the same trees
again. Rows that fall into the same bins have one score, so a block keeps them as
one with their sums (rows held for early stops stay apart); rows are collapsed before they are dealt by the hash of their bins, and
again where they meet. A step is one job over persisted blocks of rows, in no more parts than these need. A
table of one part (``TASK_ROWS`` rows at most) goes through the same steps within
its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdspark.session import checkpoint_root

MAX_BINS = 255
#: Rows whose values choose the bins, by hash; with no more rows than this every distinct value counts.
BIN_ROWS = 200_000
#: Cells that come to the driver for the bins: fewer rows if there are many features.
BIN_CELLS = 20_000_000
#: Rows of a part at least; a table of one part is boosted within its task, without a job per step.
TASK_ROWS = 131_072
#: Rows held for early stops in a part.
HELD_ROWS = 1_048_576
#: Above so many rows a tenth is set aside to stop early.
EARLY_ROWS = 10_000
CHECKPOINT_ROUNDS = 10
#: Bytes of all parts' sums that the driver adds up itself.
DIRECT_BYTES = 1 << 26
LOSS_UNIT = 2.0**-24
LEAST_GAIN = 1e-12
TINY = 1e-300


@dataclass(frozen=True)
class Settings:
    """Of the fit; ``leaf`` is the least number of rows of a leaf, ``patience`` the rounds without gain.

    One step splits the best leaf and those whose gain is at least ``eager`` of its
    gain; 1 splits one leaf after another.
    """

    rounds: int = 100
    step: float = 0.1
    leaves: int = 31
    l2: float = 0.0
    leaf: int = 20
    patience: int = 10
    tolerance: float = 1e-7
    least_curvature: float = 1e-3
    eager: float = 0.1
    depth: int | None = None


@dataclass
class Tree:
    """Splits and leaf values of one tree by node number; node 0 is the root, a leaf has no feature."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int) -> None:
        self.feature[node], self.bin[node] = feature, at
        self.left[node], self.right[node] = self.add(), self.add()


def leaf_of(tree: Tree, cells: np.ndarray, limits: list) -> np.ndarray:
    """The leaf of every row; a row goes left if its cell is at most the node's limit."""
    feature, left, right, limit = (np.asarray(c) for c in (tree.feature, tree.left, tree.right, limits))
    node = np.zeros(len(cells), np.int32)
    open_ = np.arange(len(cells)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(open_):
        at = node[open_]
        goes_left = cells[open_, feature[at]] <= limit[at]
        node[open_] = at = np.where(goes_left, left[at], right[at])
        open_ = open_[feature[at] >= 0]
    return node


@dataclass
class Loss:
    """Squared error of amounts (classes 0), or the log loss of classes; the units make sums exact."""

    classes: int
    unit: float
    start: list[float]
    #: Amounts without weights: gradients are sums of scores less sums of labels, each in whole units.
    plain: bool = False

    def slopes(self, label: np.ndarray, score: np.ndarray, weight: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(gradient, curvature) of each row for one of the trees of a round, in whole units."""
        if self.plain:
            # Of the score alone; the labels are summed up once.
            return np.rint((score[:, 0] - self.start[0]) / self.unit), np.rint(weight / self.unit)
        if not self.classes:
            slope, curve = score[:, 0] - label, np.ones(len(label))
        else:
            wanted = 1 if score.shape[1] == 1 else tree
            p = probabilities(score)[:, wanted]
            slope, curve = p - (label == wanted), p * (1 - p)
        return np.rint(slope * weight / self.unit), np.rint(curve * weight / self.unit)

    def value(self, label: np.ndarray, score: np.ndarray, weight: np.ndarray) -> float:
        """The weighted loss of some rows, in whole units."""
        if not self.classes:
            each = (score[:, 0] - label) ** 2 / 2
        else:
            p = probabilities(score)[np.arange(len(label)), label.astype(int)]
            each = -np.log(np.maximum(p, 1e-15))
        return float(np.rint(each * weight / LOSS_UNIT).sum())


def probabilities(score: np.ndarray) -> np.ndarray:
    """Class shares from raw scores; one column means two classes."""
    if score.shape[1] == 1:
        score = np.hstack([np.zeros_like(score), score])
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Rows:
    """Some binned rows with label, weight and the scores of the trees so far."""

    cells: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    held: np.ndarray
    score: np.ndarray
    times: np.ndarray  # equal rows that one stands for
    units: np.ndarray  # their labels' distance from the start in whole units, summed up

    def keys(self, plain: bool) -> np.ndarray:
        """What makes rows always have the same gradients, as bytes: the bins, and label and weight if not ``plain``."""
        parts = [self.cells] if plain else [self.cells, self.label[:, None].view(np.uint8), self.weight[:, None].view(np.uint8)]
        return np.ascontiguousarray(np.hstack(parts))

    def collapsed(self, plain: bool) -> Rows:
        """Rows of equal keys as one."""
        keys = self.keys(plain)
        known, first, at = np.unique(keys.view(f"S{keys.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return Rows(
            self.cells[first], self.label[first], self.weight[first], self.held[first], self.score[first],
            np.bincount(at, self.times, len(known)), np.bincount(at, self.units, len(known)),
        )

    def part(self, rows: np.ndarray) -> Rows:
        return Rows(*(getattr(self, c)[rows] for c in COLUMNS))

    def with_trees(self, trees: list[Tree]) -> Rows:
        score = self.score.copy()
        for k, tree in enumerate(trees):
            score[:, k] += np.asarray(tree.value)[leaf_of(tree, self.cells, tree.bin)]
        return Rows(self.cells, self.label, self.weight, self.held, score, self.times, self.units)

    def sums(self, loss: Loss, trees: list[Tree], nodes: list[list[int]], bins: int) -> np.ndarray:
        """The held rows' loss and weight, if roots are asked for, and (gradient, curvature, rows) of
        the wanted nodes of each tree by feature and bin."""
        held, out = self.held, [np.zeros(2)]
        if any(0 in wanted for wanted in nodes):
            out = [np.array([loss.value(self.label[held], self.score[held], self.weight[held]), self.weight[held].sum()])]
        width = self.cells.shape[1]
        if held.all():
            return np.concatenate([*out, np.zeros(sum(map(len, nodes)) * width * bins * 3)])
        for k, (tree, wanted) in enumerate(zip(trees, nodes, strict=True)):
            place = np.full(len(tree.feature), -1, np.int64)
            place[wanted] = np.arange(len(wanted))
            at = place[leaf_of(tree, self.cells, tree.bin)]
            rows = np.flatnonzero(~held & (at >= 0))
            at, cells = at[rows] * bins, self.cells[rows]
            slope, curve = loss.slopes(self.label[rows], self.score[rows], self.weight[rows], k)
            times = self.times[rows]
            slope = slope * times - self.units[rows]
            even = float(curve[0]) if len(rows) and (curve == curve[0]).all() else None
            curve = curve * times
            found, size = np.zeros((len(wanted), width, bins, 3)), len(wanted) * bins
            for f in range(width if len(rows) else 0):
                where = at + cells[:, f]
                found[:, f, :, 0] = np.bincount(where, slope, size).reshape(-1, bins)
                found[:, f, :, 2] = n = np.bincount(where, times, size).reshape(-1, bins)
                found[:, f, :, 1] = n * even if even is not None else np.bincount(where, curve, size).reshape(-1, bins)
            out.append(found.ravel())
        return np.concatenate(out)


COLUMNS = ("cells", "label", "weight", "held", "score", "times", "units")


def hashes(keys: np.ndarray) -> np.ndarray:
    """A hash of every row of bytes, the same in every process."""
    out = np.full(len(keys), 0xCBF29CE484222325, np.uint64)
    for k in range(keys.shape[1]):
        out = (out ^ keys[:, k]) * np.uint64(0x100000001B3)
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(33))


def _joined(parts: list[Rows]) -> Rows:
    return Rows(*(np.concatenate([getattr(b, c) for b in parts]) for c in COLUMNS))


def _blocks(own: Iterator[Rows], plain: bool) -> Iterator[Rows]:
    """Some rows as blocks of about ``TASK_ROWS``: those to learn from collapsed, the held ones apart."""
    def made(parts: list[Rows]) -> Iterator[Rows]:
        rows = _joined(parts)
        if not rows.held.all():
            yield rows.part(~rows.held).collapsed(plain)
        if rows.held.any():
            yield rows.part(rows.held)

    parts: list[Rows] = []
    for rows in own:
        parts.append(rows)
        if sum(len(b.label) for b in parts) >= TASK_ROWS:
            yield from made(parts)
            parts = []
    if parts:
        yield from made(parts)


def _merged(own: Iterator[Rows], plain: bool) -> Iterator[Rows]:
    """The rows of a part to learn from as one block, equal ones once, and the held ones as another."""
    kept, held = [], []
    for rows in own:
        (held if rows.held.all() else kept).append(rows)
    if kept:
        yield _joined(kept).collapsed(plain)
    if held:
        yield _joined(held)


def _dealt(own: Iterator[Rows], plain: bool, parts: int) -> Iterator[tuple[int, Rows]]:
    """Blocks split by the hash of their keys: equal rows meet in one part, one from each block at most. Held rows are spread evenly."""
    for number, rows in enumerate(_blocks(own, plain)):
        at = (np.arange(len(rows.label)) + number) % parts if rows.held.all() else (hashes(rows.keys(plain)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            yield int(at[some[0]]), rows.part(some)


class Steps:
    """Steps as jobs over persisted blocks; scores are brought up to date once a round."""

    def __init__(self, blocks, loss: Loss, bins: int, width: int) -> None:
        self.blocks, self.loss, self.bins, self.width, self.rounds, self.old = blocks, loss, bins, width, 0, None
        blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def sums(self, trees: list[Tree], nodes: list[list[int]]) -> np.ndarray:
        loss, bins = self.loss, self.bins
        # Small sums of few parts are added up without a stage of their own.
        small = 24 * sum(map(len, nodes)) * self.width * bins * self.blocks.getNumPartitions() <= DIRECT_BYTES

        def run(blocks: Iterator[Rows]) -> Iterator[np.ndarray]:
            total = None
            for rows in blocks:
                found = rows.sums(loss, trees, nodes, bins)
                total = found if total is None else total + found
            if total is not None:
                yield total

        found = self.blocks.mapPartitions(run).treeReduce(lambda a, b: a + b, 1 if small else 2)
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return found

    def commit(self, trees: list[Tree]) -> None:
        self.old, self.rounds = self.blocks, self.rounds + 1
        self.blocks = self.blocks.map(lambda rows: rows.with_trees(trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.rounds % CHECKPOINT_ROUNDS == 0:
            self.blocks.checkpoint()

    def close(self) -> None:
        for blocks in (self.old, self.blocks):
            if blocks is not None:
                blocks.unpersist()


class WithinTask:
    """Steps over the rows of the only part of a table, in its task."""

    def __init__(self, rows: Rows, loss: Loss, bins: int) -> None:
        self.rows, self.loss, self.bins = rows, loss, bins

    def sums(self, trees: list[Tree], nodes: list[list[int]]) -> np.ndarray:
        return self.rows.sums(self.loss, trees, nodes, self.bins)

    def commit(self, trees: list[Tree]) -> None:
        self.rows = self.rows.with_trees(trees)


def _boost_in_task(blocks, loss: Loss, settings: Settings, width: int, bins: int, early: bool) -> list[list[Tree]]:
    def task(own: Iterator[Rows]) -> Iterator[list[list[Tree]]]:
        yield boost(WithinTask(_joined(list(own)), loss, bins), loss, settings, width, bins, early)

    return blocks.mapPartitions(task).collect()[0]


class _Growing:
    """A tree, and the best splits of its leaves that can be split."""

    def __init__(self, settings: Settings, unit: float) -> None:
        self.tree, self.settings, self.unit, self.leaves = Tree(), settings, unit, 1
        self.depth = {0: 0}
        self.sums: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[float, int, int]] = {}  # gain, feature, bin

    def know(self, node: int, sums: np.ndarray) -> None:
        """Set the value of a node from its sums, and find its best split."""
        s, unit = self.settings, self.unit
        total = sums[0].sum(axis=0)
        self.tree.value[node] = float(-s.step * total[0] * unit / (total[1] * unit + s.l2 + TINY))
        left = sums.cumsum(axis=1)[:, :-1]
        right = total - left
        enough = np.minimum(left[..., 2], right[..., 2]) >= s.leaf
        enough &= np.minimum(left[..., 1], right[..., 1]) * unit >= s.least_curvature

        def strength(part: np.ndarray) -> np.ndarray:
            return (part[..., 0] * unit) ** 2 / (part[..., 1] * unit + s.l2 + TINY)

        gain = np.where(enough, strength(left) + strength(right) - strength(total), 0.0)
        at = int(gain.argmax())
        if gain.flat[at] > LEAST_GAIN and (s.depth is None or self.depth[node] < s.depth):
            self.best[node] = (float(gain.flat[at]), *divmod(at, gain.shape[1]))
            self.sums[node] = sums

    def split(self) -> list[tuple[int, int, int]]:
        """Split the best leaf and those nearly as good: (node, its smaller child, the other)."""
        room = self.settings.leaves - self.leaves
        order = sorted(self.best, key=lambda node: (-self.best[node][0], node))[:room]
        out = []
        for node in order:
            gain, feature, cut = self.best[node]
            if gain < self.settings.eager * self.best[order[0]][0]:
                break
            self.tree.split(node, feature, cut)
            few = 2 * self.sums[node][feature, : cut + 1, 2].sum() <= self.sums[node][feature, :, 2].sum()
            ends = self.tree.left[node], self.tree.right[node]
            self.depth[ends[0]] = self.depth[ends[1]] = self.depth.pop(node) + 1
            out.append((node, *(ends if few else ends[::-1])))
        for node, _, _ in out:
            del self.best[node]
        self.leaves += len(out)
        return out

    def learn(self, opened: list[tuple[int, int, int]], sums: np.ndarray) -> None:
        for (node, small, other), own in zip(opened, sums, strict=True):
            rest = self.sums.pop(node) - own
            self.know(small, own)
            self.know(other, rest)
        if self.leaves >= self.settings.leaves:
            self.best = {}


def boost(steps: Steps | WithinTask, loss: Loss, settings: Settings, width: int, bins: int, early: bool) -> list[list[Tree]]:
    """Rounds of one tree per score column; stops early when the held rows gain nothing for ``patience`` rounds."""
    count, rounds, scores = len(loss.start), [], []
    cell = width * bins * 3
    while True:
        growing = [_Growing(settings, loss.unit) for _ in range(count)]
        found = steps.sums([g.tree for g in growing], [[0]] * count)
        if early:
            scores.append(-found[0] * LOSS_UNIT / found[1] if found[1] else 0.0)
            back = settings.patience + 1
            if len(scores) > settings.patience and max(scores[-settings.patience :]) <= scores[-back] + settings.tolerance:
                return rounds
        if len(rounds) == settings.rounds:
            return rounds
        for k, g in enumerate(growing):
            g.know(0, found[2 + k * cell : 2 + (k + 1) * cell].reshape(width, bins, 3))
        while any(g.best for g in growing):
            opened = [g.split() for g in growing]
            wanted = [[small for _, small, _ in o] for o in opened]
            found, at = steps.sums([g.tree for g in growing], wanted)[2:], 0
            for g, o in zip(growing, opened, strict=True):
                size = len(o) * cell
                g.learn(o, found[at : at + size].reshape(len(o), width, bins, 3))
                at += size
        trees = [g.tree for g in growing]
        rounds.append(trees)
        if all(len(t.feature) == 1 for t in trees) or (len(rounds) == settings.rounds and not early):
            return rounds
        steps.commit(trees)


def bin_edges(values: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = MAX_BINS) -> list[np.ndarray]:
    """Upper limits of all bins but the last, per feature: between neighbouring values, or at quantiles of the sample."""
    out = []
    for f in range(len(low)):
        known = np.unique(np.concatenate([values[:, f], [low[f], high[f]]]))
        if len(known) > most:
            cut = np.quantile(np.concatenate([values[:, f], [low[f], high[f]]]), np.linspace(0, 1, most + 1)[1:-1], method="nearest")
            out.append(np.unique(cut))
        else:
            out.append(known[:-1] + (known[1:] - known[:-1]) / 2)
    return out


def learned_edges(source: DataFrame, n: int, width: int, most: int = MAX_BINS) -> list[np.ndarray]:
    """The bins of ``source``'s features ``x``, from their bounds and a bounded sample chosen by hash."""
    bounds = source.agg(*[F.array(low(F.col("x")[f]), high(F.col("x")[f])) for f in range(width) for low, high in [(F.min, F.max)]]).first()
    low, high = np.array(bounds, dtype=float).T
    share = min(BIN_ROWS, BIN_CELLS // width) / n
    drawn = source if share >= 1 else source.filter(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = drawn.select("x").toArrow().column("x").combine_chunks()
    values = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return bin_edges(values, low, high, most)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit(
    rows: DataFrame, label: str, settings: Settings, classes: int = 0, features: str = "features",
    weight: str | None = None,
) -> BoostedTrees:
    """Fit amounts, or classes numbered from 0; ``rows`` holds a vector of features.

    What comes to the driver are bounds and a bounded sample of the features, the
    label's range or class counts, and sums whose size follows nodes, features
    and bins.
    """
    source = rows.select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts = source.agg(
            F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("p"), F.max(F.size("x")).alias("most"), F.sum("w").alias("sw"),
            F.sum(F.col("w") * F.col("y")).alias("sy"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("w").alias("mw"),
        ).first()
        n, width = facts["n"], facts["p"]
        if not n or not width or width != facts["most"]:
            raise ValueError("boosting needs rows with equally many features, one at least")
        edges = learned_edges(source, n, width)
        bins = max(2, max(len(e) for e in edges) + 1)
        bits = max(8, min(30, 52 - n.bit_length()))
        if classes:
            counts = {r["y"]: r["w"] for r in source.groupBy("y").agg(F.sum("w").alias("w")).limit(classes + 1).collect()}
            shares = np.array([max(counts.get(float(k), 0.0), 1e-12) / facts["sw"] for k in range(classes)])
            start = [float(np.log(shares[1] / shares[0]))] if classes == 2 else np.log(shares).tolist()
            reach = 1.0
        else:
            start, reach = [facts["sy"] / facts["sw"]], 2.0 * (facts["high"] - facts["low"]) or 1.0
        loss = Loss(classes, reach * facts["mw"] * 2.0**-bits, start, plain=not classes and weight is None)
        early = n > EARLY_ROWS
        held = F.pmod(F.xxhash64("y", "x"), F.lit(10)) == 0 if early else F.lit(False)
        parts = max(1, min(source.rdd.getNumPartitions(), -(-n // TASK_ROWS)))

        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cells = _binned(np.stack(batch["x"].to_numpy()), edges) if len(batch) else np.zeros((0, width), np.uint8)
                yield pd.DataFrame({c: [v.tobytes()] for c, v in (
                    ("x", cells), ("y", batch["y"].to_numpy(float)), ("w", batch["w"].to_numpy(float)), ("held", batch["held"].to_numpy(bool)))})

        def unpacked(row) -> Rows:
            y, w = np.frombuffer(row["y"]), np.frombuffer(row["w"])
            score = np.tile(np.array(start), (len(y), 1))
            units = np.rint((y - start[0]) / loss.unit) if loss.plain else np.zeros(len(y))
            return Rows(np.frombuffer(row["x"], np.uint8).reshape(-1, width), y, w, np.frombuffer(row["held"], bool), score, np.ones(len(y)), units)

        packed = source.withColumn("held", held).mapInPandas(block, "x binary, y binary, w binary, held binary")
        if n <= TASK_ROWS:
            blocks = packed.repartition(1).rdd.mapPartitions(lambda own: _blocks(map(unpacked, own), loss.plain))
            rounds = _boost_in_task(blocks, loss, settings, width, bins, early)
        else:
            checkpoint_root(rows.sparkSession)
            dealt = packed.rdd.mapPartitions(lambda own: _dealt(map(unpacked, own), loss.plain, parts)).partitionBy(parts, lambda part: part)
            blocks = dealt.mapPartitions(lambda own: _merged((rows for _, rows in own), loss.plain)).persist(StorageLevel.MEMORY_AND_DISK)
            steps = None
            try:
                kept, out = blocks.map(lambda b: np.array([len(b.label), 0] if not b.held.all() else [0, len(b.label)])).treeReduce(lambda a, b: a + b).tolist()
                # No more parts than the kept rows need; held rows cost a pass once a round.
                wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-kept // TASK_ROWS), -(-out // HELD_ROWS))
                fewer = blocks.coalesce(wanted).mapPartitions(lambda own: _merged(own, loss.plain)) if wanted < parts else blocks
                steps = Steps(fewer, loss, bins, width)
                rounds = boost(steps, loss, settings, width, bins, early)
            finally:
                if steps is not None:
                    steps.close()
                blocks.unpersist()
    finally:
        source.unpersist()
    named = [[_named(tree, edges) for tree in trees] for trees in rounds]
    return BoostedTrees(model=json.dumps({"classes": classes, "start": loss.start, "rounds": named}), featuresCol=features)


def _named(tree: Tree, edges: list[np.ndarray]) -> dict:
    """A tree whose limits are values of the features."""
    limit = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin, strict=True)]
    return {"feature": tree.feature, "limit": limit, "left": tree.left, "right": tree.right, "value": tree.value}


class BoostedTrees(
    Transformer, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable
):
    """The fitted trees; predicts an amount, or class shares and the likeliest class."""

    model = Param(Params._dummy(), "model", "trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "{}", featuresCol: str = "features", predictionCol: str = "prediction") -> None:
        super().__init__()
        self._setDefault(model="{}")
        self._set(**self._input_kwargs)

    def rounds(self) -> int:
        return len(json.loads(self.getOrDefault(self.model))["rounds"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = json.loads(self.getOrDefault(self.model))
        start, classes = np.array(model["start"]), model["classes"]
        columns = [
            [(Tree(t["feature"], [], t["left"], t["right"], t["value"]), t["limit"]) for t in (r[k] for r in model["rounds"])]
            for k in range(len(start))
        ]

        def scored(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = np.stack(features.to_numpy())
            out = np.tile(start, (len(x), 1))
            for k, trees in enumerate(columns):
                for tree, limit in trees:
                    out[:, k] += np.asarray(tree.value)[leaf_of(tree, x, limit)]
            return pd.Series(list(probabilities(out) if classes else out))

        scored.__annotations__ = {"features": pd.Series, "return": pd.Series}
        found = F.pandas_udf(scored, "array<double>")(vector_to_array(self.getFeaturesCol()))
        if not classes:
            return dataset.withColumn(self.getPredictionCol(), found[0])
        rows = dataset.withColumn("__shares", found)
        best = (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double")
        rows = rows.withColumn(self.getProbabilityCol(), array_to_vector("__shares")).withColumn(self.getPredictionCol(), best)
        return rows.drop("__shares")

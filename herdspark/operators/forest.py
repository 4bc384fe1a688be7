"""Random forests over binned rows: large nodes by sums over all parts, the rest of a tree within a task.

Features are cut into at most 32 bins. Rows are dealt by the hash of their bins (their
cell), so that a cell is kept once, in one part; only a cell with more rows than a part
should have goes to several. How often a row is drawn for a tree is Poisson(1), repeated from a
seed whenever it is needed, and the drawn rows are summed up per cell: rows drawn,
weight, and weighted label or weight per class. A split depends on these sums alone.

Nodes that hold more than ``TASK_CELLS`` cells are split level by level: each
part adds up (node, feature, bin), the sums and cells of a tree are added and searched in
tasks, and only the splits come to the driver. The cells of every other node go to
one task, which grows the rest of its tree. So the work of a part follows its
rows, not the nodes of all trees.

Sums are exact: labels and weights are whole multiples of a small unit, so the same
draws give the same trees, wherever nodes are finished.
"""

from __future__ import annotations

import base64
import io
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

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

from herdspark.operators import boosting

MAX_BINS = 32
#: Cells of a node at most that one task finishes.
TASK_CELLS = 262_144
#: Rows of a part, if the table has enough parts.
PART_ROWS = 262_144
LEAST_PART_ROWS = 16_384
#: Rows that are dealt at once.
DEALT_ROWS = 131_072
#: Sums of one feature that are searched at once within a task.
SEARCHED = 2_000_000
LEAST_GAIN = 1e-12
TINY = 1e-300
#: Rows drawn by 16 random bits; the shares of Poisson(1) to 2**-16.
DRAWN = np.repeat(
    np.arange(12, dtype=np.uint8),
    np.diff(np.rint(65536 * np.cumsum([0.0, *(math.exp(-1) / math.factorial(k) for k in range(11)), 1.0])).clip(0, 65536).astype(int)),
)


@dataclass(frozen=True)
class Settings:
    """Of the fit; ``leaf`` is the least number of drawn rows of a leaf, ``subset`` the features tried per node:
    "all", "sqrt" or their share."""

    trees: int
    depth: int
    leaf: int = 1
    subset: str = "all"
    seed: int = 42

    def tried(self, width: int) -> int:
        if self.subset == "all":
            return width
        return max(1, math.ceil(math.sqrt(width) if self.subset == "sqrt" else float(self.subset) * width))


@dataclass(frozen=True)
class Shape:
    """Bins per feature, and the classes (0 for amounts)."""

    bins: tuple[int, ...]
    classes: int

    def weight(self, sums: np.ndarray) -> np.ndarray:
        """Of sums (rows, weight, weighted label) of amounts, or (rows, weight of each class); the first axis."""
        return sums[1:].sum(axis=0) if self.classes else sums[1]

    def strength(self, sums: np.ndarray) -> np.ndarray:
        squares = (sums[1:] ** 2).sum(axis=0) if self.classes else sums[2] ** 2
        weight = self.weight(sums)
        return np.divide(squares, weight, out=np.zeros_like(squares), where=weight > 0)


def parts_of(cells: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row by the hash of its cell; rows of a cell beyond twice their share of a part go to the next ones."""
    if parts == 1 or not len(cells):
        return np.zeros(len(cells), np.int64)
    hashed = boosting.hashes(cells)
    order = np.argsort(hashed, kind="stable")
    ordered = hashed[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    nth = np.arange(len(cells)) - np.repeat(first, np.diff(np.append(first, len(cells))))
    out = np.empty(len(cells), np.int64)
    out[order] = (ordered % np.uint64(parts)).astype(np.int64) + nth // max(1, 2 * len(cells) // parts)
    return out % parts


def _as_text(cells: np.ndarray) -> np.ndarray:
    """Rows of bytes as one value each; equal width keeps closing zeros apart."""
    return np.ascontiguousarray(cells).view(f"S{cells.shape[1]}").ravel()


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, sums) with every cell once."""
    cells, sums = np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts], axis=1)
    known, first, at = np.unique(_as_text(cells), return_index=True, return_inverse=True)
    return cells[first], np.stack([np.bincount(at, s, len(known)) for s in sums])


@dataclass
class Block:
    """The rows of a part: distinct cells, each row's cell, and label and weight in whole units."""

    part: int
    cells: np.ndarray
    at: np.ndarray
    label: np.ndarray
    weight: np.ndarray | None

    @classmethod
    def of(cls, part: int, cells: np.ndarray, label: np.ndarray, weight: np.ndarray | None) -> Block:
        _, first, at = np.unique(_as_text(cells), return_index=True, return_inverse=True)
        # Equal rows are alike, so this order does not depend on that of the rows.
        order = np.lexsort((label, at) if weight is None else (weight, label, at))
        return cls(part, cells[first], at[order].astype(np.int32), label[order], None if weight is None else weight[order])

    def drawn(self, seed: int, tree: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells drawn for a tree and their sums."""
        bits = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, tree, self.part]))
        times, size = DRAWN[bits.integers(0, 1 << 16, len(self.at), dtype=np.uint16)], len(self.cells)
        rows = np.bincount(self.at, times, size)
        weight = times if self.weight is None else times * self.weight
        if classes:
            sums = np.bincount(self.at * np.int64(classes) + self.label, weight, size * classes).reshape(size, classes).T
            found = np.vstack([rows, sums])
        else:
            total = rows if self.weight is None else np.bincount(self.at, weight, size)
            found = np.vstack([rows, total, np.bincount(self.at, times * self.label, size)])
        keep = np.flatnonzero(rows)
        return self.cells[keep], found[:, keep]


@dataclass
class Tree:
    """Nodes of a tree; a leaf has feature -1, the right child follows the left one. A row goes left up to the bin."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    sums: np.ndarray

    def node_of(self, cells: np.ndarray) -> np.ndarray:
        node = np.zeros(len(cells), np.int32)
        open_ = np.arange(len(cells)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            at = node[open_]
            node[open_] = at = self.left[at] + (cells[open_, self.feature[at]] > self.bin[at])
            open_ = open_[self.feature[at] >= 0]
        return node

    def grafted(self, grown: list[tuple[int, Tree]]) -> Tree:
        """With trees grown from some of the leaves."""
        parts, size = [self], len(self.feature)
        feature, cut, left = self.feature.copy(), self.bin.copy(), self.left.copy()
        for node, tree in grown:
            # The root takes the leaf's place; the others move behind the known nodes.
            if tree.feature[0] >= 0:
                feature[node], cut[node], left[node] = tree.feature[0], tree.bin[0], size
                parts.append(Tree(tree.feature[1:], tree.bin[1:], np.where(tree.feature[1:] >= 0, tree.left[1:] - 1 + size, 0), tree.sums[:, 1:]))
                size += len(tree.feature) - 1
        rest = parts[1:]
        return Tree(
            np.concatenate([feature, *(p.feature for p in rest)]), np.concatenate([cut, *(p.bin for p in rest)]),
            np.concatenate([left, *(p.left for p in rest)]).astype(np.int32), np.concatenate([p.sums for p in parts], axis=1),
        )


def tried_features(names: np.ndarray, tree: int, settings: Settings, width: int) -> np.ndarray:
    """Which features each node tries, by hashes of its name; the root is 1, the children of a node 2 and 2 + 1 times it."""
    tried = settings.tried(width)
    if tried >= width:
        return np.ones((len(names), width), bool)
    salt = np.uint64((settings.seed * 1_000_003 + tree) * width % (1 << 64))
    x = names[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(width, dtype=np.uint64) + salt) * np.uint64(0xD1B54A32D192ED03)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    out = np.zeros((len(names), width), bool)
    np.put_along_axis(out, np.argpartition(x, tried - 1, axis=1)[:, :tried], True, axis=1)
    return out


def search(
    found: Callable[[int, np.ndarray], np.ndarray], total: np.ndarray, tries: np.ndarray, shape: Shape, leaf: int
) -> tuple[np.ndarray, np.ndarray]:
    """The best split (feature or -1, bin) of every node; ``found`` gives (sums, nodes, bins) of some nodes by a feature."""
    count = total.shape[1]
    gain, feature, cut = np.zeros(count), np.full(count, -1, np.int32), np.zeros(count, np.uint8)
    base = shape.strength(total)
    for f, size in enumerate(shape.bins):
        nodes = np.flatnonzero(tries[:, f])
        if size < 2 or not len(nodes):
            continue
        left = found(f, nodes).cumsum(axis=2)[:, :, :-1]
        right = total[:, nodes, None] - left
        enough = (left[0] >= leaf) & (right[0] >= leaf)
        own = np.where(enough, shape.strength(left) + shape.strength(right) - base[nodes, None], 0.0)
        at = own.argmax(axis=1)
        best = own[np.arange(len(nodes)), at]
        better = (best > gain[nodes]) & (best > LEAST_GAIN * (best + base[nodes]))
        gain[nodes[better]], feature[nodes[better]], cut[nodes[better]] = best[better], f, at[better]
    return feature, cut


def _splittable(total: np.ndarray, shape: Shape, leaf: int) -> np.ndarray:
    enough = total[0] >= 2 * leaf
    return enough & ((total[1:] > 0).sum(axis=0) > 1) if shape.classes else enough


def grow(cells: np.ndarray, sums: np.ndarray, name: int, depth: int, tree: int, shape: Shape, settings: Settings) -> Tree:
    """Grow a tree, or the rest of one below the named node, over its cells."""
    cells, place = np.ascontiguousarray(cells.T), np.zeros(len(cells), np.int64)
    names, total, done, levels = np.array([name], np.int64), sums.sum(axis=1)[:, None], 0, []
    while True:
        count = total.shape[1]
        feature, cut, left = np.full(count, -1, np.int32), np.zeros(count, np.uint8), np.zeros(count, np.int32)
        levels.append((feature, cut, left, total))
        wanted = _splittable(total, shape, settings.leaf)
        # One cell cannot be parted.
        wanted &= np.bincount(place, minlength=count) > 1
        opened = np.flatnonzero(wanted)
        if depth >= settings.depth or not len(opened):
            break
        number = np.full(count, -1, np.int64)
        number[opened] = np.arange(len(opened))
        place = number[place]
        order = np.argsort(place, kind="stable")
        order = order[np.searchsorted(place[order], 0) :]
        cells, sums, place = cells[:, order], sums[:, order], place[order]
        tries = tried_features(names[opened], tree, settings, len(shape.bins))
        room = max(1, SEARCHED // (max(shape.bins) * len(sums)))
        for low in range(0, len(opened), room):
            high = min(low + room, len(opened))
            a, b = np.searchsorted(place, (low, high))

            def found(f: int, nodes: np.ndarray, low=low, high=high, a=a, b=b) -> np.ndarray:
                at, size = place[a:b] - low, shape.bins[f]
                if len(nodes) == high - low:
                    where, own = at * size + cells[f, a:b], sums[:, a:b]
                else:
                    rank = np.full(high - low, -1, np.int64)
                    rank[nodes] = np.arange(len(nodes))
                    at = rank[at]
                    keep = np.flatnonzero(at >= 0)
                    where, own = at[keep] * size + cells[f, a:b][keep], sums[:, a:b][:, keep]
                return np.stack([np.bincount(where, s, len(nodes) * size).reshape(-1, size) for s in own])

            part = opened[low:high]
            feature[part], cut[part] = search(found, total[:, part], tries[low:high], shape, settings.leaf)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        done, depth = done + count, depth + 1
        left[split] = done + 2 * np.arange(len(split))
        rank = np.full(count, -1, np.int64)
        rank[split] = np.arange(len(split))
        node = opened[place]
        keep = np.flatnonzero(rank[node] >= 0)
        node, cells, sums = node[keep], cells[:, keep], sums[:, keep]
        place = 2 * rank[node] + (cells[feature[node], np.arange(len(node))] > cut[node])
        names = (2 * names[split, None] + np.arange(2)).ravel()
        total = np.stack([np.bincount(place, s, 2 * len(split)) for s in sums])
    return Tree(*(np.concatenate([level[k] for level in levels], axis=-1) for k in range(4)))


@dataclass
class _Top:
    """The upper part of a tree, with the names of its nodes and those that are still to be split, and their cells."""

    tree: Tree
    names: np.ndarray
    open: np.ndarray
    cells: np.ndarray

    def depth(self, node: int) -> int:
        return int(self.names[node]).bit_length() - 1


def _sums_by_bin(block: Block, number: int, top: _Top, shape: Shape, seed: int) -> np.ndarray:
    """(sums and number of cells, open nodes, bins of all features) of a part for a tree."""
    cells, sums = block.drawn(seed, number, shape.classes)
    sums = np.vstack([sums, np.ones(len(cells))])
    place = np.full(len(top.names), -1, np.int64)
    place[top.open] = np.arange(len(top.open))
    at = place[top.tree.node_of(cells)]
    keep = np.flatnonzero(at >= 0)
    cells, sums, at = cells[keep], sums[:, keep], at[keep]
    out = []
    for f, size in enumerate(shape.bins):
        out.append(np.stack([np.bincount(at * size + cells[:, f], s, len(top.open) * size).reshape(-1, size) for s in sums]))
    return np.concatenate(out, axis=2)


def _split_level(blocks, tops: list[_Top], shape: Shape, settings: Settings) -> None:
    """One level of the open nodes of all trees: sums of all parts, searched per tree in tasks."""
    ends = np.cumsum((0, *shape.bins))
    todo = {k: top for k, top in enumerate(tops) if len(top.open)}

    def parts(own: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        for block in own:
            for number, top in todo.items():
                yield number, _sums_by_bin(block, number, top, shape, settings.seed)

    def searched(item: tuple[int, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        number, sums = item
        top, total = todo[number], sums[:, :, : ends[1]].sum(axis=2)
        tries = tried_features(top.names[top.open], number, settings, len(shape.bins))
        feature, cut = search(lambda f, nodes: sums[:-1, nodes, ends[f] : ends[f + 1]], total[:-1], tries, shape, settings.leaf)
        lefts = np.zeros_like(total)
        for k in np.flatnonzero(feature >= 0):
            lefts[:, k] = sums[:, k, ends[feature[k]] : ends[feature[k]] + cut[k] + 1].sum(axis=1)
        return number, feature, cut, np.stack([lefts, total - lefts])

    found = blocks.mapPartitions(parts).reduceByKey(lambda a, b: a + b, min(len(todo), blocks.getNumPartitions())).map(searched)
    for number, feature, cut, ends_ in found.collect():
        top = tops[number]
        tree, split = top.tree, np.flatnonzero(feature >= 0)
        nodes, first = top.open[split], len(tree.feature)
        ends_, cells = ends_[:, :-1], ends_[:, -1]
        tree.sums[:, top.open] = ends_.sum(axis=0)
        tree.feature[nodes], tree.bin[nodes] = feature[split], cut[split]
        tree.left[nodes] = first + 2 * np.arange(len(split))
        more = 2 * len(split)
        children = ends_[:, :, split].transpose(1, 2, 0).reshape(len(ends_[0]), more)  # none if no node is split
        top.tree = Tree(
            np.append(tree.feature, np.full(more, -1, np.int32)), np.append(tree.bin, np.zeros(more, np.uint8)),
            np.append(tree.left, np.zeros(more, np.int32)), np.concatenate([tree.sums, children], axis=1),
        )
        top.names = np.append(top.names, (2 * top.names[nodes, None] + np.arange(2)).ravel())
        top.open, top.cells = np.arange(first, first + more), cells[:, split].T.ravel()


def grown_trees(blocks, shape: Shape, settings: Settings, rows: int) -> list[Tree]:
    """All trees: upper levels over all parts while a node may have too many cells, the rest by node in tasks."""
    kinds = 1 + (shape.classes or 2)
    most = min(rows, blocks.map(lambda b: len(b.cells)).sum(), math.prod(shape.bins))
    root = lambda: Tree(np.full(1, -1, np.int32), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros((kinds, 1)))
    tops = [_Top(root(), np.ones(1, np.int64), np.zeros(1 if most > TASK_CELLS else 0, np.int64), np.zeros(0)) for _ in range(settings.trees)]
    level, small = 0, [[] if most > TASK_CELLS else [0] for _ in tops]
    while level < settings.depth and any(len(top.open) for top in tops):
        _split_level(blocks, tops, shape, settings)
        level += 1
        for top, rest in zip(tops, small, strict=True):
            total = top.tree.sums[:, top.open]
            wanted = _splittable(total, shape, settings.leaf) & (level < settings.depth)
            rest += top.open[wanted & (top.cells <= TASK_CELLS)].tolist()
            more = wanted & (top.cells > TASK_CELLS)
            top.open, top.cells = top.open[more], top.cells[more]
    jobs = [(number, node) for number, rest in enumerate(small) for node in rest]
    if jobs:
        by_tree = {number: (tops[number].tree, {node: k for k, (t, node) in enumerate(jobs) if t == number}) for number, rest in enumerate(small) if rest}

        def parts(own: Iterator[Block]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
            for block in own:
                for number, (tree, nodes) in by_tree.items():
                    cells, sums = block.drawn(settings.seed, number, shape.classes)
                    at = tree.node_of(cells)
                    order = np.argsort(at, kind="stable")
                    at = at[order]
                    for node, job in nodes.items():
                        own_rows = order[slice(*np.searchsorted(at, (node, node + 1)))]
                        if len(own_rows):
                            yield job, (cells[own_rows], sums[:, own_rows])

        def added(known: list, part: tuple[np.ndarray, np.ndarray] | list) -> list:
            known = known + (part if isinstance(part, list) else [part])
            # Never many more cells than are distinct.
            return [merged(known)] if len(known) > 1 and sum(len(c) for c, _ in known) > 2 * TASK_CELLS else known

        def rest_of(item: tuple[int, list]) -> tuple[int, Tree]:
            number, node = jobs[item[0]]
            cells, sums = merged(item[1])
            return item[0], grow(cells, sums, int(tops[number].names[node]), tops[number].depth(node), number, shape, settings)

        tasks = min(len(jobs), max(8 * blocks.context.defaultParallelism, len(jobs) // 8))
        grown = blocks.mapPartitions(parts).combineByKey(lambda part: [part], added, added, tasks, lambda job: job).map(rest_of).collect()
        below: dict[int, list[tuple[int, Tree]]] = {}
        for job, tree in sorted(grown, key=lambda x: x[0]):
            number, node = jobs[job]
            tops[number].tree.sums[:, node] = tree.sums[:, 0]
            below.setdefault(number, []).append((node, tree))
        for number, found in below.items():
            tops[number].tree = tops[number].tree.grafted(found)
    return [top.tree for top in tops]


def fit(
    rows: DataFrame, label: str, settings: Settings, classes: int = 0, features: str = "features", weight: str | None = None
) -> Forest:
    """Fit amounts, or classes numbered from 0; ``rows`` holds a vector of features.

    What comes to the driver are bounds and a bounded sample of the features, the
    splits of the large nodes, and the trees.
    """
    source = rows.select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = None
    try:
        facts = source.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").isNotNull() & F.col("w").isNotNull() & ~F.isnan("y") & ~F.isnan("w")).alias("known"),
            F.min(F.size("x")).alias("p"), F.max(F.size("x")).alias("most"),
            F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("w").alias("mw"),
        ).first()
        n, width = facts["n"], facts["p"]
        if not n or not width or width != facts["most"]:
            raise ValueError("a forest needs rows with equally many features, one at least")
        if facts["known"] != n:
            raise ValueError("a forest needs a label and a weight in every row")
        edges = boosting.learned_edges(source, n, width, MAX_BINS)
        shape = Shape(tuple(len(e) + 1 for e in edges), classes)
        bits = max(8, min(30, 51 - n.bit_length()))
        heavy, mean = facts["mw"] * 2.0**-bits or 1.0, 0.0 if classes else facts["mean"]
        amount = (facts["high"] - facts["low"] or 1.0) * (facts["mw"] or 1.0) * 2.0**-bits
        weighted = weight is not None
        parallel = source.sparkSession.sparkContext.defaultParallelism
        parts = max(1, -(-n // PART_ROWS), min(parallel, n // LEAST_PART_ROWS))

        def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    y, w = batch["y"].to_numpy(float), batch["w"].to_numpy(float)
                    if not classes:
                        y = np.rint((y - mean) * w / amount)
                    cells = boosting._binned(np.stack(batch["x"].to_numpy()), edges)
                    yield pd.DataFrame({"x": [cells.tobytes()], "y": [y.tobytes()], "w": [np.rint(w / heavy).tobytes() if weighted else b""]})

        def pieces(held: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, tuple[bytes, bytes, bytes]]]:
            x, y, w = (b"".join(c) for c in zip(*held, strict=True))
            cells, label, heft = np.frombuffer(x, np.uint8).reshape(-1, width), np.frombuffer(y), np.frombuffer(w)
            at = parts_of(cells, parts)
            order = np.argsort(at, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                yield int(at[own[0]]), (cells[own].tobytes(), label[own].tobytes(), heft[own].tobytes() if weighted else b"")

        def dealt(own: Iterator) -> Iterator[tuple[int, tuple[bytes, bytes, bytes]]]:
            held: list[tuple[bytes, bytes, bytes]] = []
            for r in own:
                held.append((r["x"], r["y"], r["w"]))
                if sum(len(y) for _, y, _ in held) >= 8 * DEALT_ROWS:
                    yield from pieces(held)
                    held = []
            if held:
                yield from pieces(held)

        def collapsed(part: int, own: Iterator) -> Iterator[Block]:
            held = [piece for _, piece in own]
            if held:
                x, y, w = (b"".join(c) for c in zip(*held, strict=True))
                label = np.frombuffer(y)
                yield Block.of(part, np.frombuffer(x, np.uint8).reshape(-1, width), label.astype(np.int32) if classes else label, np.frombuffer(w) if weighted else None)

        packed = source.mapInPandas(block, "x binary, y binary, w binary")
        blocks = packed.rdd.mapPartitions(dealt).partitionBy(parts, lambda part: part).mapPartitionsWithIndex(collapsed).persist(StorageLevel.MEMORY_AND_DISK)
        trees = grown_trees(blocks, shape, settings, n)
    finally:
        if blocks is not None:
            blocks.unpersist()
        source.unpersist()
    ends = np.cumsum([0, *(len(t.feature) for t in trees)])
    total = np.concatenate([t.sums for t in trees], axis=1)
    known = np.maximum(shape.weight(total), TINY)  # a tree without a drawn row has a sum of nothing
    values = (total[1:] / known).T if classes else (mean + total[2] / known * (amount / (heavy if weighted else 1.0)))[:, None]
    kept = io.BytesIO()
    np.savez(
        kept, classes=classes, ends=ends, values=values, edges=np.concatenate(edges), limits=np.cumsum([0, *(len(e) for e in edges)]),
        **{c: np.concatenate([getattr(t, c) for t in trees]) for c in ("feature", "bin", "left")},
    )
    return Forest(model=base64.b64encode(zlib.compress(kept.getvalue(), 1)).decode(), featuresCol=features)


class Forest(
    Transformer, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable
):
    """The fitted trees; predicts the mean amount, or the mean class shares and the likeliest class."""

    model = Param(Params._dummy(), "model", "trees as packed arrays", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "", featuresCol: str = "features", predictionCol: str = "prediction") -> None:
        super().__init__()
        self._setDefault(model="")
        self._set(**self._input_kwargs)

    def arrays(self) -> dict[str, np.ndarray]:
        with np.load(io.BytesIO(zlib.decompress(base64.b64decode(self.getOrDefault(self.model))))) as kept:
            return {c: kept[c] for c in kept.files}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = self.arrays()
        classes, ends, values = int(kept["classes"]), kept["ends"], kept["values"]
        edges = np.split(kept["edges"], kept["limits"][1:-1])
        trees = [Tree(*(kept[c][a:b] for c in ("feature", "bin", "left")), None) for a, b in zip(ends[:-1], ends[1:], strict=True)]

        def scored(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            cells = boosting._binned(np.stack(features.to_numpy()), edges)
            _, first, at = np.unique(_as_text(cells), return_index=True, return_inverse=True)
            cells = cells[first]
            out = np.zeros((len(cells), values.shape[1]))
            for tree, start in zip(trees, ends, strict=False):
                out += values[start + tree.node_of(cells)]
            return pd.Series(list((out / len(trees))[at]))

        scored.__annotations__ = {"features": pd.Series, "return": pd.Series}
        found = F.pandas_udf(scored, "array<double>")(vector_to_array(self.getFeaturesCol()))
        if not classes:
            return dataset.withColumn(self.getPredictionCol(), found[0])
        rows = dataset.withColumn("__shares", found)
        best = (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double")
        rows = rows.withColumn(self.getProbabilityCol(), array_to_vector("__shares")).withColumn(self.getPredictionCol(), best)
        return rows.drop("__shares")

"""Gram sums in blocks: linear models of all folds and penalties, and correlations of wide tables, from one pass.

A task turns its rows into matrices batch by batch and keeps only their products.
These leave it as rows of ``BLOCK`` numbers, which Spark adds up with partial
aggregation, so no group, fold or column pair rests on one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in a row of partial sums.
BLOCK = 32
#: Columns of a design whose products are kept; wider ones are fitted by iteration.
MAX_WIDTH = 512


def add_blocks(partial: DataFrame, keys: Sequence[str], arrays: Sequence[str], width: int = BLOCK) -> DataFrame:
    """The arrays of equal keys added up, element by element."""
    sums = [F.sum(F.col(a)[k]).alias(f"{a}_{k}") for a in arrays for k in range(width)]
    whole = [F.array(*[F.col(f"{a}_{k}") for k in range(width)]).alias(a) for a in arrays]
    return partial.groupBy(*keys).agg(*sums).select(*keys, *whole)


def padded(matrix: np.ndarray, width: int = BLOCK) -> np.ndarray:
    """A matrix with whole blocks of columns."""
    return np.pad(matrix, ((0, 0), (0, -matrix.shape[1] % width)))


@dataclass(frozen=True)
class Design:
    """The columns of a linear model before imputation and scaling.

    A constant, then for each category one flag per value and one for null, then
    for each number its distance from a fixed centre (zero where missing) and a
    flag for missing. Imputed, scaled and one-hot features of any fold are linear
    in these, so their products are too.
    """

    categories: tuple[tuple[str, tuple[str, ...]], ...]
    numbers: tuple[tuple[str, float], ...]

    @property
    def width(self) -> int:
        return 1 + sum(len(values) + 1 for _, values in self.categories) + 2 * len(self.numbers)

    def columns(self) -> list[Column]:
        """What a task reads: the place of each category's value, -1 for a value not listed, and the numbers."""
        found = []
        for i, (name, values) in enumerate(self.categories):
            text, listed = F.col(_quoted(name)).cast("string"), F.array(*[F.lit(v) for v in values]).cast("array<string>")
            place = F.when(text.isNull(), F.lit(len(values))).otherwise(F.array_position(listed, text).cast("int") - 1)
            found.append(place.alias(f"__c{i}"))
        return found + [F.col(_quoted(n)).cast("double").alias(f"__n{i}") for i, (n, _) in enumerate(self.numbers)]

    def matrix(self, batch: pa.RecordBatch, first: int) -> np.ndarray:
        """The design of a batch whose columns from ``first`` on are those of ``columns``."""
        rows = np.arange(len(batch))
        out = np.zeros((len(batch), self.width))
        out[:, 0] = 1.0
        at, column = 1, first
        for _, values in self.categories:
            place = batch.column(column).to_numpy(zero_copy_only=False)
            known = place >= 0
            out[rows[known], at + place[known]] = 1.0
            at, column = at + len(values) + 1, column + 1
        for _, centre in self.numbers:
            cells = batch.column(column)
            missing = cells.is_null().to_numpy(zero_copy_only=False)
            out[:, at] = np.where(missing, 0.0, cells.fill_null(centre).to_numpy(zero_copy_only=False) - centre)
            out[:, at + 1] = missing
            at, column = at + 2, column + 1
        return out

    def features(
        self, labels: Mapping[str, Sequence[str]], modes: Mapping[str, str], medians: Mapping[str, float],
        scales: Mapping[str, tuple[float, float]], indicators: Sequence[str],
    ) -> np.ndarray:
        """One row per feature, as weights of the design's columns; the first is the constant.

        ``labels`` are the values a fold has learned, ``scales`` the mean and deviation of scaled numbers.
        """
        rows = [np.eye(1, self.width)[0]]
        at, flags = 1, []
        for name, values in self.categories:
            for value in labels[name]:
                row = np.zeros(self.width)
                row[at + values.index(value)] = 1.0
                if value == modes.get(name):
                    row[at + len(values)] = 1.0
                rows.append(row)
            at += len(values) + 1
        for name, centre in self.numbers:
            row = np.zeros(self.width)
            row[at], row[at + 1] = 1.0, medians.get(name, 0.0) - centre
            if name in scales:
                mean, deviation = scales[name]
                row[0] = centre - mean
                row /= deviation or 1.0
            rows.append(row)
            if name in indicators:
                flags.append(np.eye(1, self.width, at + 1)[0])
            at += 2
        return np.array(rows + flags)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold_products(rows: DataFrame, design: Design, label: str, centre: float, fold: str, folds: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold from 1 to ``folds`` the design's products with itself and with the label's distance from ``centre``.

    Rows without a label take no part. The driver gets ``folds`` matrices of at most ``MAX_WIDTH`` columns.
    """
    width = design.width
    if width > MAX_WIDTH:
        raise ValueError(f"a design of {width} columns; products are kept of {MAX_WIDTH} at most")
    y = F.col(_quoted(label)).cast("double")
    source = rows.filter(y.isNotNull()).select(F.col(fold).cast("int").alias("fold"), (y - centre).alias("y"), *design.columns())

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The label is the last column, so one product holds both.
        held = np.zeros((folds + 1, width, width + 1))
        for batch in batches:
            x = design.matrix(batch, 2)
            of = batch.column(0).to_numpy(zero_copy_only=False)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for f in np.unique(of):
                own = x[of == f]
                held[f] += own.T @ np.column_stack([own, y[of == f]])
        for f in np.flatnonzero(held[:, 0, 0]):
            blocks = padded(held[f]).reshape(-1, BLOCK)
            each = len(blocks) // width
            place = np.arange(len(blocks), dtype=np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1, dtype=np.int32) * BLOCK), pa.array(blocks.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blocks), f, np.int32)), pa.array(place // each), pa.array(place % each), flat], ["fold", "i", "block", "v"]
            )

    partial = source.mapInArrow(products, "fold int, i int, block int, v array<double>")
    sums = np.zeros((folds + 1, width, (width // BLOCK + 1) * BLOCK))
    for r in add_blocks(partial, ["fold", "i", "block"], ["v"]).toLocalIterator():
        sums[r["fold"], r["i"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["v"]
    return {f: (sums[f, :, :width], sums[f, :, width]) for f in range(1, folds + 1)}


def solve(gram: np.ndarray, with_label: np.ndarray, features: np.ndarray, alpha: float, centre: float) -> np.ndarray:
    """Least squares with ``alpha`` on all weights but the constant's, as weights of the design's columns.

    Without a penalty the least weights are taken among equally good ones.
    """
    g, b = features @ gram @ features.T, features @ with_label
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    spread = g[1:, 1:] - n * np.outer(mean, mean)
    shared = b[1:] - mean * b[0]
    if alpha > 0:
        weights = np.linalg.solve(spread + alpha * np.eye(len(spread)), shared)
    else:
        weights = np.linalg.lstsq(spread, shared, rcond=1e-11)[0]
    out = weights @ features[1:]
    out[0] += centre + b[0] / n - mean @ weights
    return out


def predictions(rows: DataFrame, design: Design, fold: str, weights: Mapping[int, np.ndarray], names: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """(carried columns, fold, configuration_id, prediction): every model's prediction, in one pass over the rows.

    ``weights[f]`` holds a row of the design's weights per name, learned without fold ``f``.
    """
    held = rows.select(*carry, F.col(fold).cast("int").alias("__fold"), *design.columns())
    kept = len(carry)
    schema = held.select(*carry, "__fold", F.array().cast("array<double>").alias("__p")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = design.matrix(batch, kept + 1)
            of = batch.column(kept).to_numpy(zero_copy_only=False)
            out = np.empty((len(batch), len(names)))
            for f in np.unique(of):
                out[of == f] = x[of == f] @ weights[f].T
            found = pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(names)), pa.array(out.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], found], schema.names)

    each = F.array(*[F.struct(F.lit(n).alias("configuration_id"), F.col("__p")[i].alias("prediction")) for i, n in enumerate(names)])
    told = held.mapInArrow(predict, schema).withColumn("__e", F.explode(each))
    return told.select(*carry, F.col("__fold").alias(fold), "__e.configuration_id", "__e.prediction")

"""Forests: the same trees wherever nodes are finished, splits against a plain version, weights and classes."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from herdspark.operators import forest
from herdspark.operators import modeling as m

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType())])


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 40, 1200), rng.integers(0, 30, 1200), rng.integers(0, 2, 1200)]).astype(float)
    return x, np.sin(x[:, 0] / 5) * 3 + x[:, 1] * x[:, 2] + rng.normal(size=1200) * 0.1


@pytest.fixture(scope="module")
def frame(spark, numbers):
    x, y = numbers
    return spark.createDataFrame([(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], SCHEMA).coalesce(2).persist()


def predicted(model, rows):
    return np.array([r["prediction"] for r in model.transform(rows).orderBy("id").collect()])


def plain_tree(cells, draws, y, leaf, depth):
    """The mean of each row's leaf, by trying every limit of every feature."""
    def leaves(rows, depth):
        n = draws[rows].sum()
        best, ends = 1e-9, None
        total = (draws[rows] * y[rows]).sum()
        for f in range(cells.shape[1]) if depth else ():
            for cut in range(31):
                left = cells[rows, f] <= cut
                a, b = draws[rows][left].sum(), draws[rows][~left].sum()
                if min(a, b) < leaf:
                    continue
                s = (draws[rows] * y[rows])[left].sum()
                gain = s * s / a + (total - s) ** 2 / b - total * total / n
                if gain > best:
                    best, ends = gain, (rows[left], rows[~left])
        return [(rows, total / n)] if ends is None else leaves(ends[0], depth - 1) + leaves(ends[1], depth - 1)

    out = np.zeros(len(y))
    for rows, value in leaves(np.arange(len(y)), depth):
        out[rows] = value
    return out


def test_a_tree_equals_the_plain_version(numbers):
    x, y = numbers
    cells = np.minimum(x, 31).astype(np.uint8)
    label = np.rint((y - y.mean()) * 2**20)
    block = forest.Block.of(0, cells, label, None)
    draws = forest.DRAWN[np.random.Generator(np.random.Philox(key=3, counter=[0, 0, 2, 0])).integers(0, 1 << 16, len(y), dtype=np.uint16)]
    shape, settings = forest.Shape((32, 32, 32), 0), forest.Settings(1, 5, 8, seed=3)
    tree = forest.grow(*block.drawn(3, 2, 0), 1, 0, 2, shape, settings)
    ordered = block.cells[block.at]
    at = tree.node_of(ordered)
    assert np.allclose(tree.sums[2][at] / tree.sums[1][at], plain_tree(ordered, draws, block.label, 8, 5))


def test_draws_are_poisson():
    assert len(forest.DRAWN) == 65536
    assert abs(forest.DRAWN.mean() - 1) < 1e-3 and abs(forest.DRAWN.var() - 1) < 2e-3


@pytest.mark.parametrize("subset", ["all", "0.6", "sqrt"])
def test_the_same_trees_wherever_nodes_are_finished(frame, monkeypatch, subset):
    """Levels over all parts and rests within tasks, or whole trees within tasks."""
    settings = forest.Settings(4, 7, 3, subset)
    monkeypatch.setattr(forest, "PART_ROWS", 400)
    whole = forest.fit(frame, "y", settings)
    monkeypatch.setattr(forest, "TASK_CELLS", 90)
    parted = forest.fit(frame, "y", settings)
    monkeypatch.setattr(forest, "TASK_CELLS", 0)
    levels = forest.fit(frame, "y", settings)
    assert len(whole.arrays()["ends"]) == 5 and len(whole.arrays()["feature"]) > 100
    for other in (parted, levels):
        assert np.array_equal(predicted(other, frame), predicted(whole, frame))


def test_rows_of_a_cell_meet_in_one_part(spark, monkeypatch):
    """A cell is kept once, whatever the parts; only one with too many rows goes to several, and no part gets most of it."""
    monkeypatch.setattr(forest, "PART_ROWS", 100)
    held, grown = [], forest.grown_trees
    monkeypatch.setattr(forest, "grown_trees", lambda blocks, *rest: held.extend(blocks.map(lambda x: (len(x.cells), len(x.at))).collect()) or grown(blocks, *rest))
    rows = spark.createDataFrame([(i, Vectors.dense([i % 10, i // 10 % 5]), float(i)) for i in range(1200)], SCHEMA).coalesce(2)
    forest.fit(rows, "y", forest.Settings(2, 3))
    assert sum(cells for cells, _ in held) == 50 and sum(n for _, n in held) == 1200
    hot = np.zeros((9000, 3), np.uint8)
    hot[:3000, 0] = np.arange(3000) % 200
    assert np.bincount(forest.parts_of(hot, 30), minlength=30).max() <= 1000
    assert set(forest.parts_of(hot, 1)) == {0}


def test_a_level_without_a_split(frame, monkeypatch):
    """Nodes that are split over all parts may find no gain in any feature."""
    monkeypatch.setattr(forest, "TASK_CELLS", 0)
    model = forest.fit(frame.selectExpr("id", "features", "7D AS y"), "y", forest.Settings(3, 5))
    assert len(model.arrays()["feature"]) == 3 and set(predicted(model, frame)) == {7.0}


def test_it_learns_and_is_saved(frame, numbers, tmp_path):
    x, y = numbers
    model = forest.fit(frame, "y", forest.Settings(20, 12, 2, "0.8"))
    assert 1 - ((predicted(model, frame) - y) ** 2).mean() / y.var() > 0.97
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    assert np.array_equal(predicted(PipelineModel.load(str(tmp_path / "m")), frame), predicted(model, frame))
    assert model.transform(frame.filter("id < 0")).collect() == []


def test_few_rows_and_odd_labels(spark, frame):
    one = frame.filter("id < 1")
    assert np.allclose(predicted(forest.fit(one, "y", forest.Settings(9, 4)), one), [r["y"] for r in one.collect()])
    with pytest.raises(ValueError, match="needs rows"):
        forest.fit(frame.filter("id < 0"), "y", forest.Settings(2, 3))
    with pytest.raises(ValueError, match="needs a label"):
        forest.fit(frame.selectExpr("id", "features", "if(id = 3, null, y) AS y"), "y", forest.Settings(2, 3))


def test_classes_and_weights(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3))
    names = np.array(["high", "low", "mid"])[np.where(x[:, 0] + 0.2 * x[:, 1] > 0.6, 0, np.where(x[:, 0] < -0.4, 1, 2))]
    rows = spark.createDataFrame([(i, *map(float, v), str(n)) for i, (v, n) in enumerate(zip(x, names, strict=True))], "id int, a double, b double, c double, kind string")
    features = m.Features((), ("a", "b", "c"))
    candidate = m.Candidate("f", "forest", {"trees": 15, "depth": 8, "leaf": 1, "subset": "sqrt"})
    got = m.fit_candidate(rows, features, "kind", candidate, "id", classification=True).predict(rows).select("kind", "predicted_label", "probability").collect()
    assert sum(r["kind"] == r["predicted_label"] for r in got) > 850
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in got)
    heavy = rows.selectExpr("*", "CASE WHEN kind = 'low' THEN 50D ELSE 1D END AS w")
    roots = m.Candidate("f", "forest", {"trees": 3, "depth": 2, "leaf": 600, "subset": "all"})
    said = m.fit_candidate(heavy, features, "kind", roots, "id", classification=True, weight="w").predict(rows)
    assert said.filter("predicted_label = 'low'").count() == 900

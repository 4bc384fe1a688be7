"""Histogram boosting against a plain version, and its guarantees."""

import json
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from herdspark.operators import boosting as b
from herdspark.operators import modeling as m


SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType())])


def plain_boost(x, y, s):
    """Rounds of trees split one leaf after another, with every distinct value as a limit."""
    start = y.mean()
    score = np.full(len(y), start)
    for _ in range(s.rounds):
        g = score - y

        def best(rows, g=g):
            found = (0.0, None)
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for limit in values[:-1] + np.diff(values) / 2:
                    left = rows[x[rows, f] <= limit]
                    right = rows[x[rows, f] > limit]
                    if min(len(left), len(right)) < s.leaf:
                        continue
                    gain = sum((1 if r is not rows else -1) * g[r].sum() ** 2 / (len(r) + s.l2) for r in (left, right, rows))
                    if gain > found[0] + 1e-9:
                        found = (gain, (left, right))
            return found

        leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < s.leaves and max(gain for (gain, _), _ in leaves) > 1e-9:
            at = max(range(len(leaves)), key=lambda k: leaves[k][0][0])
            (_, ends), _ = leaves.pop(at)
            leaves += [(best(r), r) for r in ends]
        for _, rows in leaves:
            score[rows] -= s.step * g[rows].sum() / (len(rows) + s.l2)
    return score


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 40, 600), rng.normal(size=600).round(1), rng.integers(0, 2, 600)]).astype(float)
    y = np.sin(x[:, 0] / 5) * 3 + x[:, 1] * x[:, 2] + rng.normal(size=600) * 0.1
    return x, y


def frame(spark, x, y, parts):
    return spark.createDataFrame([(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], SCHEMA).repartition(parts)


def predicted(model, rows):
    return np.array([r["prediction"] for r in model.transform(rows).orderBy("id").collect()])


@pytest.mark.parametrize("settings", [b.Settings(4, 0.3, 8, 0.1, 20, eager=1.0), b.Settings(3, 0.5, 31, 2.0, 5, eager=1.0)])
def test_amounts_equal_the_plain_version(spark, numbers, settings):
    x, y = numbers
    rows = frame(spark, x, y, 3)
    assert np.allclose(predicted(b.fit(rows, "y", settings), rows), plain_boost(x, y, settings), atol=1e-5)


def test_the_same_fit_again_and_over_other_parts(spark, numbers, monkeypatch):
    monkeypatch.setattr(b, "TASK_ROWS", 50)
    monkeypatch.setattr(b, "CHECKPOINT_ROUNDS", 2)
    x, y = numbers
    models = [json.loads(m_.getOrDefault(m_.model)) for m_ in (b.fit(frame(spark, x, y, p), "y", b.Settings(5, 0.1, 31, 0.1)) for p in (1, 4, 4, 9))]
    assert len(models[0]["rounds"]) == 5
    for other in models[1:]:
        assert other["rounds"] == models[0]["rounds"] and math.isclose(other["start"][0], models[0]["start"][0])


def test_leaves_settings_and_constant_rows(spark, numbers):
    x, y = numbers
    model = json.loads(b.fit(frame(spark, x, y, 2), "y", b.Settings(2, 0.1, 6, 0.0, 40)).getOrDefault("model"))
    for (tree,) in model["rounds"]:
        assert tree["feature"].count(-1) <= 6
    model = json.loads(b.fit(frame(spark, x, y, 2), "y", b.Settings(1, leaves=31, leaf=5, depth=2)).getOrDefault("model"))
    assert model["rounds"][0][0]["feature"].count(-1) == 4
    flat = frame(spark, np.ones((50, 2)), np.full(50, 7.5), 2)
    assert predicted(b.fit(flat, "y", b.Settings(5)), flat).tolist() == [7.5] * 50
    with pytest.raises(ValueError, match="needs rows"):
        b.fit(flat.filter("id < 0"), "y", b.Settings(5))


def test_classes_and_weights(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 3))
    names = np.array(["high", "low", "mid"])[np.where(x[:, 0] + 0.2 * x[:, 1] > 0.6, 0, np.where(x[:, 0] < -0.4, 1, 2))]
    rows = spark.createDataFrame([(i, *map(float, v), str(n)) for i, (v, n) in enumerate(zip(x, names, strict=True))], "id int, a double, b double, c double, kind string")
    features = m.Features((), ("a", "b", "c"))
    candidate = m.Candidate("b", "boosted", {"rounds": 10, "step": 0.4, "leaves": 8, "l2": 0.1})
    fitted = m.fit_candidate(rows, features, "kind", candidate, "id", classification=True)
    got = fitted.predict(rows).select("kind", "predicted_label", "probability").collect()
    assert sum(r["kind"] == r["predicted_label"] for r in got) > 860
    assert all(math.isclose(sum(r["probability"]), 1.0) for r in got)
    heavy = rows.selectExpr("*", "CASE WHEN kind = 'low' THEN 50D ELSE 1D END AS w")
    weak = m.Candidate("b", "boosted", {"rounds": 1, "step": 0.01, "leaves": 2})
    said = m.fit_candidate(heavy, features, "kind", weak, "id", classification=True, weight="w").predict(rows)
    assert said.filter("predicted_label = 'low'").count() == 900
    two = rows.filter("kind <> 'mid'")
    fitted = m.fit_candidate(two, features, "kind", candidate, "id", classification=True)
    assert fitted.predict(two).filter("kind = predicted_label").count() > 0.98 * two.count()


def test_saved_trees_predict_the_same(spark, numbers, tmp_path):
    x, y = numbers
    rows = frame(spark, x, y, 2)
    model = b.fit(rows, "y", b.Settings(3))
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert predicted(loaded, rows).tolist() == predicted(model, rows).tolist()
    assert model.transform(rows.filter("id < 0")).collect() == []


def test_noise_stops_early(spark, monkeypatch):
    monkeypatch.setattr(b, "EARLY_ROWS", 100)
    rng = np.random.default_rng(7)
    rows = frame(spark, rng.normal(size=(1500, 2)), rng.normal(size=1500), 2)
    assert b.fit(rows, "y", b.Settings(60, 0.3, 31, 0.1, 20, patience=3)).rounds() < 20


def test_bins_hold_rare_values_and_many():
    values = np.column_stack([np.zeros(1000), np.arange(1000.0)])
    edges = b.bin_edges(values, np.array([0.0, 0.0]), np.array([1.0, 999.0]))
    assert edges[0].tolist() == [0.5] and 200 < len(edges[1]) <= 254
    assert b._binned(np.array([[0.0, -5.0], [1.0, 5000.0]]), edges).tolist() == [[0, 0], [1, len(edges[1])]]


def test_equal_bins_are_kept_as_one_row():
    """Sums of collapsed rows are those of all rows, for amounts and for classes."""
    rng = np.random.default_rng(8)
    cells = rng.integers(0, 3, (400, 2)).astype(np.uint8)
    for classes in (0, 3):
        label = rng.integers(0, 3, 400).astype(float) if classes else rng.normal(size=400)
        loss = b.Loss(classes, 2.0**-20, [0.1] * max(classes, 1), plain=not classes)
        units = np.rint((label - 0.1) / loss.unit) if loss.plain else np.zeros(400)
        rows = b.Rows(cells, label, np.ones(400), rng.random(400) < 0.1, np.full((400, max(classes, 1)), 0.1), np.ones(400), units)
        blocks = list(b._blocks(iter([rows]), loss.plain))
        assert len(blocks[0].label) <= 9 * max(classes, 1) and sum(x.times.sum() for x in blocks) == 400
        tree = b.Tree()
        tree.split(0, 1, 0)
        trees = [tree] * len(loss.start)
        for nodes in ([[0]] * len(trees), [[1, 2]] * len(trees)):
            assert np.array_equal(sum(x.sums(loss, trees, nodes, 3) for x in blocks), rows.sums(loss, trees, nodes, 3))


@pytest.mark.parametrize("classes", [0, 3])
def test_equal_rows_meet_in_one_part(spark, monkeypatch, classes):
    """Steps go over every kept row once, however many parts the table has."""
    monkeypatch.setattr(b, "TASK_ROWS", 50)
    kept, begun = [], b.Steps.__init__

    def begin(self, blocks, *rest):
        kept.append(blocks.map(lambda x: (len(x.label), float(x.times.sum()))).collect())
        begun(self, blocks, *rest)

    monkeypatch.setattr(b.Steps, "__init__", begin)
    x = np.column_stack([np.arange(400) % 3, np.arange(400) // 3 % 3])
    rows = frame(spark, x, np.arange(400) // 9 % 3, 4)
    b.fit(rows, "y", b.Settings(2, 0.3, 4), classes)
    assert sum(n for n, _ in kept[0]) == 9 * max(classes, 1) and sum(t for _, t in kept[0]) == 400

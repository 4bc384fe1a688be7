"""Model jobs against closed forms, and the composite experiments."""

import math

import pytest
from pyspark.sql import functions as F

from herdspark.operators import mapping, metrics, splits
from herdspark.operators import modeling as m
from herdspark.operators.contracts import HERD
from herdspark.plans import experiments
from tests.fixtures import SCHEMA, observations

LINEAR = m.Candidate("linear", "linear", linear=True)


@pytest.fixture(scope="module")
def rows(spark):
    """y = 3 + 2x + (cat = b) − noise, with a missing x now and then."""
    data = []
    for i in range(200):
        x = None if i % 20 == 7 else float(i % 17)
        c = "b" if i % 3 == 0 else ("a" if i % 3 == 1 else None)
        y = 3 + 2 * (i % 17) + (1 if c == "b" else 0) + 0.1 * ((i * 7) % 5 - 2)
        data.append((i, f"g{i % 10}", c, x, y, "hi" if y > 20 else "lo"))
    return spark.createDataFrame(data, "id int, g string, c string, x double, y double, label string").cache()


FEATURES = m.Features(("c",), ("x",), ("x",), scaled=True)


def test_facts_and_preprocessing(spark, rows):
    facts = m.learn_facts(rows, FEATURES, "y")[0]
    assert facts.labels["c"] == ("a", "b") and facts.modes["c"] == "a" and facts.rows == 200
    known = sorted(r["x"] for r in rows.filter("x is not null").collect())
    median = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert facts.medians["x"] == median
    filled = [median if r["x"] is None else r["x"] for r in rows.collect()]
    mean = sum(filled) / 200
    assert math.isclose(facts.means["x"], mean)
    assert math.isclose(facts.deviations["x"], math.sqrt(sum((v - mean) ** 2 for v in filled) / 200))
    out = m.fitted_preprocessor(rows, FEATURES).transform(spark.createDataFrame([("a", None), ("zzz", mean), (None, mean)], "c string, x double"))
    vectors = [list(r["features"].toArray()) for r in out.collect()]
    assert vectors[0][:2] == [1.0, 0.0] and vectors[0][3] == 1.0
    assert vectors[1][:2] == [0.0, 0.0] and abs(vectors[1][2]) < 1e-12 and vectors[2][:2] == [1.0, 0.0]


def test_facts_per_held_out_fold_equal_separate_facts(spark, rows):
    folded = rows.withColumn("f", F.col("id") % 3 + 1)
    together = m.learn_facts(folded, FEATURES, "y", "f", 3)
    for i in (1, 2, 3):
        alone = m.learn_facts(folded.filter(F.col("f") != i), FEATURES, "y")[0]
        assert together[i].labels == alone.labels and together[i].modes == alone.modes and together[i].medians == alone.medians
        assert together[i].rows == alone.rows
        for c in ("x", "y"):
            assert math.isclose(together[i].means[c], alone.means[c]) and math.isclose(together[i].deviations[c], alone.deviations[c])


def test_ridge_equals_the_closed_form(spark, rows):
    import numpy as np

    alpha = 5.0
    fitted = m.fit_candidate(rows, FEATURES, "y", m.Candidate("r", "ridge", {"alpha": alpha}, linear=True))
    vectors = fitted.predict(rows).select("features", "y", "prediction").collect()
    x = np.array([v["features"].toArray() for v in vectors])
    y = np.array([v["y"] for v in vectors])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    expected = xc @ w + y.mean()
    assert np.allclose([v["prediction"] for v in vectors], expected, atol=1e-6)


def test_leave_one_group_out_equals_refits(spark, rows):
    candidate = m.Candidate("r", "ridge", {"alpha": 2.0}, linear=True)
    plain = m.Features((), ("x",), ("x",))
    fast = {r["id"]: r["prediction"] for r in m.leave_one_group_out(rows.fillna({"x": 5.0}), plain, "y", "g", "id", 2.0).collect()}
    full = rows.fillna({"x": 5.0})
    for g in ("g0", "g7"):
        fitted = m.fit_candidate(full.filter(F.col("g") != g), plain, "y", candidate)
        for r in fitted.predict(full.filter(F.col("g") == g)).collect():
            assert math.isclose(fast[r["id"]], r["prediction"], rel_tol=1e-6)


def test_features_must_not_hold_the_target(rows):
    with pytest.raises(ValueError, match="target or identifier"):
        m.fit_candidate(rows, m.Features(numbers=("x", "y")), "y", LINEAR)
    with pytest.raises(ValueError, match="target or identifier"):
        m.fit_candidate(rows, m.Features(numbers=("x", "id")), "y", LINEAR, forbidden=("id",))


def test_candidates_and_cross_fitting(spark, rows):
    found, fitted = m.evaluate_candidates(rows, rows, FEATURES, "y", [*m.regression_candidates("y")[:3], m.Candidate("tree", "tree", {"depth": 4, "leaf": 2})], "id")
    table = {r["configuration_id"]: r for r in found.collect()}
    assert table["y_dummy_mean"]["r2"] < 1e-9 and table["y_ridge"]["r2"] > 0.8 and table["tree"]["r2"] > 0.8
    assert table["y_dummy_median"]["is_baseline"] and set(fitted) == set(table)
    labels, _ = m.evaluate_candidates(rows, rows, FEATURES, "label", [*m.classifier_candidates("l")[:3], m.Candidate("t", "tree", {"depth": 3, "leaf": 1}),
                                      m.Candidate("b", "boosted", {"rounds": 2, "step": 0.1, "depth": 2})], "id", ["hi", "lo"])
    scored = {r["configuration_id"]: r for r in labels.collect()}
    assert scored["l_dummy_most_frequent"]["predicted_class_count"] == 1 and scored["t"]["accuracy"] > 0.8 and scored["b"]["accuracy"] > 0.8
    assert scored["l_logistic_c1"]["macro_f1"] > scored["l_dummy_stratified"]["macro_f1"]
    folded = rows.withColumn("f", F.col("id") % 4 + 1)
    fits = []
    predicted = m.cross_fitted(folded, FEATURES, "y", LINEAR, "id", "f", 4, fits=fits)
    audit = m.fold_audit(folded, predicted, fits, "id", "f").collect()
    assert [r["heldout_rows"] for r in audit] == [50] * 4 and all(r["heldout_rows_in_fit"] == 0 and r["fit_rows"] == 150 for r in audit)


@pytest.mark.parametrize("scaled", [True, False])
def test_linear_grid_equals_fits_of_every_fold(spark, rows, scaled):
    """A fold lacks a category, one has a number that is always missing in it; the sums of the others still give its model."""
    odd = spark.createDataFrame([(200 + i, "z", "only1", 5.0 + i, 20.0 + i, "lo") for i in range(6)], rows.schema)
    folded = rows.unionByName(odd).withColumn("f", F.when(F.col("g") == "z", 1).otherwise(F.col("id") % 4 + 1))
    folded = folded.withColumn("w", F.when(F.col("f") != 2, F.col("x") * 1000 + F.col("id") % 7)).repartition(5)
    features = m.Features(("c",), ("x", "w"), ("x",), scaled=scaled)
    grid = [m.Candidate(f"r{a}", "ridge", {"alpha": a}, linear=True) for a in (0.1, 1.0, 10.0)]
    facts = m.learn_facts(folded, features, "y", "f", 4)
    found = m.linear_grid(folded, features, "y", grid, "id", "f", 4, facts)
    got = {(r["configuration_id"], r["id"]): r["prediction"] for r in found.collect()}
    assert len(got) == 3 * 206
    for c in grid:
        for r in m.cross_fitted(folded, features, "y", c, "id", "f", 4, facts=facts).collect():
            assert math.isclose(got[c.id, r["id"]], r["prediction"], rel_tol=1e-6, abs_tol=1e-6), (c.id, r)


def test_linear_grid_of_wide_designs_and_hidden_targets(rows):
    folded = rows.withColumn("f", F.col("id") % 2 + 1)
    with pytest.raises(ValueError, match="target"):
        m.linear_grid(folded, m.Features((), ("y",)), "y", [LINEAR], "id", "f", 2, {})
    wide = {f: m.Facts({"c": tuple(f"v{i}" for i in range(600))}, {}, {}, {"y": 0.0}, {}, 1) for f in (1, 2)}
    assert m.linear_grid(folded, m.Features(("c",)), "y", [LINEAR], "id", "f", 2, wide) is None


def test_too_many_categories_are_refused(rows, monkeypatch):
    monkeypatch.setattr(m, "MAX_CATEGORY_VALUES", 1)
    with pytest.raises(m.TooManyCategories):
        m.learn_facts(rows, FEATURES)


def test_the_limit_of_categories_holds_for_each_column(rows, monkeypatch):
    monkeypatch.setattr(m, "MAX_CATEGORY_VALUES", 4)
    folded = rows.withColumn("f", F.col("id") % 4 + 1).withColumn("d", F.col("c"))
    # Six values and more of all columns and folds together, two of each.
    facts = m.learn_facts(folded, m.Features(("c", "d", "label")), fold="f", folds=4)
    assert facts[1].labels == {"c": ("a", "b"), "d": ("a", "b"), "label": ("hi", "lo")}
    with pytest.raises(m.TooManyCategories, match=r"^g \(10 values\)"):
        m.learn_facts(folded, m.Features(("c", "g")), fold="f", folds=4)


def test_fold_audit_finds_a_leak(spark, rows):
    folded = rows.withColumn("f", F.col("id") % 4 + 1)
    fits = []
    predicted = m.cross_fitted(folded, FEATURES, "y", LINEAR, "id", "f", 4, fits=fits)
    fits[1] = fits[1].unionAll(folded.filter("f = 2").limit(3).select(F.lit(2), "id"))
    found = {r["f"]: (r["fit_rows"], r["heldout_rows_in_fit"]) for r in m.fold_audit(folded, predicted, fits, "id", "f").collect()}
    assert found == {1: (150, 0), 2: (153, 3), 3: (150, 0), 4: (150, 0)}


def test_confidence_importance_and_reload(spark, rows, tmp_path):
    tree = m.fit_candidate(rows, FEATURES, "label", m.Candidate("t", "tree", {"depth": 3, "leaf": 1}), "id", classification=True)
    audit = m.confidence(tree.predict(rows), "label").first()
    assert audit["rows"] == 200 and 0.5 <= audit["minimum"] <= audit["median"] <= audit["maximum"] <= 1.0
    fitted = m.fit_candidate(rows, FEATURES, "y", LINEAR)
    found = {r["feature"]: r["importance_mean"] for r in m.permutation_importance(fitted, rows, FEATURES, "y", "id", 2).collect()}
    assert found["x"] > 5 * abs(found["c"])
    classes = {r["feature"]: r["importance_mean"] for r in m.permutation_importance(tree, rows, FEATURES, "label", "id", 2, scoring="macro_f1").collect()}
    assert set(classes) == set(found) and max(classes.values()) > 0.05
    check = m.reload_check(fitted, rows, "id", str(tmp_path / "model")).first()
    assert check["identical"] and check["rows"] == 200
    assert m.unknown_category_check(fitted, rows, "c").first()["non_finite"] == 0


def test_scores_of_bad_requests_stay_empty(spark):
    train = spark.createDataFrame([(100.0, -5.0), (200.0, -10.0), (300.0, 20.0)], "Weight_kg double, y double")
    fitted = m.fit_candidate(train, m.Features(numbers=("Weight_kg",)), "y", LINEAR)
    raw = spark.createDataFrame([("a", "Gir", "30", "50", "Early"), ("b", "Gir", "x", "50", "Early")], "id string, breed string, ageMonths string, weightKg string, lactationStage string")
    from herdspark.operators.rules import model_inputs

    found = {r["id"]: r for r in m.non_negative_scores(model_inputs(raw, ["id"]), fitted.model, "milk").collect()}
    assert found["a"]["milk"] == 0.0 and found["b"]["milk"] is None and found["b"]["input_error"] == "NOT_NUMERIC: ageMonths"


def test_selection_is_locked_once(spark, rows, tmp_path):
    tagged = rows.filter("x is not null").withColumn("split", F.when(F.col("id") % 7 < 3, "train").when(F.col("id") % 7 < 5, "validation").otherwise("test"))
    path = str(tmp_path / "lock")
    done = experiments.regression_experiment(tagged, FEATURES, "y", "id", [*m.regression_candidates("y")[:3], LINEAR], path).first()
    assert done["status"] == "BEATS_BASELINE" and done["test_r2"] > 0.8
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        experiments.regression_experiment(tagged, FEATURES, "y", "id", [*m.regression_candidates("y")[:3], LINEAR], path)


def test_designs_use_only_the_cross_fitted_label(spark, rows):
    tagged = rows.withColumns({"split": F.when(F.col("id") % 4 < 3, "train").otherwise("validation"), "f": (F.col("id") % 2 + 1).cast("int")})
    tree = m.Candidate("t", "tree", {"depth": 3, "leaf": 1})
    found = {r["design"]: r for r in experiments.label_and_amount_experiment(tagged, FEATURES, "label", "y", "id", "f", 2, tree, LINEAR).collect()}
    assert set(found) == {"A", "B"} and found["A"]["rows"] == found["B"]["rows"] == 50


def test_preprocessing_job(spark):
    raw = spark.createDataFrame(observations(breed={1: " gir "}, milk_yield_l={2: 0.0}), SCHEMA)
    done = experiments.prepare_dataset(raw, "source_row_number", "feed_type", ["feed_type_classifier", "milk_yield_regressor"], HERD)
    assert done.table.count() == 80 and done.manifest.count() == 80
    runs = done.evidence.collect()
    assert runs[0]["checksum"] == runs[1]["checksum"] and runs[0]["rows"] == 80
    assert {r["model"] for r in done.findings.collect()} == {"feed_type_classifier", "milk_yield_regressor"}
    assert done.folds.count() == done.manifest.filter("split = 'train'").count()
    assert done.issues.filter("field = 'breed' and source_row_number = 1").count() == 1


def test_grouped_job_and_joined_job(spark, rows):
    left = rows.select("id", "g", "y", F.coalesce("x", F.lit(8.0)).alias("x"))
    right = rows.select("id", (F.col("y") * 0.5).alias("z"))
    one = m.Features(numbers=("x",))
    found = {r["view"]: r for r in experiments.joined_grouped_experiment(left, right, ["id"], "g", "id", one, ["z"], "y", LINEAR).collect()}
    assert found["with_extra"]["r2"] > 0.999 > found["base"]["r2"] and found["base"]["all_fold_r2_positive"]
    assigned = splits.apply_groups(left, splits.group_assignments(left, "g"), "g")
    final = m.final_holdout(assigned.filter("partition = 'development'"), assigned.filter("partition = 'holdout'"), one, "y", LINEAR, m.regression_candidates("y")[:2], "id").first()
    assert final["decision"] == "BEATS_BASELINE"
    assert metrics.fold_stability(spark.createDataFrame([("a", 1.0, 0.5), ("a", 1.0, -0.1)], "c string, mae double, r2 double"), ["c"]).first()["all_fold_r2_positive"] is False


def test_recommendations():
    assert experiments.final_recommendation(True, True) == "BOTH_MODELS_AND_RULES"
    assert experiments.final_recommendation(False, False) == "RULES_ONLY"
    assert mapping.is_identifier_name("Farm_ID") and not mapping.is_identifier_name("Humidity")


def test_designs_leave_test_rows_out(spark):
    """Test rows have no predicted label; both designs are compared on the others."""
    made = [(i, float(i % 7), "hi" if i % 7 > 3 else "lo", float(3 * (i % 7) + i % 2), ("train", "train", "validation", "test")[i % 4], i % 3 + 1) for i in range(240)]
    rows = spark.createDataFrame(made, "id int, x double, kind string, amount double, split string, f int")
    rows = rows.withColumn("f", F.when(F.col("split") == "train", F.col("f")))
    forest = m.Candidate("f", "forest", {"trees": 3, "depth": 4, "leaf": 1, "subset": "all"})
    ridge = m.Candidate("r", "ridge", {"alpha": 1.0}, linear=True)
    found = experiments.label_and_amount_experiment(rows, m.Features(numbers=("x",)), "kind", "amount", "id", "f", 3, forest, ridge).collect()
    assert {r["design"] for r in found} == {"A", "B"} and all(r["rows"] == 60 and r["r2"] > 0.9 for r in found)

"""Cleaning, validation, profiles, summaries and checks on small fixtures."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from herdspark.operators import catalogue, cleaning, formulas, issues, mapping, profile, quality, relations, sketches, summary, validate
from herdspark.operators.contracts import HERD, HERD_ALIASES, INFERENCE, TRAINING, ContractError, ModelContract
from herdspark.sources import tables
from tests.fixtures import SCHEMA, observations


def table(spark, **changes):
    return spark.createDataFrame(observations(**changes), SCHEMA)


def by(rows, *keys):
    return {tuple(r[k] for k in keys): r for r in rows}


def test_clean_table_and_issue_log(spark):
    df = table(spark, breed={1: " jersey ", 2: "", 3: "Unicorn"}, lactation_stage={4: "Early Lactation", 5: "Dry"},
               age_months={6: "abc", 7: "inf"}, milk_yield_l={8: math.inf})
    clean = by(cleaning.clean_table(df).collect(), "source_row_number")
    assert clean[(1,)]["breed"] == "Jersey" and clean[(2,)]["breed"] is None and clean[(3,)]["breed"] == "Unicorn"
    assert clean[(4,)]["lactation_stage"] == "Early" and clean[(5,)]["lactation_stage"] == "Dry"
    assert clean[(6,)]["age_months"] is None and clean[(7,)]["age_months"] is None and clean[(8,)]["milk_yield_l"] is None
    assert clean[(9,)]["unapproved_extra"] == "x" and len(clean) == 80
    log = by(cleaning.cleaning_issues(df).filter("issue_type <> 'NUMERIC_STRING'").collect(), "source_row_number", "field")
    assert {k: r["issue_type"] for k, r in log.items()} == {
        (1, "breed"): "APPROVED_CATEGORY_NORMALIZATION", (2, "breed"): "EMPTY_STRING", (3, "breed"): "UNKNOWN_CATEGORY",
        (4, "lactation_stage"): "APPROVED_CATEGORY_NORMALIZATION", (5, "lactation_stage"): "UNKNOWN_CATEGORY",
        (6, "age_months"): "INVALID_NUMERIC_VALUE", (7, "age_months"): "NON_FINITE_NUMERIC_VALUE",
        (8, "milk_yield_l"): "NON_FINITE_NUMERIC_VALUE"}
    assert log[(1, "breed")]["action"] == "NORMALIZED" and log[(1, "breed")]["cattle_id"] == "TEST_0000"


def test_validation_training(spark):
    df = table(spark, breed={1: "Unicorn", 2: " jersey ", 3: None}, age_months={4: "-3", 5: "abc", 6: None, 7: "301"},
               humidity_percent={8: 101.0, 9: None}, milk_yield_l={10: 0.0, 11: None, 12: -1.0})
    found = by(validate.validate_table(df, "milk_yield_regressor", TRAINING, "source_row_number").collect(), "field", "issue_type")
    expect = {
        ("breed", "UNKNOWN_CATEGORY"): ("WARNING", 1), ("breed", "CATEGORY_FORMAT_VARIANT"): ("WARNING", 1),
        ("breed", "MISSING_REQUIRED_CATEGORY"): ("ERROR", 1), ("age_months", "HARD_INVALID_NEGATIVE"): ("ERROR", 1),
        ("age_months", "INVALID_NUMERIC_VALUE"): ("ERROR", 1), ("age_months", "MISSING_NUMERIC_VALUE"): ("ERROR", 1),
        ("age_months", "CONTRACT_RANGE_VIOLATION"): ("WARNING", 2), ("humidity_percent", "HARD_INVALID_HUMIDITY"): ("ERROR", 1),
        ("humidity_percent", "CONTRACT_RANGE_VIOLATION"): ("WARNING", 1), ("humidity_percent", "MISSING_NUMERIC_VALUE"): ("WARNING", 1),
        # Row 1 of the fixture has zero yield in the week before, but a positive target.
        ("milk_yield_l", "ZERO_SYNTHETIC_MILK_TARGET"): ("WARNING", 1), ("milk_yield_l", "MISSING_NUMERIC_VALUE"): ("ERROR", 1),
        ("milk_yield_l", "HARD_INVALID_NEGATIVE"): ("ERROR", 1), ("__schema__", "UNEXPECTED_FIELDS"): ("INFO", 3),
    }
    assert {k: (r["severity"], r["affected_count"]) for k, r in found.items()} == expect
    assert found[("age_months", "CONTRACT_RANGE_VIOLATION")]["sample_rows"] == [4, 7]
    assert found[("age_months", "CONTRACT_RANGE_VIOLATION")]["sample_values"] == ["-3", "301"]


def test_validation_inference_and_schema(spark):
    df = table(spark, age_months={1: "0"}).drop("weight_kg")
    rows = validate.validate_table(df, "milk_yield_regressor", INFERENCE, "source_row_number")
    found = by(rows.collect(), "field", "issue_type")
    assert found[("__schema__", "MISSING_REQUIRED_FIELDS")]["sample_values"] == ["weight_kg"]
    assert found[("__schema__", "TARGET_FIELDS_FORBIDDEN_AT_INFERENCE")]["affected_count"] == 3
    assert found[("age_months", "CONTRACT_RANGE_VIOLATION")]["severity"] == "ERROR"
    assert validate.verdict(rows).first()["valid"] is False
    good = table(spark).drop("feed_type", "feed_quantity_kg", "milk_yield_l", "unapproved_extra")
    assert validate.verdict(validate.validate_table(good, "milk_yield_regressor", INFERENCE, "source_row_number")).first()["valid"]
    twice = df.select("*", F.col("breed"))
    found = validate.validate_table(twice, "milk_yield_regressor", TRAINING, "source_row_number").collect()
    assert [r["issue_type"] for r in found] == ["DUPLICATE_CANONICAL_COLUMNS"]


def test_mapping_and_views(spark):
    raw = spark.createDataFrame([("a", 1.0, "z")], "`TAGID` string, weightKg double, other string")
    mapped = mapping.map_columns(raw, required=["breed"])
    assert mapped.table.columns == ["cattle_id", "weight_kg", "other"]
    assert mapped.unmapped == ("other",) and mapped.missing_required == ("breed",)
    assert mapping.map_columns(raw, keep_unmapped=False).table.columns == ["weight_kg", "cattle_id"]
    assert mapping.map_columns(raw, only=["weight_kg"]).table.columns == ["weight_kg"]
    for bad in (dict(required=["breed"], raise_on_missing=True), dict(only=["breed"]), dict(aliases={"a": ["x"], "b": ["X"]}), dict(operation="FTP")):
        with pytest.raises(mapping.MappingError):
            mapping.map_columns(raw, **bad)
    with pytest.raises(mapping.MappingError):
        mapping.map_columns(spark.createDataFrame([(1, 2)], "weight int, weightKg int"), aliases=HERD_ALIASES)

    df = table(spark)
    view = mapping.feature_view(df, "milk_yield_regressor", keys=["source_row_number"])
    assert view.features.columns == ["source_row_number", *view.names, "milk_yield_l"]
    assert ("cattle_id", "IDENTIFIER_METADATA_ONLY") in view.excluded and ("milk_yield_l", "TARGET_SEPARATED_FROM_X") in view.excluded
    with pytest.raises(ContractError):
        mapping.feature_view(df, "feed_quantity_regressor_design_b")
    with pytest.raises(ContractError):
        mapping.feature_view(df, "feed_quantity_regressor_design_b", allow_derived=True)
    partial = mapping.feature_view(df.drop("days_in_milk", "milk_yield_l"), "milk_yield_regressor", include_target=False)
    assert partial.features.filter("days_in_milk is null").count() == 80
    with pytest.raises(ContractError):
        mapping.feature_view(df.drop("breed"), "milk_yield_regressor", include_target=False)
    with pytest.raises(ContractError):
        ModelContract("m", ("a", "a"), "t")
    plain, labelled = mapping.design_views(df.withColumn("predicted_feed_type", F.lit("Hay")), ["source_row_number"])
    assert "predicted_feed_type" in labelled.names and "predicted_feed_type" not in plain.names
    assert mapping.ablation_view(view, "humidity_percent").names == view.names[:-1]
    assert "UNCLASSIFIED" not in HERD.exclusion_reasons


def test_attach_prediction_needs_every_row(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    some = spark.createDataFrame([(1, "Hay")], "id int, label string")
    full = some.union(spark.createDataFrame([(2, "Silage")], "id int, label string"))
    assert {r["label"] for r in mapping.attach_prediction(rows, full, "id", "label").collect()} == {"Hay", "Silage"}
    with pytest.raises(Exception, match="row without label"):
        mapping.attach_prediction(rows, some, "id", "label").collect()


def test_feature_selection_rules(spark):
    df = spark.createDataFrame([(1, "x", 2.0, "2024-01-01", 1.0)], "cow_id int, Breed string, Weight_kg double, obs_date string, Feed_Quantity_kg double")
    assert mapping.select_features(df, "Feed_Quantity_kg") == ["Breed", "Weight_kg"]
    assert mapping.select_features(df, "y", ["Weight_kg", "cow_id", "absent"], numeric_only=True) == ["Weight_kg"]
    assert mapping.split_feature_types(df, ["Breed", "Weight_kg"]) == (["Breed"], ["Weight_kg"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_are_exact_also_with_a_hot_value_and_outliers(spark, seed):
    rng = random.Random(seed)
    data = {"a": [rng.gauss(0, 5) for _ in range(501)] + [1e9], "b": [3.0] * 400 + [rng.random() for _ in range(200)], "c": [7.0], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", None)]
    found = by(summary.numeric_summary(spark.createDataFrame(rows, "g string, value double"), "value", ["g"]).collect(), "g")

    def quantile(values, p):
        s = sorted(values)
        x = p * (len(s) - 1)
        lo = math.floor(x)
        return s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (x - lo)

    for g, vs in data.items():
        row = found[(g,)]
        assert row["count"] == len(vs) and row["unique_values"] == len(set(vs))
        for p in summary.PERCENTILES:
            assert math.isclose(row[summary.percentile_name(p)], quantile(vs, p), rel_tol=1e-12, abs_tol=1e-12), (g, p)
        assert math.isclose(row["mean"], statistics.fmean(vs), rel_tol=1e-9)
        if len(vs) > 1:
            assert math.isclose(row["standard_deviation"], statistics.stdev(vs), rel_tol=1e-9)
        else:
            assert row["standard_deviation"] is None
    assert found[("a",)]["missing_count"] == 1


def test_sketched_summary(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1000)] + [(None,)], "value double")
    row = summary.numeric_summary(rows, exact=False).first()
    assert row["count"] == 1000 and abs(row["p50"] - 499.5) <= 1 and row["missing_count"] == 1


def test_empty_summary(spark):
    row = summary.numeric_summary(spark.createDataFrame([(None,), (None,)], "value double")).first()
    assert row["count"] == 0 and row["mean"] is None and row["p50"] is None and row["missing_count"] == 2


def test_profile_types(spark):
    rows = [(i, f"n{i}", "2024-01-01" if i else "never", "A" if i % 2 else "B", float(i), i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "cattle_id int, label string, seen_date string, code string, amount double, flag boolean")
    found = by(profile.column_profile(df).collect(), "column")
    kinds = {k[0]: r["inferred_type"] for k, r in found.items()}
    assert kinds == {"cattle_id": "identifier", "label": "string", "seen_date": "datetime", "code": "categorical", "amount": "continuous_numeric", "flag": "boolean"}
    rough = by(profile.column_profile(df, exact=False).collect(), "column")
    assert {k[0]: r["inferred_type"] for k, r in rough.items()} == kinds


def test_relations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0), (None, 1.0, 5.0)], "a double, b double, k double")
    found = by(relations.all_correlations(df, ["a", "b", "k"]).collect(), "left", "right")
    assert found[("a", "b")]["pairs"] == 3 and found[("a", "b")]["correlation"] > 0.99
    assert found[("a", "k")]["correlation"] is None and not found[("a", "k")]["near_perfect"]
    same = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "1"), (None, "2")], "l string, r string")
    assert math.isclose(relations.cramers_v(same, "l", "r").first()["cramers_v"], 1.0)
    constant = spark.createDataFrame([("x", "1"), ("x", "2")], "l string, r string")
    assert relations.cramers_v(constant, "l", "r").first()["cramers_v"] is None
    report = relations.repeated_observations(spark.createDataFrame([("1.0",), ("1",), ("2",), (" ",)], "id string"), "id").first()
    assert (report["unique_subjects"], report["repeated_subjects"], report["status"]) == (2, 1, "REPEATED")
    ids = spark.createDataFrame([("C1", 1), ("C2", 2), ("C9", 3), ("x", 4)], "id string, n int")
    row = relations.sequential_evidence(ids, "id", "n").first()
    assert (row["numeric_suffix_parseable_percentage"], row["row_order_matches_percentage"]) == (75.0, 50.0)


def test_rules_and_audit(spark):
    df = spark.createDataFrame([(-1.0, 0.0, 900), (0.0, 1300.0, 10), (240.0, 40.0, 20), (20.0, 400.0, 700)], "Age_Months double, Weight_kg double, Days_in_Milk int")
    found = by(quality.rule_checks(df, quality.herd_rules(), quality.HERD_UNCLEAR).collect(), "issue")
    count = lambda i: found[(i,)]["affected_rows"]
    assert count("Negative age") == 1 and count("Zero age") == 1 and count("Implausible age") == 0
    assert count("Zero weight") == 1 and count("Implausible weight") == 2 and count("Suspiciously high days in milk") == 1
    assert count("Impossible age/lactation combination") == 3
    assert found[("Invalid parity",)]["status"] == "NOT_APPLICABLE" and ("Impossible young-age/parity combination",) not in found
    assert found[("Mixed or undocumented feed units",)]["status"] == "UNCLEAR"
    sections = {r["section"] for r in quality.table_audit(df.withColumn("t", F.lit("x")), quality.herd_rules()).collect()}
    assert sections == {"duplicates", "rules", "constancy", "missing", "spelling"}
    audit = quality.table_audit(df, quality.herd_rules(), identifiers=["Days_in_Milk"], targets=["Weight_kg"]).collect()
    found = {(r["section"], r["column"]): r for r in audit if r["section"] in ("missing", "identifiers", "leakage")}
    assert found[("missing", "Weight_kg")]["status"] == "PASS" and found[("identifiers", "Days_in_Milk")]["affected_rows"] == 0
    assert found[("leakage", "Weight_kg")]["evidence"] == "TARGET"


def test_spelling_and_lists(spark):
    df = spark.createDataFrame([("Dry_Fodder",), ("dry fodder",), ("Hay",), (None,)], "f string")
    rows = profile.spelling_groups(df, ["f"]).collect()
    assert {r["spelling"] for r in rows} == {"Dry_Fodder", "dry fodder"}
    lists = spark.createDataFrame([(1, "Maize, maize/ hay"), (2, None), (3, "a"), (4, " , /")], "id int, items string")
    found = by(issues.list_issues(lists, "items", ["id"]).collect(), "id")
    assert found[(1,)]["value"] == "maize" and found[(2,)]["issue_type"] == "MISSING_INGREDIENT_LIST" and len(found) == 2
    assert issues.list_summary(lists, "items").first().asDict() == {
        "sample_count": 4, "token_count": 4, "samples_with_repeated_tokens": 1, "unique_token_count": 4}


def test_formula_statuses(spark):
    names = [f.target for f in formulas.herd_formulas()] + [i for f in formulas.herd_formulas() for i in f.inputs]
    assert len(formulas.herd_formulas()) == 31 and len(set(f.id for f in formulas.herd_formulas())) == 31 and "G24" in names
    rows = [(30.0, 6.0, 10.0, 16.0, 400.0), (61.0, 4.0, 10.0, 14.004, 400.0), (130.0, 1.0, 10.0, 99.0, None), (None, 1.0, None, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "daysinmilk double, `Ass.calfmilk` double, `hand-milked yield` double, `Total milk performance` double, potentialmilk double")
    found = by(formulas.audit_formulas(df, formulas.herd_formulas()).collect(), "formula_id")
    calf, total = found[("MILK-001",)], found[("MILK-002",)]
    assert (calf["exact_match_count"], calf["missing_input_row_count"], calf["status"]) == (3, 1, "PARTIALLY_REPRODUCIBLE")
    assert (total["exact_match_count"], total["tolerance_match_count"], total["mismatch_count"]) == (1, 1, 1)
    assert found[("MILK-005",)]["status"] == "FORMULA_NOT_DOCUMENTED" and found[("ME-001",)]["status"] == "NOT_REPRODUCIBLE_MISSING_INPUT"
    wrong = formulas.formula_mismatches(df, formulas.herd_formulas(), ["daysinmilk"]).collect()
    assert [(r["target"], r["actual"]) for r in wrong] == [("Total milk performance", 99.0)]


def test_negative_readings(spark):
    df = spark.createDataFrame([(10.0, -2.0, 12.0), (5.0, -1.0, 4.0), (3.0, 1.0, 2.0), (1.0, -4.0, 1.0)], "s double, l double, k double")
    found = by(formulas.negative_readings(df, "l", "s", "k").collect(), "interpretation_id")
    assert {k[0]: (r["matches"], r["conflicts"]) for k, r in found.items()} == {"A": (1, 3), "B": (1, 0), "C": (1, 1), "D": (1, 0), "E": (None, None)}


def test_catalogue(spark):
    df = spark.createDataFrame(
        [("Milk_Yield_L", "daily yield in liters per cow"), ("Cow_ID", "number"), ("Glucose_mmol", "mmol/L in blood"), ("Rectal_Temp_F", "°F"), ("gapCP", "gap")],
        "variable string, definition string")
    found = by(catalogue.definition_details(df).collect(), "variable")
    got = {k[0]: (r["unit"], r["period"], r["measurement_status"]) for k, r in found.items()}
    assert got["Milk_Yield_L"] == ("L", "per cow per day", "OBSERVED") and got["Cow_ID"][2] == "IDENTIFIER"
    assert got["Glucose_mmol"][0] == "mmol/L" and got["Rectal_Temp_F"] == ("°F", "per observation", "DIRECTLY_MEASURED")
    assert by(catalogue.classify_targets(df).collect(), "variable")[("gapCP",)]["domain"] == "protein"


def test_quantiles_with_an_outlier_and_a_hot_value(spark):
    import numpy as np

    values = [float(i % 997) / 7 for i in range(4000)] + [5.0] * 3000 + [1e15, -1e300]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("c", None), (None, 2.0), (None, 4.0)], "g string, v double")
    found = by(summary.numeric_summary(df, "v", ["g"]).collect(), "g")
    row = found[("a",)]
    for p in (1, 5, 25, 50, 75, 95, 99):
        assert abs(row[f"p{p:02d}"] - np.percentile(values, p)) < 1e-9
    assert row["unique_values"] == len(set(values)) and row["count"] == len(values)
    assert found[("b",)]["p50"] == 1.0 and found[("b",)]["standard_deviation"] is None
    assert found[("c",)]["p50"] is None and found[("c",)]["unique_values"] == 0 and found[("c",)]["missing_count"] == 1
    assert found[(None,)]["median"] == 3.0


def test_blocked_correlations_equal_one_aggregate_per_pair(spark):
    """Columns with nulls, an infinity, a constant, a large mean, a constant overlap, one without values; 40 in all."""
    rng = random.Random(31)
    names = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(150):
        base = rng.gauss(0, 1)
        row = [base * (k % 5) + rng.gauss(0, 1) if rng.random() < 0.8 else None for k in range(40)]
        row[3] = float("inf") if i == 17 else base
        row[4] = 7.5
        row[5] = 1e9 + base
        row[6] = 0.1 if i < 40 else base
        row[7] = base if i < 40 else None
        row[8] = None
        row[9] = float("nan") if i % 3 else base
        rows.append(tuple(row))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r["left"], r["right"]): r for r in relations.blocked_correlations(df, names).collect()}
    assert len(got) == 40 * 39 // 2
    chosen = [(a, b) for a, b in got if names.index(b) < 10]
    for r in relations.correlations(df, chosen).collect():
        mine = got[r["left"], r["right"]]
        assert mine["pairs"] == r["pairs"], r
        if r["correlation"] is None or math.isnan(r["correlation"]):
            assert str(mine["correlation"]) == str(r["correlation"]), (r, mine)
        else:
            assert math.isclose(mine["correlation"], r["correlation"], abs_tol=1e-6), (r, mine)
    for (a, b), mine in got.items():
        if names.index(a) >= 10:
            both = [(r[names.index(a)], r[names.index(b)]) for r in rows]
            both = [(x, y) for x, y in both if x is not None and y is not None]
            assert mine["pairs"] == len(both)
            assert math.isclose(mine["correlation"], statistics.correlation(*zip(*both)), abs_tol=1e-9)
    assert got["c6", "c7"]["correlation"] is None and got["c6", "c7"]["pairs"] == 40
    assert got["c0", "c8"]["pairs"] == 0 and got["c0", "c8"]["correlation"] is None
    empty = relations.all_correlations(df.limit(0), names).collect()
    assert len(empty) == 780 and all(r["pairs"] == 0 and r["correlation"] is None for r in empty)


def test_dataset_audit_has_every_section(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,k\n1,2,x\n\n2,4,y\n   \n")
    rows = [(1, 2, "x"), (2, 4, "y"), (None, None, None), (10, 20, "x"), (10, 20, "z")]
    df = spark.createDataFrame(rows, "a int, b int, k string")
    blanks = tables.blank_lines(spark, str(tmp_path / "t.csv"))
    found = quality.dataset_audit(
        df, (), identifiers=["a"], populations={"k": {"GOOD": ("x", "y")}}, candidates={"Alpha": ("A",), "gone": ()},
        availability={}, balanced=["k"], blanks=blanks,
    ).collect()
    got = {(r["section"], r["issue"], r["column"]): r for r in found}
    assert len(got) == len(found)
    assert got["profile", "Distinct values", "a"]["evidence"] == "int: 1 to 10" and got["profile", "Distinct values", "a"]["affected_rows"] == 3
    assert got["empty rows", "Empty rows", "ALL_COLUMNS"]["affected_rows"] == 1
    assert got["blank lines", "Blank lines", "ALL_COLUMNS"]["affected_rows"] == 2
    assert got["populations", "Population GOOD", "k"]["affected_rows"] == 3
    assert got["populations", "Population UNCLASSIFIED", "k"]["status"] == "FLAGGED"
    assert got["candidates", "Candidate feature Alpha", "a"]["status"] == "FLAGGED" and got["candidates", "Candidate feature gone", "gone"]["status"] == "NOT_APPLICABLE"
    assert got["synthetic", "Evenly balanced classes", "k"]["status"] == "PASS"
    assert got["synthetic", "Near-perfect correlation", "a, b"]["affected_rows"] == 4
    assert {s for s, _, _ in got} == {"duplicates", "missing", "identifiers", "spelling", "profile", "empty rows", "blank lines", "populations", "candidates", "synthetic"}
    empty = quality.dataset_audit(df.limit(0), (), populations={"k": {"GOOD": ("x",)}}, candidates={"Alpha": ("a",)}, balanced=["k"]).collect()
    assert all(not r["affected_rows"] for r in empty)


def test_sketches_merge_over_parts(spark):
    """Small parts are exact; missing cells, a column without values and a part of one row."""
    rows = [(f"p{i % 3}", float(i % 50) if i % 10 else None, f"v{i % 7}", None) for i in range(300)] + [("last", 1000.0, "new", None)]
    df = spark.createDataFrame(rows, "part string, x double, k string, gone int")
    columns = ("x", "k", "gone")
    parts = sketches.part_sketches(df, columns, "part")
    assert parts.count() == 4 * 3
    late = sketches.merged_sketches(sketches.merged_sketches(parts.filter("part <> 'last'")).unionByName(parts.filter("part = 'last'")))
    whole = sketches.sketched_profile(sketches.part_sketches(df, columns))
    for found in (by(sketches.sketched_profile(late).collect(), "column"), by(whole.collect(), "column")):
        x, k, gone = (found[c,] for c in columns)
        assert (x["rows"], x["missing"], x["distinct"], x["minimum"], x["maximum"]) == (301, 30, 46, 1.0, 1000.0)
        assert abs(x["p50"] - 25) <= 1 and (k["missing"], k["distinct"], k["p50"]) == (0, 8, None)
        assert (gone["missing"], gone["distinct"], gone["p50"]) == (301, 0, None)
    assert all(r["distinct_within"] and r["ranks_within"] in (True, None) for r in sketches.sketch_errors(df, whole, columns).collect())
    wrong = whole.withColumn("p50", F.lit(40.0))
    assert not by(sketches.sketch_errors(df, wrong, columns).collect(), "column")["x",]["ranks_within"]
    assert sketches.sketched_profile(sketches.merged_sketches(sketches.part_sketches(df.limit(0), columns, "part"))).count() == 0


def test_audit_counts_no_number_as_a_text(spark):
    """Facts of columns equal those of cell counts, odd values and copies included."""
    rows = [(1, 0.0, "a", 1.5), (1, -0.0, None, float("nan")), (1, -0.0, "b", None), (None, float("nan"), "b", 2.5), (2, 0.0, "b", 2.5), (1, 0.0, "a", 1.5)]
    df = spark.createDataFrame(rows, "k bigint, `x.y` double, t string, f float")
    counts = profile.cell_counts(df)
    for r in profile.column_facts(df).collect():
        own = [c for c in counts.collect() if c["column"] == r["column"]]
        known = [c["n"] for c in own if c["value"] is not None]
        assert r["total_rows"] == 6 and r["unique"] == len(known) and r["top"] == max(c["n"] for c in own)
        assert r["missing"] == 6 - sum(known) and r["repeated"] == sum(known) - len(known)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_duplicates_by_hash_or_by_whole_rows(spark, monkeypatch, most):
    monkeypatch.setattr(relations, "MAX_REPEATED", most)
    rows = [(1, "a", 0.0), (1, "a", -0.0), (2, None, float("nan")), (2, None, float("nan")), (2, None, float("nan")), (3, "c", 1.0)]
    df = spark.createDataFrame(rows, "k bigint, `t.u` string, x double")
    assert relations.duplicate_rows(df).first().asDict() == {"row_count": 6, "duplicate_row_count": 3, "rows_in_duplicate_groups": 5}
    assert relations.duplicate_rows(df.filter("k = 3")).first().asDict() == {"row_count": 1, "duplicate_row_count": 0, "rows_in_duplicate_groups": 0}
    assert relations.duplicate_rows(df.filter("k > 3")).first().asDict() == {"row_count": 0, "duplicate_row_count": 0, "rows_in_duplicate_groups": 0}

"""Rule boundaries, request errors, stock arithmetic and status roll-up."""

import json
import math

import pytest
from pyspark.sql import functions as F

from herdspark.operators import requests, rules


def heat_at(value, humidity=100.0):
    """The temperature that gives an index at a humidity of 100 %."""
    return (value - 32) / 1.8


def test_heat_classes_at_their_bounds(spark):
    rows = spark.createDataFrame([(74.999,), (75.0,), (75.001,), (79.999,), (80.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "v double")
    assert [r[0] for r in rows.select(rules.interval_class(F.col("v"))).collect()] == ["T0", "T0", "T1", "T1", "T2", None, None, None, None]


def test_heat_errors(spark):
    cases = [
        (None, 50.0, "TEMPERATURE_MISSING"), (20.0, None, "HUMIDITY_MISSING"), (math.nan, 50.0, "TEMPERATURE_INVALID"),
        (20.0, math.inf, "HUMIDITY_INVALID"), (20.0, -0.1, "HUMIDITY_OUT_OF_RANGE"), (20.0, 100.1, "HUMIDITY_OUT_OF_RANGE"),
        (20.0, 0.0, None), (20.0, 100.0, None), (1e308, 50.0, "THI_CALCULATION_FAILED"),
    ]
    df = spark.createDataFrame([(i, t, h) for i, (t, h, _) in enumerate(cases)], "i int, t double, h double")
    found = rules.with_heat(df, F.col("t"), F.col("h")).orderBy("i").collect()
    assert [r["heat_error"] for r in found] == [e for _, _, e in cases]
    assert found[0]["heat_status"] == "MISSING_REQUIRED_INPUT" and found[4]["heat_status"] == "INVALID_ENVIRONMENT_INPUT"
    assert found[6]["heat_status"] == "ELIGIBLE" and math.isclose(found[7]["heat_index"], 1.8 * 20 + 32)
    assert found[4]["heat_index"] is None and found[6]["heat_display"] == round(found[6]["heat_index"], 2)


def test_eligibility_order(spark):
    cases = [
        ("Dry", None, None, 50.0, ("OUT_OF_SCOPE_POPULATION", "OUT_OF_SCOPE", "POPULATION_OUT_OF_SCOPE")),
        (None, "HF50", 20.0, 50.0, ("OUT_OF_SCOPE_POPULATION", "OUT_OF_SCOPE", "POPULATION_OUT_OF_SCOPE")),
        ("Early_Lactation", " ", None, 50.0, ("MISSING_REQUIRED_INPUT", "UNRESOLVED", "GENETIC_GROUP_MISSING")),
        ("mid  lactation", None, 20.0, 50.0, ("MISSING_REQUIRED_INPUT", "UNRESOLVED", "GENETIC_GROUP_MISSING")),
        ("late-lactation", "HF99", None, 50.0, ("MISSING_REQUIRED_INPUT", "UNRESOLVED", "ENVIRONMENT_MISSING")),
        ("late-lactation", "HF99", 20.0, 101.0, ("INVALID_ENVIRONMENT_INPUT", "UNRESOLVED", "ENVIRONMENT_INVALID")),
        ("late-lactation", "HF99", 20.0, 50.0, ("UNKNOWN_GENETIC_GROUP", "OUT_OF_SCOPE", "GENETIC_GROUP_UNKNOWN")),
        ("late-lactation", "Local", 20.0, 50.0, ("ELIGIBLE", "LIMITED_SUPPORT", None)),
        ("late-lactation", "HF87.5", 20.0, 50.0, ("ELIGIBLE", "IN_SCOPE", None)),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, s string, g string, t double, h double")
    found = rules.with_eligibility(rules.with_heat(df, F.col("t"), F.col("h")), F.col("s"), F.col("g")).orderBy("i").collect()
    assert [(r["eligibility"], r["scope"], r["fallback_reason"]) for r in found] == [c[4] for c in cases]
    assert found[7]["eligibility_warnings"] == ["LOCAL_LIMITED"] and found[8]["eligibility_warnings"] == []


def plan(spark, predicted, weight, milk, health="Healthy", stage="Early"):
    df = spark.createDataFrame([(predicted, weight, milk, health, stage)], "p double, w double, m double, h string, s string")
    return rules.with_feed_plan(df, *[F.col(c) for c in "pwmhs"]).first()


def test_feed_plan(spark):
    row = plan(spark, 10.0, 400.0, 10.0)
    assert (row["total_feed_kg"], row["roughage_kg"], row["concentrate_kg"]) == (10.0, 6.5, 3.5)
    assert (row["confidence_level"], row["plan_warnings"], row["mineral_mix_kg"], row["feedings_per_day"]) == ("Moderate", [], 0.1, 2)
    low, high = plan(spark, 5.0, 400.0, 4.99), plan(spark, 20.0, 400.0, 25.01)
    assert (low["total_feed_kg"], low["roughage_kg"], low["plan_warnings"]) == (6.0, 4.5, ["RAISED_TO_MINIMUM"])
    assert (high["total_feed_kg"], high["concentrate_kg"], high["feedings_per_day"]) == (16.0, 7.2, 3)
    missing = plan(spark, None, None, None, None, " ")
    assert missing["total_feed_kg"] == 10.0 and missing["confidence_level"] == "Low"
    assert missing["plan_warnings"] == ["WEIGHT_DEFAULTED", "MILK_TREATED_AS_ZERO", "PREDICTION_REPLACED_BY_WEIGHT_RULE", "HEALTH_UNKNOWN"]
    for status in rules.REVIEW_STATUSES:
        sick = plan(spark, 10.0, 349.9, 15.0, status.replace(" ", "_").upper())
        assert (sick["concentrate_kg"], sick["roughage_kg"], sick["mineral_mix_kg"]) == (3.15, 6.85, 0.05)
    assert plan(spark, 10.0, 350.0, 25.0)["concentrate_kg"] == 4.0


def test_stock(spark):
    df = spark.createDataFrame([(0.0, 10.0), (10.0, 10.0), (20.0, 10.0), (20.01, 10.0), (None, 10.0), (5.0, math.nan)], "q double, t double")
    assert [r[0] for r in df.select(rules.stock_level(F.col("q"), F.col("t"))).collect()] == [
        "Out of Stock", "Low", "Medium", "High", "Out of Stock", "High"]
    cases = [(1000.0, "decrease", None, "kg", 900.0, None), (1000.0, "increase", None, "", 1100.0, None), (1000.0, "restock", 350.0, "kg", 1350.0, None),
             (95.0, "decrease", None, "kg", 85.5, None), (95.0, "decrease", None, "Bags", 86.0, None), (0.0, "decrease", None, "kg", 0.0, None),
             (-1.0, "increase", None, "kg", None, "STOCK_INVALID"), (1.0, "restock", 0.0, "kg", None, "AMOUNT_INVALID"),
             (999_999.0, "restock", 2.0, "kg", None, "ABOVE_MAXIMUM"), (1.0, "steal", 2.0, "kg", None, "UNKNOWN_OPERATION")]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, q double, o string, a double, u string")
    found = df.orderBy("i").select(rules.adjusted_stock(F.col("q"), F.col("o"), F.col("a"), F.col("u")).alias("n")).select("n.*").collect()
    assert [(r["quantity"], r["error"]) for r in found] == [c[4:] for c in cases]


def test_restock_quantities(spark):
    cases = [("", "kg", "QUANTITY_MISSING"), ("1e3", "kg", "NOT_NUMERIC"), ("-5", "kg", "NOT_POSITIVE"), ("1000001", "kg", "ABOVE_MAXIMUM"),
             ("1.5", "bales", "WHOLE_NUMBER_NEEDED"), ("1.234", "kg", "TOO_MANY_DECIMALS"), (" 12.50 ", "kg", None), ("+7.", "bags", None)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, q string, u string")
    found = df.orderBy("i").select(requests.restock_quantity(F.col("q"), F.col("u")).alias("r")).select("r.*").collect()
    assert [r["error"] for r in found] == [c[2] for c in cases] and found[6]["value"] == 12.5 and found[7]["value"] == 7.0


GOOD = {"breed": "Gir", "age_months": 30, "weight_kg": 400.5, "lactation_stage": "Early Lactation"}


@pytest.mark.parametrize(
    "change, errors, code",
    [
        ({}, {}, None),
        ({"age_months": None}, {"age_months": "Required field is missing."}, "MISSING_REQUIRED_FIELD"),
        ({"breed": 7}, {"breed": "Must be a string."}, "INVALID_FIELD_TYPE"),
        ({"breed": "  "}, {"breed": "Must not be empty."}, "INVALID_FIELD_RANGE"),
        ({"genetic_group": "x" * 257}, {"genetic_group": "Text value is too long."}, "INVALID_FIELD_RANGE"),
        ({"age_months": 30.5}, {"age_months": "Must be an integer."}, "INVALID_FIELD_TYPE"),
        ({"age_months": True}, {"age_months": "Must be an integer."}, "INVALID_FIELD_TYPE"),
        ({"age_months": 0}, {"age_months": "Must be greater than zero."}, "INVALID_FIELD_RANGE"),
        ({"weight_kg": "400"}, {"weight_kg": "Must be a finite number."}, "INVALID_FIELD_TYPE"),
        ({"weight_kg": -1}, {"weight_kg": "Must be greater than zero."}, "INVALID_FIELD_RANGE"),
        ({"days_in_milk": 1.5}, {"days_in_milk": "Must be an integer or null."}, "INVALID_FIELD_TYPE"),
        ({"days_in_milk": -1}, {"days_in_milk": "Must be zero or greater."}, "INVALID_FIELD_RANGE"),
        ({"previous_week_avg_yield_l": -0.5}, {"previous_week_avg_yield_l": "Must be zero or greater."}, "INVALID_FIELD_RANGE"),
        ({"body_condition_score": 5.5}, {"body_condition_score": "Must be from 1 through 5."}, "INVALID_FIELD_RANGE"),
        ({"humidity_percent": "wet"}, {"humidity_percent": "Must be a finite number or null."}, "INVALID_FIELD_TYPE"),
        ({"humidity_percent": None, "health_status": None}, {}, None),
        ({"extra": 1}, {"extra": "Unexpected field."}, "INVALID_FIELD_TYPE"),
        ({"health_status": {"a": 1}}, {"health_status": "Must be a string."}, "INVALID_FIELD_TYPE"),
    ],
)
def test_request_validation(spark, change, errors, code):
    df = spark.createDataFrame([(1, json.dumps({**GOOD, **change}))], "id int, body string")
    row = requests.validate_requests(df, "body", ["id"]).first()
    assert (row["errors"], row["error_code"], row["valid"]) == (errors, code, not errors)


def test_request_that_is_no_object(spark):
    df = spark.createDataFrame([(1, "{broken"), (2, "[1, 2]"), (3, None), (4, '"text"')], "id int, body string")
    assert {r["error_code"] for r in requests.validate_requests(df, "body", ["id"]).collect()} == {"INVALID_JSON"}


def test_prediction_guard_and_status(spark):
    df = spark.createDataFrame([(5.0,), (-1.0,), (26.0,), (math.nan,), (None,), (3.0,), (25.0,)], "v double")
    found = df.select(rules.guarded_prediction(F.col("v"), 3.0, 25.0).alias("g")).select("g.*").collect()
    assert [r["error"] for r in found] == [None, "NEGATIVE", "OUT_OF_RANGE", "NOT_FINITE", "NOT_FINITE", None, None]
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (None, None)], "a double, b double")
    status = rules.scoring_status([F.col("a"), F.col("b")])
    assert [r[0] for r in df.select(status).collect()] == ["ELIGIBLE", "PARTIAL", "FALLBACK_REQUIRED"]
    reasons = spark.createDataFrame([(["MODEL_ERROR", "GENETIC_GROUP_UNKNOWN"],), (["FEATURE_DISABLED"],), ([],)], "r array<string>")
    assert [r[0] for r in reasons.select(rules.status_message(F.lit("FALLBACK_REQUIRED"), F.col("r"))).collect()] == [
        "NEEDS_GENETIC_GROUP", "DISABLED", "UNAVAILABLE"]


def test_warning_order(spark):
    df = spark.createDataFrame([(1.0, None, ["LIMITED_SUPPORT"], ["Z", "MODEL_ERROR", "Z"])], "d double, m double, s array<string>, g array<string>")
    codes = df.select(rules.catalogue_warnings(F.col("d"), F.col("m"), F.col("s"), F.col("g"))).first()[0]
    assert codes[:3] == ["MODEL_ERROR", "BD_LOCAL_LIMITED", "BD_DMI_DRY_MATTER"] and codes.count("Z") == 1
    assert codes.index("ADVISORY_ONLY") < codes.index("Z") < codes.index("BD_TWO_FEATURE_MODEL")
    nothing = df.select(rules.catalogue_warnings(F.lit(None), F.lit(None), F.array().cast("array<string>"))).first()[0]
    assert nothing == []


def test_model_inputs(spark):
    df = spark.createDataFrame([("Gir", "30", "400", "Early", None, " "), (" ", "x", None, "Mid", "5", "60")],
                               "breed string, ageMonths string, weightKg string, lactationStage string, daysInMilk string, humidityPercent string")
    good, bad = rules.model_inputs(df).collect()
    assert (good["Days_in_Milk"], good["Humidity_percent"], good["Body_Condition_Score"], good["input_error"]) == (0.0, 70.0, 3.0, None)
    assert bad["input_error"] == "MISSING: breed, weightKg" and bad["Age_Months"] is None


def test_missing_prediction_fields(spark):
    df = spark.createDataFrame([(1.0, None)], "total_feed_kg double, roughage_kg double")
    assert df.select(requests.missing_fields(df)).first()[0] == [
        "dry_matter_intake_kg", "concentrate_kg", "roughage_kg", "crude_protein_requirement", "energy_requirement"]


def test_profile_gap(spark):
    df = spark.createDataFrame([("a", "1"), (" ", "1"), ("a", "old"), ("a", ""), ("a", None)], "t string, n string")
    assert [r[0] for r in df.select(requests.profile_gap([F.col("t")], [F.col("n")])).collect()] == [False, True, True, False, True]

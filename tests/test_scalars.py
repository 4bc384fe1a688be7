"""Scalar functions, branch by branch."""

import datetime as dt

from pyspark.sql import functions as F

from herdspark.functions import dates, text, values
from herdspark.operators.rules import WHOLE_UNITS


def as_of():
    return F.lit("2024-05-15").cast("date")


def column(spark, items, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_missing_definitions(spark):
    items = [None, "", "  \t", "NA", " n/a ", "NaN", "none", "null", "0", "x"]
    assert column(spark, items, values.missing_text) == [True] * 8 + [False, False]
    assert column(spark, items, values.missing_blank) == [True] * 3 + [False, False, True, False, False, False, False]


def test_numbers(spark):
    items = ["12", " 1e3 ", "5d", "1_0", "abc", "-inf", "Infinity", "nan", ".5", "7.", None, ""]
    found = column(spark, items, values.parse_number)
    inf = float("inf")
    assert found == [12.0, 1000.0, None, None, None, -inf, inf, None, 0.5, 7.0, None, None]
    assert column(spark, [1.0, float("nan"), inf, -inf, None], values.finite_or_null, "double") == [1.0, None, None, None, None]


def test_decimal_places(spark):
    assert column(spark, [1.0, 1.5, 0.125, 10.10, None], values.decimal_places, "double") == [0, 1, 3, 1, None]


def test_round_quantity(spark):
    rows = spark.createDataFrame([(1.005, "kg"), (2.5, "Bags "), (-0.4, "units"), (1234.565, None)], "q double, u string")
    found = [r[0] for r in rows.select(values.round_quantity(F.col("q"), F.col("u"), WHOLE_UNITS)).collect()]
    assert found[1:3] == [3.0, 0.0]
    assert abs(found[0] - 1.0) < 0.011 and found[3] == 1234.57


def test_intervals_are_right_closed(spark):
    label = lambda v: values.interval_label(v, (float("-inf"), 1, 2, float("inf")), ("a", "b", "c"))
    assert column(spark, [0.0, 1.0, 1.5, 2.0, 9.0, None], label, "double") == ["a", "a", "b", "b", "c", None]


def test_categories(spark):
    fold = lambda v: text.normalised_category(v, ["Early", "Mid"], {"Early Lactation": "Early"})
    assert column(spark, [" early ", "EARLY LACTATION", "mid", "Dry", "", None], fold) == ["Early", "Early", "Mid", "Dry", None, None]


def test_keys_and_labels(spark):
    assert column(spark, [" Crop-Residues ", "crop_residues"], text.compare_key) == ["cropresidues"] * 2
    assert column(spark, ["12.0", " 12 ", "A7", "NA", None, "1.5"], text.canonical_id) == ["12", "12", "A7", None, None, "1.5"]
    assert column(spark, ["t1 (75-80)", " T2", "cold", "n/a"], text.label_prefix) == ["T1", "T2", "cold", None]
    assert column(spark, ["HF_62.5 %", "hf62.5"], text.bare_upper) == ["HF62.5"] * 2
    assert column(spark, ["Date of_Birth", "--"], text.name_tokens) == [["date", "of", "birth"], []]
    assert column(spark, ["a, b/ c,,", None, " / "], text.list_items) == [["a", "b", "c"], [], []]
    rows = spark.createDataFrame([("7.0", "T0 (≤75)", " 3 ")], "a string, b string, c string")
    key = rows.select(text.composite_key(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert tuple(key) == ("7", "T0", "3")


def test_species_and_status(spark):
    names = ["Cow", "dairy  cow", "Cattle (Beef)", "Sheep/Goats", "Water Buffalo!", "", None]
    assert column(spark, names, text.display_species) == [
        "Dairy Cattle", "Dairy Cattle", "Cattle (Beef)", "Sheep/Goats", "Water Buffalo!", "Unknown", "Unknown"]
    assert column(spark, names, text.species_slug) == [
        "dairy-cattle", "dairy-cattle", "cattle-beef", "sheep-goats", "water-buffalo", "unknown", "unknown"]
    assert column(spark, ["cow", "Dairy Cattle", "cattle (beef)", "goat", None], text.suitable_species) == [True, True, False, False, False]
    assert column(spark, [" In Treatment", "recovered", "odd", None], text.health_status) == ["Under Treatment", "Healthy", "Healthy", "Healthy"]
    assert column(spark, ["Under_-Treatment  now"], text.status_text) == ["under treatment now"]


def test_search(spark):
    rows = spark.createDataFrame([("Bella", None), ("Max", "GIR")], "a string, b string")
    hit = lambda q: [r[0] for r in rows.filter(text.contains_any([F.col("a"), F.col("b")], q)).collect()]
    assert hit("ell") == ["Bella"] and hit(" gir ") == ["Max"] and hit("") == ["Bella", "Max"]


def test_dates_and_ages(spark):
    items = ["2024-02-29", "2023-02-29", "2024-01-02T03:04:05", "1704067200000", "soon", None]
    assert column(spark, items, dates.parsed_time) == [
        dt.datetime(2024, 2, 29), None, dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 1), None, None]
    born = ["2024-05-15", "2024-04-16", "2022-05-15", "2025-01-01", None]
    assert column(spark, born, lambda v: dates.age_months(F.to_date(v), as_of())) == [0, 0, 24, 0, None]


def test_resolved_age(spark):
    rows = spark.createDataFrame(
        [("2022-05-15", "3", "1", "x"), (" ", "10.5 months", "1", "x"), (None, None, "2", "x"), (None, None, None, "3 Years"), (None, None, None, "8"), (None, None, None, "old")],
        "b string, m string, y string, a string",
    )
    found = rows.select(dates.resolved_age_months(as_of(), [F.col("b")], [F.col("m")], [F.col("y")], F.col("a"))).collect()
    assert [r[0] for r in found] == [24, 11, 24, 36, 8, None]


def test_first_values(spark):
    rows = spark.createDataFrame([(" ", "x", "about 7.5 l"), (None, "", "-3")], "a string, b string, c string")
    assert [r[0] for r in rows.select(text.first_text([F.col("a"), F.col("b")])).collect()] == ["x", None]
    assert [r[0] for r in rows.select(values.first_number([F.col("a"), F.col("c")])).collect()] == [7.5, -3.0]


def test_strained_values(spark):
    df = spark.createDataFrame([(12345678.0, "1E7", "12345678901234567", 1e300), (2.5, "7.0", "-99999999999999999", float("nan"))], "d double, s string, e string, q double")
    row = df.select(
        text.canonical_id(F.col("d")).alias("d"), text.canonical_id(F.col("s")).alias("s"), dates.parsed_time(F.col("e")).alias("e"),
        values.decimal_places(F.col("q")).alias("p"), values.round_quantity(F.col("q"), F.lit("kg"), ["piece"]).alias("q"),
    ).collect()
    assert [tuple(r)[:3] for r in row] == [("12345678", "1E7", None), ("2.5", "7", None)]
    assert row[0]["p"] == 0 and row[0]["q"] == 1e300

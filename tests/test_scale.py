"""Steps that every row goes through are computed once per pass, whatever the number of folds and keys."""

import math

from pyspark.sql import functions as F

from herdspark.operators import metrics, modeling, summary


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bits_are_computed_once_per_pass(spark):
    values = spark.range(50).select(F.lit("a").alias("g"), F.rand(1).alias("value"), F.lit(1).cast("bigint").alias("n"))
    found = summary.quantiles_from_counts(values, ["g"], (0.5,))
    # One logarithm for each of the three passes; nested, there were hundreds.
    assert plan_of(found).count("LOG2(") <= 3


def test_staged_bits_equal_the_expression(spark):
    odd = [0.0, -0.0, 1.0, -1.5, 5e-324, -2.2e-308, 1.7e308, float("inf"), float("-inf"), float("nan"), 0.1, 3.0, None]
    frame = spark.createDataFrame([(v,) for v in odd], "v double")
    pairs = summary.with_ordered_bits(frame, "v", "staged").withColumn("plain", summary.ordered_bits(F.col("v"))).collect()
    assert len(pairs) == len(odd) and all(r["staged"] == r["plain"] for r in pairs)


def test_quantiles_without_a_fold_equal_those_of_the_other_rows(spark):
    rows = [(f, g, float((i * 37 + f) % 11) - 3 if i % 7 else None) for i in range(60) for f, g in ((i % 3 + 1, "ab"[i % 2]),)]
    frame = spark.createDataFrame([*rows, (None, "a", 1000.0)], "f int, g string, value double").withColumn("n", F.lit(1).cast("bigint"))
    got = summary.quantiles_from_counts(frame, ["g"], (0.25, 0.5), few_keys=True, without=("f", 3)).collect()
    assert {(r["heldout"], r["g"]) for r in got} == {(h, g) for h in (1, 2, 3) for g in "ab"}
    for h in (1, 2, 3):
        alone = summary.quantiles_from_counts(frame.filter(F.col("f") != h), ["g"], (0.25, 0.5)).collect()
        assert {tuple(r) for r in alone} == {(r["g"], r["p25"], r["p50"]) for r in got if r["heldout"] == h}


def test_facts_of_odd_columns(spark):
    frame = spark.createDataFrame(
        [(i % 2 + 1, 0.1, None, float(i) if i else float("inf")) for i in range(9)] + [(None, 0.1, None, 3.0)],
        "f int, same double, none double, wide double",
    )
    features = modeling.Features(numbers=("same", "none", "wide"))
    for facts in (modeling.learn_facts(frame, features)[0], modeling.learn_facts(frame, features, fold="f", folds=2)[1]):
        assert (facts.means["same"], facts.deviations["same"]) == (0.1, 0.0)
        assert (facts.medians["none"], facts.means["none"], facts.deviations["none"]) == (0.0, 0.0, 0.0)
    assert facts.rows == 4 and facts.medians["wide"] == 4.0 and facts.means["wide"] == 4.0
    assert facts.deviations["wide"] == math.sqrt(5.0)
    assert math.isnan(modeling.learn_facts(frame, features)[0].deviations["wide"])


def test_every_model_predicts_a_row_once(spark, monkeypatch):
    frame = spark.createDataFrame([(i, float(i % 5), float(3 * (i % 5) + i % 2)) for i in range(40)], "id int, x double, y double")
    calls, predict = spark.sparkContext.accumulator(0), modeling.Fitted.predict

    def counted(self, df):
        def seen(x):
            calls.add(1)
            return x

        return predict(self, df.withColumn("x", F.udf(seen, "double")("x")))

    monkeypatch.setattr(modeling.Fitted, "predict", counted)
    linear = modeling.Candidate("linear", "linear", linear=True)
    found, _ = modeling.evaluate_candidates(frame.filter("id < 30"), frame.filter("id >= 30"), modeling.Features(numbers=("x",)), "y", [linear], "id")
    assert found.first()["rows"] == 10 and calls.value == 10


def test_sums_are_the_metrics_without_the_median(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.5), ("b", 3.0, -1.0), (None, 1.0, 1.0)], "g string, y double, p double")
    sums, full = (sorted((tuple(r[c] for c in ("g", "rows", "mae", "r2")) for r in t.collect()), key=str)
                  for t in (metrics.regression_sums(frame, "y", "p", ["g"]), metrics.regression_metrics(frame, "y", "p", ["g"], few_keys=True)))
    assert sums == full

"""Exact quantiles found digit by digit, against plain sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdspark.operators import metrics, summary

EXTREMES = [0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1e-300, 1.0, 1 - 2**-53, 1 + 2**-52, 2 - 2**-52, 1e22]


def test_ordered_bits_order_like_the_values(spark):
    rng = random.Random(1)
    values = set(EXTREMES)
    for e in range(-1074, 1024, 13):
        values |= {math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0), math.nextafter(math.ldexp(1.0, e), math.inf)}
    values |= {rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(2000)}
    values = sorted({*values, *(-v for v in values), math.inf, -math.inf})
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(len(values), math.nan)], "i int, v double")
    bits = [r["b"] for r in frame.select("i", summary.ordered_bits(F.col("v")).alias("b")).orderBy("i").collect()]
    assert all(a < b for a, b in zip(bits, bits[1:], strict=False))
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "v double").select(summary.ordered_bits(F.col("v")).alias("b")).collect()
    assert zeros[0] == zeros[1]


def crowd(seed):
    rng = np.random.default_rng(seed)
    groups = {
        "even": rng.integers(0, 50, 900).astype(float), "spread": rng.normal(size=800) * 10.0 ** rng.integers(-200, 200, 800),
        "hot": np.where(rng.random(700) < 0.6, 3.25, rng.random(700)), "outlier": np.r_[rng.random(400), 1e300], "one": np.array([-7.5]),
        None: np.r_[np.full(5, -1.5), 0.0, 2.0],
    }
    return groups


@pytest.mark.parametrize("digits", [(22, 21, 21), (7,) * 8 + (8,), (16, 16, 16, 16), (64,)])
def test_equal_to_sorting_whatever_the_digits(spark, digits):
    groups = crowd(2)
    rows = [(k, float(v)) for k, found in groups.items() for v in found] + [("even", None), ("none", None)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, value double").repartition(5)
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    counts = summary.value_counts(frame, ["g"])
    got = {r["g"]: r for r in summary.quantiles_from_counts(counts, ["g"], shares, distinct=True, digits=digits).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for p in shares:
            assert math.isclose(got[key][summary.percentile_name(p)], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-300)
        assert got[key]["unique_values"] == len(set(values))
    plain = frame.withColumn("n", F.lit(1).cast("bigint"))
    rowwise = {r["g"]: r for r in summary.quantiles_from_counts(plain, ["g"], shares, digits=digits).collect()}
    assert all(rowwise[k][summary.percentile_name(p)] == got[k][summary.percentile_name(p)] for k in got for p in shares)


def test_infinite_values_are_ranked(spark):
    frame = spark.createDataFrame([(1, v) for v in (-math.inf, 1.0, math.inf, math.inf, math.inf)], "g int, value double")
    got = summary.quantiles_from_counts(summary.value_counts(frame, ["g"]), ["g"], (0.0, 0.25, 0.5, 1.0)).first()
    assert (got["p00"], got["p25"], got["p50"], got["p100"]) == (-math.inf, 1.0, math.inf, math.inf)


def test_a_count_table_is_never_longer_than_its_digit_allows(spark):
    """Distinct values far beyond 2**7 are searched with tables of at most 2**7 rows a bucket."""
    frame = spark.range(20_000).selectExpr("1 AS g", "sqrt(id) AS value", "1L AS n").repartition(4)
    found = summary.quantiles_from_counts(frame, ["g"], (0.5,), digits=(7,) * 8 + (8,))
    assert found.first()["p50"] == pytest.approx(np.quantile(np.sqrt(np.arange(20_000)), 0.5), rel=1e-12)


def test_metrics_median_of_distinct_errors(spark):
    rng = np.random.default_rng(4)
    a, p = rng.normal(size=500), rng.normal(size=500)
    frame = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, p, strict=True)], "a double, p double")
    got = metrics.regression_metrics(frame, "a", "p").first()
    assert math.isclose(got["median_absolute_error"], np.median(np.abs(a - p)), rel_tol=1e-12)

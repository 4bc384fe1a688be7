"""Column profiles as mergeable sketches, kept per part of a table and merged for later parts.

A part's sketches are a few kilobytes per column, whatever its rows; a profile of
all parts merges them and reads no row again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.values import is_number, missing_null, quoted

#: Theta sketches of 2^12 entries; the relative error of a distinct count is below
#: ``DISTINCT_ERROR`` in 99.7 % of cases (three standard errors of 1 / sqrt(4096 - 1)).
ENTRIES = 12
DISTINCT_ERROR = 0.05
#: KLL sketches with k = 800; a quantile's rank is off by less than ``RANK_ERROR`` in 99 % of cases.
KLL = 800
RANK_ERROR = 0.01


def part_sketches(df: DataFrame, columns: Sequence[str], part: str | None = None) -> DataFrame:
    """(part, column, rows, missing, theta, kll, minimum, maximum), one row per part and column.

    One pass with partial aggregation; the cells are not shuffled, only sketches are. Columns that hold no
    numbers have null ``kll``, ``minimum`` and ``maximum``. NaN counts as missing. ``part`` may be null for the whole table.
    """
    aggregates = []
    for i, c in enumerate(columns):
        value = F.when(~missing_null(df, c), quoted(c))
        number = value.cast("double") if is_number(df, c) else None
        aggregates += [
            F.count_if(value.isNull()).alias(f"m{i}"), F.theta_sketch_agg(value.cast("string"), ENTRIES).alias(f"t{i}"),
            *([F.kll_sketch_agg_double(number, KLL).alias(f"k{i}"), F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}")] if number is not None else []),
        ]
    keyed = df.select("*", (F.lit(None).cast("string") if part is None else quoted(part).cast("string")).alias("__part"))
    wide = keyed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"), *aggregates)

    def cell(i: int, c: str) -> Column:
        numeric = is_number(df, c)
        return F.struct(
            F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col(f"t{i}").alias("theta"),
            (F.col(f"k{i}") if numeric else F.lit(None).cast("binary")).alias("kll"),
            (F.col(f"lo{i}") if numeric else F.lit(None).cast("double")).alias("minimum"),
            (F.col(f"hi{i}") if numeric else F.lit(None).cast("double")).alias("maximum"),
        )

    cells = F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("c")
    return wide.select(F.col("__part").alias("part"), F.col("__rows").alias("rows"), cells).select("part", "c.column", "rows", "c.missing", "c.theta", "c.kll", "c.minimum", "c.maximum")


def merged_sketches(parts: DataFrame) -> DataFrame:
    """One row per column from the rows of any number of parts, of the same form with a null part.

    Merging is associative, so merged rows can be kept and merged with those of later parts.
    """
    return parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.theta_union_agg("theta", ENTRIES).alias("theta"),
        F.kll_merge_agg_double("kll", KLL).alias("kll"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.count("minimum").alias("__numeric"),
    ).select(
        F.lit(None).cast("string").alias("part"), "column", "rows", "missing", "theta",
        F.when(F.col("__numeric") > 0, F.col("kll")).alias("kll"), "minimum", "maximum",
    )


def sketched_profile(sketches: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(part, column, rows, missing, distinct, minimum, maximum, p25 …): what sketches tell, within the stated errors.

    A column without a number has null quantiles.
    """
    filled = F.col("kll").isNotNull() & F.col("minimum").isNotNull()
    quantiles = [
        F.when(filled, F.kll_sketch_get_quantile_double("kll", F.lit(float(r)))).alias(f"p{round(r * 100):02d}") for r in ranks
    ]
    return sketches.select(
        "part", "column", "rows", "missing", F.theta_sketch_estimate("theta").alias("distinct"), "minimum", "maximum", *quantiles
    )


def sketch_errors(df: DataFrame, profile: DataFrame, columns: Sequence[str], ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, exact_distinct, distinct_within, ranks_within): a profile's estimates against exact counts.

    The exact side counts every distinct value; it is the check, not the profile. ``profile`` has one row per column.
    """
    numeric = [c for c in columns if is_number(df, c)]
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.when(~missing_null(df, c), quoted(c)).cast("string").alias("value"),
            (F.when(~missing_null(df, c), quoted(c)).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
        )
        for c in columns
    ])
    names = [f"p{round(r * 100):02d}" for r in ranks]
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value", "c.number").agg(F.count(F.lit(1)).alias("n"))
    told = counts.filter("value is not null").join(profile.select("column", "distinct", *names), "column")
    below = [F.sum(F.when(F.col("number") < F.col(q), F.col("n")).otherwise(0)).alias(f"{q}_below") for q in names]
    upto = [F.sum(F.when(F.col("number") <= F.col(q), F.col("n")).otherwise(0)).alias(f"{q}_upto") for q in names]
    facts = told.groupBy("column").agg(
        F.count(F.lit(1)).alias("exact_distinct"), F.max("distinct").alias("__d"), F.sum("n").alias("__n"),
        F.count("number").alias("__numbers"), *below, *upto,
    )
    within = F.lit(True)
    for r, q in zip(ranks, names, strict=True):
        n = F.col("__n")
        within = within & (F.col(f"{q}_below") <= (r + RANK_ERROR) * n) & (F.col(f"{q}_upto") >= (r - RANK_ERROR) * n)
    return facts.select(
        "column", "exact_distinct", (F.abs(F.col("__d") - F.col("exact_distinct")) <= DISTINCT_ERROR * F.col("exact_distinct")).alias("distinct_within"),
        F.when(F.col("__numbers") > 0, within).alias("ranks_within"),
    )

"""Correlation, contingency, identifier and date reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdspark.functions.dates import parsed_date
from herdspark.functions.text import canonical_id
from herdspark.functions.values import finite_or_null, is_infinite, is_text, number_of, quoted
from herdspark.operators import grams
from herdspark.session import cut_lineage


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation over complete pairs; null when either side is constant.

    Every pair is one term of a single aggregation, so the source is read once.
    """
    numbers = {c: number_of(df, c) for pair in pairs for c in pair}
    wide = df.select(*[v.alias(f"c{i}") for i, v in enumerate(numbers.values())])
    place = {c: f"c{i}" for i, c in enumerate(numbers)}
    aggregates = []
    for i, (left, right) in enumerate(pairs):
        x, y = F.col(place[left]), F.col(place[right])
        both = x.isNotNull() & y.isNotNull()
        px, py = F.when(both, x), F.when(both, y)
        # From its parts: the built-in correlation fails on a constant column in ANSI mode.
        varied = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
        shared = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
        aggregates += [F.when(varied, shared).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(left).alias("left"), F.lit(right).alias("right"),
                F.col(f"n{i}").alias("pairs"), F.col(f"r{i}").alias("correlation"),
            )
            for i, (left, right) in enumerate(pairs)
        ]
    )
    return wide.agg(*aggregates).select(F.explode(rows).alias("r")).select("r.*")


#: From so many columns on, correlations come from blocks of products instead of an aggregate per pair.
WIDE = 16
#: Pairs that are checked by their own aggregates in one pass.
PAIRS_A_PASS = 200


def all_correlations(df: DataFrame, columns: Sequence[str], flag_at: float = 0.9999, wide: int = WIDE) -> DataFrame:
    """all column pairs with a flag for near-perfect ones."""
    found = correlations(df, list(combinations(columns, 2))) if len(columns) < wide else blocked_correlations(df, columns)
    strong = F.coalesce(F.abs("correlation") >= flag_at, F.lit(False))
    return found.withColumn("near_perfect", strong)


def blocked_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F10 for wide tables: (left, right, pairs, correlation) of all column pairs from two passes.

    A task multiplies its rows' values, squares and masks as matrices; every pair's sums over its complete
    rows are entries of these products. Values are taken from their column's mean, which changes no
    correlation and keeps the sums small. A pair that is nearly constant by its sums, or whose column holds an
    infinity, is answered by its own aggregates; so null still means constant, never rounding.
    """
    width = len(columns)
    wide = df.select(*[number_of(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    facts = wide.agg(
        *[
            F.struct(F.avg(finite_or_null(F.col(f"c{i}"))).alias("mean"), F.count_if(is_infinite(F.col(f"c{i}"))).alias("infinite")).alias(f"c{i}")
            for i in range(width)
        ],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    if not facts["rows"]:
        nothing = [(left, right, 0, None) for left, right in combinations(columns, 2)]
        return df.sparkSession.createDataFrame(nothing, "left string, right string, pairs bigint, correlation double")
    means = np.array([facts[i]["mean"] or 0.0 for i in range(width)])
    infinite = [i for i in range(width) if facts[i]["infinite"]]

    partial = wide.mapInArrow(_pair_products(means), "i int, block int, n array<double>, x array<double>, y array<double>, xx array<double>, yy array<double>, xy array<double>")
    sums = grams.add_blocks(partial, ["i", "block"], ["n", "x", "y", "xx", "yy", "xy"])
    cells = F.arrays_zip("n", "x", "y", "xx", "yy", "xy")
    each = sums.select("i", "block", F.posexplode(cells).alias("k", "s")).select("i", (F.col("block") * grams.BLOCK + F.col("k")).alias("j"), "s.*")
    each = cut_lineage(each.filter((F.col("j") > F.col("i")) & (F.col("j") < width)))
    n = F.nullif("n", F.lit(0.0))
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    # Rounding leaves about 1e-16 of the squares; ten thousand times as much is certainly spread.
    clear = (vx > F.col("xx") * 1e-12) & (vy > F.col("yy") * 1e-12) & ~F.col("i").isin(infinite) & ~F.col("j").isin(infinite)
    shared = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(vx * vy)
    names = F.array(*[F.lit(c) for c in columns])
    told = each.withColumn("clear", F.coalesce(clear, F.lit(False)) | (F.col("n") == 0))
    out = told.filter("clear").select(
        names[F.col("i")].alias("left"), names[F.col("j")].alias("right"), F.col("n").cast("bigint").alias("pairs"),
        F.when(F.col("n") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shared))).alias("correlation"),
    )
    # At most the number of pairs of the table's columns.
    unclear = [(columns[r["i"]], columns[r["j"]]) for r in told.filter("not clear").select("i", "j").collect()]
    for at in range(0, len(unclear), PAIRS_A_PASS):
        out = out.unionByName(correlations(df, unclear[at : at + PAIRS_A_PASS]))
    return out


def _pair_products(means: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task the sums of all pairs: rows of one column against a block of columns not before it."""
    width, block = len(means), grams.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64) - means
            m = np.isfinite(x).astype(np.float64)
            x[m == 0] = 0.0
            squares = x * x
            for k, (left, right) in enumerate(((m, m), (x, m), (m, x), (squares, m), (m, squares), (x, x))):
                held[k] += left.T @ right
        for i in range(width):
            first = i // block
            rows = grams.padded(held[:, i, first * block :]).reshape(6, -1, block)
            count = rows.shape[1]
            ends = pa.array(np.arange(count + 1, dtype=np.int32) * block)
            arrays = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows[k]).ravel())) for k in range(6)]
            place = [pa.array(np.full(count, i, np.int32)), pa.array(np.arange(first, first + count, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*place, *arrays], ["i", "block", "n", "x", "y", "xx", "yy", "xy"])

    return run


def contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    """rows per pair of values, missing values kept as their own."""
    return df.groupBy(quoted(left).alias("left"), quoted(right).alias("right")).agg(
        F.count(F.lit(1)).alias("count")
    )


def cramers_v(df: DataFrame, left: str, right: str) -> DataFrame:
    """association of two categories, one row.

    chi² = N·(Σ O²/(R·C) − 1) needs only the cells that occur, so no grid of
    all value pairs is ever built.
    """
    cells = contingency(df, left, right).filter(
        F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), F.col("count")) > 0
    )
    by_left = cells.groupBy("left").agg(F.sum("count").alias("__r"))
    by_right = cells.groupBy("right").agg(F.sum("count").alias("__c"))
    joined = cells.join(by_left, "left").join(by_right, "right")
    o = F.col("count").cast("double")
    sums = joined.agg(
        F.sum("count").cast("double").alias("n"),
        F.sum(o * o / (F.col("__r").cast("double") * F.col("__c"))).alias("ratio"),
        F.countDistinct("left").alias("left_values"),
        F.countDistinct("right").alias("right_values"),
    )
    smaller = F.least("left_values", "right_values") - 1
    value = F.when(smaller >= 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("ratio") - 1, smaller))))
    return sums.select(
        F.lit(left).alias("left"), F.lit(right).alias("right"), "left_values", "right_values", value.alias("cramers_v")
    )


def identifier_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """distinct, repeated and maximum counts of identifier columns."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]
    )
    counts = (
        df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))
    )
    n, value = F.col("n"), F.col("value")
    repeated = n > 1
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("non_missing_count"),
        F.count("value").alias("unique_non_null"),
        (F.max("n") <= 1).alias("is_unique_including_missing"),
        F.count_if(repeated).alias("distinct_repeated_values"),
        F.coalesce(F.sum(F.when(repeated, n)), F.lit(0)).alias("rows_belonging_to_repeated_values"),
        F.max("n").alias("maximum_observations_per_value"),
    )


def date_report(df: DataFrame, column: str) -> DataFrame:
    """parseable and invalid dates, range and distinct days of one column."""
    source = quoted(column)
    day = parsed_date(source) if is_text(df, column) else F.to_date(source)
    return df.select(day.alias("d")).agg(
        F.count("d").alias("parseable_count"),
        F.count_if(F.col("d").isNull()).alias("invalid_or_missing_count"),
        F.min("d").alias("minimum"),
        F.max("d").alias("maximum"),
        F.countDistinct("d").alias("unique_dates"),
    ).select(F.lit(column).alias("column"), "*")


def group_split_requirement(df: DataFrame, identifier: str, date_column: str | None = None) -> DataFrame:
    """whether repeated subjects force a split by group."""
    report = identifier_report(df, [identifier])
    repeats = F.col("distinct_repeated_values") > 0
    return report.select(
        F.lit(identifier).alias("identifier"),
        repeats.alias("group_based_split_required"),
        (repeats & F.lit(date_column is not None)).alias("repeated_observations_have_dates"),
    )


def repeated_observations(df: DataFrame, subject: str) -> DataFrame:
    """subjects, repeats and range of rows per subject, one row."""
    counts = _subject_counts(df, subject)
    return counts.agg(
        F.count(F.lit(1)).alias("unique_subjects"),
        F.count_if(F.col("n") > 1).alias("repeated_subjects"),
        F.coalesce(F.min("n"), F.lit(0)).alias("minimum_records"),
        F.coalesce(F.max("n"), F.lit(0)).alias("maximum_records"),
    ).withColumn(
        "status",
        F.when(F.col("unique_subjects") == 0, "UNCLEAR")
        .when(F.col("maximum_records") > 1, "REPEATED")
        .otherwise("NOT_REPEATED"),
    ).withColumn("grouped_validation_possible", F.col("unique_subjects") > 1)


def observations_histogram(df: DataFrame, subject: str) -> DataFrame:
    """how many subjects have how many rows."""
    return (
        _subject_counts(df, subject)
        .groupBy(F.col("n").alias("records_per_subject"))
        .agg(F.count(F.lit(1)).alias("subjects"))
    )


def _subject_counts(df: DataFrame, subject: str) -> DataFrame:
    return (
        df.select(canonical_id(quoted(subject)).alias("subject"))
        .filter("subject is not null")
        .groupBy("subject")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sequential_evidence(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """share of identifiers ending in a number, and in their own row number."""
    suffix = F.regexp_extract(quoted(column).cast("string"), r"(\d+)$", 1).try_cast("double")
    rows = df.select(suffix.alias("s"), F.col(ordinal).cast("double").alias("o"))
    total = F.count(F.lit(1))
    return rows.agg(
        F.round(F.try_divide(F.count("s") * 100.0, total), 6).alias("numeric_suffix_parseable_percentage"),
        F.round(F.try_divide(F.count_if(F.col("s") == F.col("o")) * 100.0, total), 6).alias(
            "row_order_matches_percentage"
        ),
    ).select(F.lit(column).alias("column"), "*")


#: Hashes of repeated rows that are sent to all tasks; beyond it whole rows are counted.
MAX_REPEATED = 1_000_000


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """surplus copies of identical rows and how many rows are involved.

    Rows of a hash of their own are no copies, so only hashes are counted over the
    table, and rows only where a hash repeats.
    """
    columns = [quoted(c) for c in columns or df.columns]
    hashed = F.xxhash64(*columns).alias("__h")
    by_hash = cut_lineage(
        df.select(hashed).groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
        .groupBy((F.col("__n") > 1).alias("repeated"), F.when(F.col("__n") > 1, F.col("__h")).alias("__h")).agg(F.sum("__n").alias("__n"))
    )
    repeated = by_hash.filter("repeated").select("__h")
    if repeated.count() <= MAX_REPEATED:
        rows = df.select(*columns, hashed).join(F.broadcast(repeated), "__h", "left_semi")
    else:
        rows = df.select(*columns)
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    total = by_hash.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count")).scalar()
    return counts.agg(
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_row_count"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_in_duplicate_groups"),
    ).select(total.alias("row_count"), "duplicate_row_count", "rows_in_duplicate_groups")

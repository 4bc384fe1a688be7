"""Numeric summaries, bands, grouping-set reports, quantiles and fences.

Exact quantiles never gather or order the values of a group. Values are counted
by the leading bits of a form that orders like them (partial aggregation absorbs
hot values); the bucket that holds a wanted rank is refined by the next bits
until they are used up. An outlier widens no bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdspark.functions.values import (
    finite_or_null,
    interval_label,
    is_infinite,
    number_of,
    quoted,
)

# The reported percentiles.
PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
# Bits of a value's ordered form that one step of a quantile search looks at.
DIGITS = (22, 21, 21)
LEAST_NORMAL = 2.0**-1022

# Body-weight bands in kilograms.
INF = float("inf")
WEIGHT_EDGES = (-INF, 199.999, 299.999, 399.999, 499.999, 599.999, 699.999, 799.999, INF)
WEIGHT_LABELS = (
    "<200", "200-299", "300-399", "400-499", "500-599", "600-699", "700-799", ">=800",
)


def percentile_name(p: float) -> str:
    return f"p{int(round(p * 100)):02d}"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets null keys meet; the right key columns are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    condition = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def one_group(df: DataFrame) -> DataFrame:
    """The table with one key all rows share.

    The key comes from a generator, so it stays a key: a literal would be
    folded away and leave joins without one.
    """
    return df.select("*", F.explode(F.array(F.lit(1))).alias("__all"))


def long_values(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column"
) -> DataFrame:
    """One (column, value) row per numeric cell, value as double."""
    cells = F.array(
        *[F.struct(F.lit(c).alias(name), number_of(df, c).alias("value")) for c in columns]
    )
    return df.select(*keep, F.explode(cells).alias("__cell")).select(*keep, f"__cell.{name}", "__cell.value")


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def held_out(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """Every row once for each ``heldout`` fold but its own; rows without a fold for none."""
    every = F.explode(F.array(*[F.lit(i) for i in range(1, folds + 1)]))
    return rows.select("*", every.alias("heldout")).filter(F.col(fold) != F.col("heldout"))


def counted(value: str = "value") -> Column:
    """Rows of a count table that hold a value.

    The test also reads ``n``, so it is not pushed below the aggregate: every
    branch then shares one identical count shuffle, and the source is scanned once.
    """
    return F.when(F.col(value).isNotNull(), F.col("n")) > 0


def _bit_steps(value: Column) -> list[tuple[str, Callable[[Mapping[str, Column]], Column]]]:
    """The steps from a double to its ordered bits, each with the columns it makes of the ones before."""
    return [
        ("__odd", lambda c: F.isnan(value) | (F.abs(value) == INF)),
        ("__size", lambda c: F.when(c["__odd"], F.lit(1.0)).otherwise(F.abs(value))),
        ("__guess", lambda c: F.floor(F.log2(F.greatest(c["__size"], F.lit(LEAST_NORMAL))))),
        ("__fraction", lambda c: c["__size"] / F.pow(F.lit(2.0), c["__guess"])),
        # The logarithm may be off by one next to a power of two.
        ("__off", lambda c: F.when(c["__fraction"] < 1, -1).when(c["__fraction"] >= 2, 1).otherwise(0)),
        ("__exact", lambda c: F.when(c["__off"] == -1, c["__fraction"] * 2).when(c["__off"] == 1, c["__fraction"] / 2).otherwise(c["__fraction"])),
        # Below the least normal number the fraction counts steps of 2**-1074.
        ("__plus", lambda c: F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(c["__odd"], F.lit(2047 << 52))
         .when(c["__size"] < LEAST_NORMAL, F.floor(c["__size"] * 2.0**537 * 2.0**537).cast("bigint"))
         .otherwise((c["__guess"] + c["__off"] + 1023).cast("bigint") * F.lit(1 << 52) + F.floor((c["__exact"] - 1) * float(1 << 52)).cast("bigint"))),
        ("__signed", lambda c: F.when(value < 0, -c["__plus"]).otherwise(c["__plus"])),
    ]


def ordered_bits(value: Column) -> Column:
    """A 64-bit integer for a double that orders like it: sign, exponent and fraction.

    Infinities and NaN, which counts as largest, come last; both zeros are equal.
    """
    made: dict[str, Column] = {}
    for name, step in _bit_steps(value):
        made[name] = step(made)
    return made["__signed"]


def with_ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """The table with ``ordered_bits`` of a column.

    Every step is a column: nested in one expression the steps are computed again
    for each mention, some hundred times for a value.
    """
    rows, made = df, {}
    for step_name, step in _bit_steps(F.col(value)):
        rows = rows.withColumn(step_name, step(made))
        made[step_name] = F.col(step_name)
    return rows.select(*df.columns, F.col("__signed").alias(name))


def _in_bucket(rank: Column) -> Column:
    return (rank["rank"] >= F.col("__start")) & (rank["rank"] < F.col("__start") + F.col("__n"))


def _rank_in_bucket(rank: Column) -> Column:
    return F.struct(rank["slot"].alias("slot"), (rank["rank"] - F.col("__start")).alias("rank"))


def quantiles_from_counts(
    counts: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    value: str = "value",
    distinct: bool = False,
    digits: Sequence[int] = DIGITS,
    few_keys: bool = False,
    without: tuple[str, int] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles, and on request the distinct values, per key from (key, value, n) rows.

    A wanted rank is found digit by digit. Values are counted by the first bits of
    their ordered form; the bucket that holds the rank is kept, its values are
    counted by the next bits, and so on until the bits are used up. No values are
    ordered: what is ordered is a table of counts of at most 2**bits rows, however
    many values there are and however they are spread. Rows may repeat a value, so
    plain rows with n = 1 will do where ``distinct`` is not asked for.

    With ``few_keys`` the caller vouches that the wanted buckets, two per key and
    probability, fit a broadcast; rows are then not shuffled for the later bits.
    ``without=(fold, folds)`` answers once per key and ``heldout`` fold, from the
    rows of all other folds: first counts are kept per fold and added up.
    """
    own = list(keys)
    fold = [without[0]] if without else []
    keys = ["heldout", *own] if without else own
    number = F.col(value).cast("double")
    usable = counts.filter(counted(value)).select(*fold, *own, F.col(value).alias("__value"), "n", number.alias("__double"))
    usable = with_ordered_bits(usable, "__double", "__bits").drop("__double")
    slots = [(p, upper) for p in probabilities for upper in (False, True)]
    rows, shift, by = usable, 64, keys
    for step, bits in enumerate(digits):
        shift -= bits
        prefix = F.shiftright("__bits", shift) if shift else F.col("__bits")
        carried = [] if step == 0 else ["__ranks", "__total", "__distinct"]
        found = rows.groupBy(*(by if step else [*fold, *own]), *carried, prefix.alias("__next")).agg(
            F.sum("n").alias("__n"), F.max("__value").alias("__value"), *([F.count(F.lit(1)).alias("__seen")] if step == 0 else [])
        )
        if without and step == 0:
            found = held_out(found, *without).groupBy(*by, "__next").agg(
                F.sum("__n").alias("__n"), F.max("__value").alias("__value"), F.sum("__seen").alias("__seen")
            )
        before = Window.partitionBy(*by).orderBy("__next").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        if step == 0:
            group = Window.partitionBy(*by)
            found = found.withColumns({"__total": F.sum("__n").over(group), "__distinct": F.sum("__seen").over(group)})
            places = [F.lit(float(p)) * (F.col("__total") - 1) for p, _ in slots]
            ranks = [(F.ceil(at) if upper else F.floor(at)).cast("bigint") for at, (_, upper) in zip(places, slots, strict=True)]
            found = found.withColumn(
                "__ranks", F.array(*[F.struct(F.lit(i).alias("slot"), rank.alias("rank")) for i, rank in enumerate(ranks)])
            )
        found = found.withColumn("__here", F.transform(F.filter("__ranks", _in_bucket), _rank_in_bucket)).filter(F.size("__here") > 0)
        found = found.select(*keys, F.col("__next").alias("__at"), F.col("__here").alias("__ranks"), "__total", "__distinct", "__value")
        if shift:
            by = [*keys, "__at"]
            wanted = found.drop("__value")
            rows = null_safe_join(usable.withColumn("__at", prefix), F.broadcast(wanted) if few_keys else wanted, [*own, "__at"])
            if without:
                rows = rows.filter(F.col(without[0]) != F.col("heldout"))
    picks = [F.max("__total").alias("__total"), F.max("__distinct").alias("unique_values")]
    picked = found.select(*keys, "__total", "__distinct", "__value", F.explode("__ranks").alias("__rank"))
    for i in range(len(slots)):
        picks.append(F.max(F.when(F.col("__rank.slot") == i, F.col("__value"))).alias(f"__q{i}"))
    picked = picked.groupBy(*keys).agg(*picks)
    out = []
    for i, p in enumerate(probabilities):
        low, high = F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        position = F.lit(float(p)) * (F.col("__total") - 1)
        # Equal neighbours are taken as they are: the difference of two infinities is no number.
        between = F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))
        out.append(between.alias(percentile_name(p)))
    return picked.select(*keys, *(["unique_values"] if distinct else []), *out)


def numeric_summary(
    df: DataFrame,
    value: str = "value",
    keys: Sequence[str] = (),
    probabilities: Sequence[float] = PERCENTILES,
    exact: bool = True,
    few_keys: bool = False,
) -> DataFrame:
    """Count, missing, range, mean, median, sample sd, percentiles, zeros,
    negatives and distinct values of one numeric column, per key or overall.

    ``exact=False`` answers percentiles with Spark's bounded-size sketch and
    saves the value-count shuffle on wide continuous data. ``few_keys`` is that of
    ``quantiles_from_counts``.
    """
    keys = list(keys)
    rows = df if keys else one_group(df)
    by = keys or ["__all"]
    rows = rows.select(*by, F.col(value).alias("value"))
    probabilities = sorted({*probabilities, 0.5})
    v = F.col("value")
    # One aggregate over the rows, combined before its shuffle; only quantiles need the count table.
    base = rows.groupBy(*by).agg(
        F.count(v).alias("count"),
        F.count_if(v.isNull()).alias("missing_count"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("standard_deviation"),
        F.count_if(v == 0).alias("zero_count"),
        F.count_if(v < 0).alias("negative_count"),
        *(
            []
            if exact
            else [
                F.approx_count_distinct(v).alias("unique_values"),
                F.percentile_approx(v, [float(p) for p in probabilities], 10000).alias("__q"),
            ]
        ),
    )
    if exact:
        quantiles = quantiles_from_counts(
            value_counts(rows, by), by, probabilities, distinct=True, few_keys=few_keys or not keys
        )
        full = null_safe_join(base, quantiles, by, "left").withColumn("unique_values", F.coalesce("unique_values", F.lit(0)))
    else:
        full = base.select(
            "*", *[F.col("__q")[i].alias(percentile_name(p)) for i, p in enumerate(probabilities)]
        ).drop("__q")
    rows_total = F.col("count") + F.col("missing_count")
    full = full.withColumn(
        "missing_percentage", F.round(F.col("missing_count") / rows_total * 100, 6)
    ).withColumn("median", F.col("p50"))
    order = [
        *keys, "count", "missing_count", "missing_percentage", "minimum", "maximum", "mean",
        "median", "standard_deviation", *[percentile_name(p) for p in probabilities],
        "zero_count", "negative_count", "unique_values",
    ]
    return full.select(*order)


def column_summaries(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """F4 for several numeric columns in one plan, one row per column."""
    return numeric_summary(long_values(df, columns), "value", ["column"], exact=exact)


def finite_summary(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """finite values only, rounded; non-finite cells counted apart."""
    cells = long_values(df, columns)
    infinite = cells.groupBy("column").agg(
        F.sum(F.when(is_infinite(F.col("value")), 1).otherwise(0)).alias("non_finite_count")
    )
    summary = numeric_summary(
        cells.withColumn("value", finite_or_null(F.col("value"))), "value", ["column"]
    )
    rounded = [
        F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c)
        for c, t in summary.dtypes
    ]
    return summary.select(*rounded).join(infinite, "column")


def banded_summary(
    df: DataFrame,
    band_column: str,
    value_column: str,
    edges: Sequence[float] = WEIGHT_EDGES,
    labels: Sequence[str] = WEIGHT_LABELS,
) -> DataFrame:
    """numeric summary by right-closed band of another column."""
    banded = df.select(
        interval_label(number_of(df, band_column), edges, labels).alias("group"),
        number_of(df, value_column).alias("value"),
    )
    return numeric_summary(banded, "value", ["group"])


def grouping_report(
    df: DataFrame, value_column: str, groupings: Mapping[str, str | Column], exact: bool = True, few_keys: bool = False
) -> DataFrame:
    """F8: overall and several single-column groupings in one table.

    Each row is expanded once per grouping set, as ``GROUPING SETS`` does,
    so the source is scanned once.
    """
    cells = [F.struct(F.lit("overall").alias("grouping"), F.lit("ALL").alias("group"))]
    for label, source in groupings.items():
        column = quoted(source) if isinstance(source, str) else source
        cells.append(F.struct(F.lit(label).alias("grouping"), column.cast("string").alias("group")))
    rows = df.select(
        number_of(df, value_column).alias("value"), F.explode(F.array(*cells)).alias("__g")
    ).select("__g.grouping", "__g.group", "value")
    return numeric_summary(rows, "value", ["grouping", "group"], exact=exact, few_keys=few_keys)


def outlier_fences(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """interquartile fences and how many values lie outside them."""
    counts = value_counts(long_values(df, columns), ["column"])
    quartiles = quantiles_from_counts(counts, ["column"], (0.25, 0.75))
    iqr = F.col("p75") - F.col("p25")
    fences = quartiles.select(
        "column",
        (F.col("p25") - F.lit(reach) * iqr).alias("lower_fence"),
        (F.col("p75") + F.lit(reach) * iqr).alias("upper_fence"),
    )
    v = F.col("value")
    return (
        counts.join(fences, "column")
        .groupBy("column", "lower_fence", "upper_fence")
        .agg(
            F.coalesce(F.sum(F.when(v < F.col("lower_fence"), F.col("n"))), F.lit(0)).alias("below_fence_count"),
            F.coalesce(F.sum(F.when(v > F.col("upper_fence"), F.col("n"))), F.lit(0)).alias("above_fence_count"),
        )
    )

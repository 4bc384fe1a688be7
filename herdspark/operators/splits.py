"""Deterministic stratified and grouped splits, folds and samples.

Ranks come from ``md5(seed|key)``. A rank inside a stratum is exact without
putting the stratum in one task: rows are counted per leading hash digits, the
small count table gives each hash range its starting rank, and only rows of one
hash range are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdspark.functions.values import finite_or_null, number_of
from herdspark.operators.latest import numbered
from herdspark.operators.summary import numeric_summary

SPLITS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
MATERIAL_DIFFERENCE = 0.10


class SplitError(ValueError):
    """A table cannot be split as asked."""


def draw(seed: int | str, *keys: Column) -> Column:
    """The reproducible random order of a row: md5 of the seed and its key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def ranked(
    df: DataFrame, strata: Sequence[str], key: str, seed: int | str, digits: int = 4
) -> DataFrame:
    """(strata…, key, stratum_rank, stratum_rows): exact 1-based rank by hash.

    Equal to ``row_number() OVER (PARTITION BY strata ORDER BY md5, key)``.
    """
    strata = list(strata)
    # Null strata get a text of their own, so that the window and the join use
    # the same plain keys and the rows are shuffled once.
    encoded = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"__s{i}") for i, c in enumerate(strata)]
    by = [f"__s{i}" for i in range(len(strata))]
    hashed = draw(seed, F.col(key))
    rows = df.select(*strata, key, *encoded, hashed.alias("__h"), F.substring(hashed, 1, digits).alias("__b"))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.sum("__n").over(whole).alias("stratum_rows"),
    )
    local = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key)))
    return local.join(offsets, [*by, "__b"]).select(
        *strata, key, (F.col("__start") + F.col("__rn")).alias("stratum_rank"), "stratum_rows"
    )


def check_strata(df: DataFrame, stratum: str, minimum: int = 4) -> None:
    """K1: refuse an empty table, a missing label or a class that is too small."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.col(stratum).isNull()).alias("missing"),
        F.count_if(F.col("n") < minimum).alias("small"),
    ).first()
    if facts["rows"] == 0:
        raise SplitError("cannot split an empty table")
    if facts["missing"]:
        raise SplitError(f"{stratum} has missing values")
    if facts["small"]:
        raise SplitError(f"{facts['small']} classes of {stratum} have fewer than {minimum} rows")


def split_assignments(
    df: DataFrame,
    stratum: str,
    key: str,
    seed: int = 42,
    fractions: Sequence[tuple[str, float]] = SPLITS,
    version: str = "split_v1",
    checked: bool = False,
) -> DataFrame:
    """K1: the manifest of a stratified split.

    The first share is cut at ``round(share·n)`` per stratum, and so on; every
    row gets exactly one split. ``checked`` first runs ``check_strata``.
    """
    if checked:
        check_strata(df, stratum)
    position = F.col("stratum_rank")
    chain, reached = None, 0.0
    for name, share in fractions[:-1]:
        reached += share
        limit = F.floor(F.col("stratum_rows") * F.lit(reached) + F.lit(0.5))
        chain = F.when(position <= limit, name) if chain is None else chain.when(position <= limit, name)
    return ranked(df, [stratum], key, seed).select(
        key, stratum, chain.otherwise(fractions[-1][0]).alias("split"),
        F.lit(seed).alias("random_seed"), F.lit(version).alias("split_version"),
    )


def split_checks(manifest: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """K2: rows, share, duplicates, unassigned rows and groups in several splits."""
    per_key = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("split").alias("assigned"))
    out = per_key.agg(
        F.sum("n").alias("rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.sum(F.col("n") - F.col("assigned")).alias("unassigned_rows"),
    )
    if group is None:
        return out
    crossing = manifest.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.min("split").alias("a"), F.max("split").alias("b")
    )
    overlap = crossing.agg(F.count_if(F.col("a") != F.col("b"))).scalar()
    return out.withColumn("groups_in_several_splits", overlap)


def split_shares(manifest: DataFrame) -> DataFrame:
    """K2: rows and percentage per split."""
    counts = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", F.round(F.col("count") / total * 100, 6))


def class_shares(manifest: DataFrame, label: str, by: str = "split") -> DataFrame:
    """K3: classes per split or fold with their share of it."""
    counts = manifest.groupBy(by, label).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(by))
    return counts.withColumn("percentage", F.round(F.col("count") / total * 100, 6))


def numeric_by_split(df: DataFrame, value: str, by: str = "split", digits: int = 6) -> DataFrame:
    """K4: finite summary of a number per split."""
    rows = df.select(by, finite_or_null(number_of(df, value)).alias("value"))
    summary = numeric_summary(rows, "value", [by], (0.25, 0.5, 0.75))
    wanted = ("count", "missing_count", "mean", "standard_deviation", "minimum", "p25", "median", "p75", "maximum")
    return summary.select(by, *[F.round(c, digits).alias(c) if c not in ("count", "missing_count") else F.col(c) for c in wanted])


def mean_differences(df: DataFrame, value: str, by: str = "split", limit: float = MATERIAL_DIFFERENCE) -> DataFrame:
    """K5: |mean(split) − mean| / sd, and whether it is material."""
    number = finite_or_null(number_of(df, value))
    rows = df.select(by, number.alias("value"))
    overall = rows.agg(F.struct(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))).scalar()
    grouped = rows.groupBy(by).agg(F.avg("value").alias("mean")).withColumn("__o", overall)
    difference = F.abs(F.try_divide(F.col("mean") - F.col("__o.mean"), F.col("__o.sd")))
    rounded = F.round(F.coalesce(difference, F.lit(0.0)), 6)
    return grouped.select(by, rounded.alias("standardised_difference"), (rounded > limit).alias("material"))


def training_folds(
    manifest: DataFrame, stratum: str, key: str, folds: int = 5, seed: int = 42, version: str = "fold_v1",
    training: str = "train",
) -> DataFrame:
    """K6: stratified folds over the training rows of a manifest."""
    rows = manifest.filter(F.col("split") == training)
    return ranked(rows, [stratum], key, f"{seed}-fold").select(
        key, stratum, ((F.col("stratum_rank") - 1) % folds + 1).cast("int").alias("training_fold"),
        F.lit(seed).alias("random_seed"), F.lit(version).alias("fold_version"),
    )


def group_assignments(
    df: DataFrame, group: str, holdout: float = 0.20, folds: int = 5, seed: int = 42
) -> DataFrame:
    """K7: (group, rows, partition, group_fold) with whole groups only.

    The first ⌈holdout·g⌉ groups by hash are held out. The others are dealt in
    order of size, back and forth over the folds, so that fold sizes stay close
    also when groups differ.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    drawn = ranked(sizes, [], group, seed).withColumn(
        "partition",
        F.when(F.col("stratum_rank") <= F.ceil(F.col("stratum_rows") * F.lit(holdout)), "holdout").otherwise("development"),
    )
    named = sizes.join(drawn.select(group, "partition", "stratum_rank"), group)
    # Position by size, largest first, ties by hash rank.
    by_size = [F.desc("rows"), F.asc("stratum_rank")]
    developing = numbered(named.filter("partition = 'development'"), by_size, "__pos")
    round_number = F.floor((F.col("__pos") - 1) / folds)
    step = (F.col("__pos") - 1) % folds
    fold = F.when(round_number % 2 == 0, step + 1).otherwise(F.lit(folds) - step)
    dealt = developing.select(group, fold.cast("int").alias("group_fold"))
    return named.join(dealt, group, "left").select(group, "rows", "partition", "group_fold")


def apply_groups(df: DataFrame, assignments: DataFrame, group: str) -> DataFrame:
    """K7: every row with its group's partition and fold."""
    return df.join(assignments.select(group, "partition", "group_fold"), group)


def group_checks(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """K8: proof that no group crosses a partition or fold, as (check, passed, observed)."""
    per_group = rows.groupBy(group).agg(
        F.min("partition").alias("p0"), F.max("partition").alias("p1"),
        F.min("group_fold").alias("f0"), F.max("group_fold").alias("f1"),
        F.count_if(F.col("partition").isNull()).alias("unassigned"),
        F.count_if((F.col("partition") == "development") & F.col("group_fold").isNull()).alias("no_fold"),
        F.count_if((F.col("partition") == "holdout") & F.col("group_fold").isNotNull()).alias("holdout_fold"),
    )
    totals = per_group.agg(
        F.count_if(F.col("p0") != F.col("p1")).alias("GROUPS_ACROSS_PARTITIONS"),
        F.count_if(F.col("f0") != F.col("f1")).alias("GROUPS_ACROSS_FOLDS"),
        F.sum("unassigned").alias("UNASSIGNED_ROWS"),
        F.sum("no_fold").alias("DEVELOPMENT_ROWS_WITHOUT_FOLD"),
        F.sum("holdout_fold").alias("HOLDOUT_ROWS_WITH_FOLD"),
        (F.lit(folds) - F.countDistinct("f0")).alias("EMPTY_FOLDS"),
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("observed")) for c in totals.columns]
    )
    return totals.select(F.explode(cells).alias("c")).select("c.check", (F.col("c.observed") == 0).alias("passed"), "c.observed")


def group_shares(rows: DataFrame, group: str) -> DataFrame:
    """K8: rows and groups per partition and fold."""
    per_group = rows.groupBy("partition", "group_fold", group).agg(F.count(F.lit(1)).alias("n"))
    return per_group.groupBy("partition", "group_fold").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))


def fixed_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """K9: a reproducible sample of exactly ``rows`` rows."""
    return df.withColumn("__h", draw(seed, F.col(key))).orderBy("__h", key).limit(rows).drop("__h")


def stratified_subset(df: DataFrame, stratum: str, key: str, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows with every stratum in proportion.

    Each stratum gives the floor of its share; leftover places go to the
    largest remainders, ties by stratum name.
    """
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    exact = F.col("__n") * F.lit(float(rows)) / total
    shares = counts.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    left = F.lit(rows) - F.sum("__floor").over(Window.partitionBy("__all"))
    order = Window.partitionBy("__all").orderBy((F.col("__exact") - F.col("__floor")).desc(), stratum)
    quotas = (
        shares.withColumn("__all", F.lit(1)).withColumn("__left", left).withColumn("__place", F.row_number().over(order))
        .select(stratum, (F.col("__floor") + F.when(F.col("__place") <= F.col("__left"), 1).otherwise(0)).alias("__quota"))
    )
    chosen = ranked(df, [stratum], key, seed).join(quotas, stratum).filter("stratum_rank <= __quota").select(key)
    return df.join(chosen, key, "left_semi")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes · count), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    facts = counts.agg(F.struct(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    return counts.withColumn("__f", facts).select(
        label, (F.col("__f.rows") / (F.col("__f.classes") * F.col("__n"))).alias("class_weight")
    )



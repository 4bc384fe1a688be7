"""Latest-row, due-date, ordering, top-k and upsert operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdspark.functions.text import display_species, health_status
from herdspark.functions.values import stripped
from herdspark.session import cut_lineage

EPOCH = "1970-01-01 00:00:00"


def record_time(updated: Column, created: Column) -> Column:
    """H1: the time a record counts from; none counts as the epoch."""
    return F.coalesce(updated, created, F.lit(EPOCH).cast("timestamp"))


def latest_per_key(df: DataFrame, keys: Sequence[str], time: Column, tiebreak: str) -> DataFrame:
    """H1: the newest row per key; ties go to the smallest ``tiebreak``.

    Spark trims every task to one row per key before the shuffle, so a key
    that holds a third of all rows does not meet in one task.
    """
    order = Window.partitionBy(*keys).orderBy(time.desc(), F.col(tiebreak).asc())
    return df.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def derived_health(
    animals: DataFrame, records: DataFrame, animal_key: str, record_key: str, status: str,
    time: Column, tiebreak: str, fallback: str = "Healthy",
) -> DataFrame:
    """The folded status of every animal's latest record."""
    newest = latest_per_key(records, [record_key], time, tiebreak).select(
        F.col(record_key).alias("__k"), health_status(F.col(status), fallback).alias("__s")
    )
    return animals.join(newest, F.col(animal_key) == F.col("__k"), "left").withColumn(
        "health_status", F.coalesce("__s", F.lit(fallback))
    ).drop("__k", "__s")


def latest_filled(
    df: DataFrame, keys: Sequence[str], value: str, time: Column, tiebreak: str
) -> DataFrame:
    """H2: the newest non-blank value per key."""
    filled = df.filter(stripped(F.col(value).cast("string")) != "")
    return latest_per_key(filled, keys, time, tiebreak)


def due_status(
    subjects: DataFrame, records: DataFrame, subject_key: str, record_key: str, due: Column,
    as_of: Column, days: int = 7,
) -> DataFrame:
    """H3: overdue before due soon before up to date; none recorded is its own status."""
    day = F.to_date(due)
    flags = records.groupBy(F.col(record_key).alias("__k")).agg(
        F.bool_or(F.coalesce(day < as_of, F.lit(False))).alias("__over"),
        F.bool_or(F.coalesce(day.between(as_of, F.date_add(as_of, days)), F.lit(False))).alias("__soon"),
    )
    status = (
        F.when(F.col("__over").isNull(), "No records").when(F.col("__over"), "Overdue")
        .when(F.col("__soon"), "Due Soon").otherwise("Up to date")
    )
    return subjects.join(flags, F.col(subject_key) == F.col("__k"), "left").withColumn(
        "vaccination_status", status
    ).drop("__k", "__over", "__soon")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """The whole table with each row's place in an order, from 1.

    Ranges of the order are sorted apart; the few range sizes say where each one
    begins. No task sees more than its range.
    """
    spark = df.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut_lineage(
        df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns(
            {"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}
        )
    )
    sizes = placed.groupBy("__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # One row per range.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__at") + F.col("__shift")).drop(
        "__range", "__at", "__shift"
    )


def numbered_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """As ``numbered``, from 1 in every group; a large group spreads over many ranges."""
    placed = numbered(df, [*[F.col(g) for g in groups], *order], "__place")
    first = placed.groupBy(*groups).agg(F.min("__place").alias("__lead"))
    same = [F.col(f"__g{i}").eqNullSafe(F.col(g)) for i, g in enumerate(groups)]
    renamed = first.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__lead")
    return placed.join(renamed, same).withColumn(name, F.col("__place") - F.col("__lead") + 1).drop(
        "__place", "__lead", *[f"__g{i}" for i in range(len(groups))]
    )


def newest_order(time: Column, tiebreak: str) -> list[Column]:
    """H4: newest first; no time counts as the epoch."""
    return [F.coalesce(time, F.lit(EPOCH).cast("timestamp")).desc(), F.col(tiebreak).asc()]


def newest_first(df: DataFrame, time: Column, tiebreak: str) -> DataFrame:
    """H4: the whole table with its position, newest first."""
    return numbered(df, newest_order(time, tiebreak))


def newest_first_per(df: DataFrame, groups: Sequence[str], time: Column, tiebreak: str) -> DataFrame:
    """H4: the whole table with its position in the list of its group, newest first."""
    return numbered_per_group(df, groups, newest_order(time, tiebreak))


def due_first(df: DataFrame, due: Column, tiebreak: str) -> DataFrame:
    """H5: by due date, records without one last, with the position."""
    return numbered(df, [due.asc_nulls_last(), F.col(tiebreak).asc()])


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "High", 0).when(priority == "Medium", 1).otherwise(2)


def by_priority(df: DataFrame, priority: Column, time: Column, tiebreak: str) -> DataFrame:
    """H6: High, Medium, Low; inside each the newest first, with the position."""
    return numbered(df, [priority_rank(priority), *newest_order(time, tiebreak)])


def species_rank(species: Column) -> Column:
    """H7: rank of a species label in lists."""
    folded = F.lower(species)
    return (
        F.when(folded == "dairy cattle", 0).when(folded.isin("dairy cow", "cattle (dairy)"), 1)
        .when(folded == "cow", 2).otherwise(3)
    )


def by_species(df: DataFrame, species: Column, name: Column, tiebreak: str) -> DataFrame:
    """H7: species rank, then name, with the position."""
    return numbered(df, [species_rank(species), name, F.col(tiebreak)])


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows per group, trimmed per task before the shuffle."""
    if not groups:
        return df.orderBy(*order).limit(limit)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def largest_groups(df: DataFrame, group: str, limit: int, minimum_rows: int = 0) -> DataFrame:
    """Rows of the largest groups; ties by group name."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= minimum_rows)
    chosen = counts.orderBy(F.desc("__n"), F.asc(group)).limit(limit).select(group)
    return df.join(chosen, group, "left_semi")


def first_of_code(df: DataFrame, record: str, code: str, sequence: str, priority: Sequence[str]) -> DataFrame:
    """The first row of every code per record, numbered by priority then arrival."""
    first = df.groupBy(record, code).agg(F.min(sequence).alias(sequence))
    listed = F.array(*[F.lit(p) for p in priority])
    rank = F.coalesce(F.nullif(F.array_position(listed, F.col(code)), F.lit(0)), F.lit(len(priority) + 1))
    order = Window.partitionBy(record).orderBy(rank, sequence)
    return first.withColumn("position", F.row_number().over(order))


def union_feed(parts: Sequence[DataFrame]) -> DataFrame:
    """One table from projections with the same columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def activity_feed(animals: DataFrame, batches: DataFrame) -> DataFrame:
    """Livestock added and batches created, as one activity table."""
    def rows(df, kind, prefix, title, fallback, detail):
        return df.filter(F.col("created_at").isNotNull()).select(
            "user_id",
            F.concat(F.lit(prefix), F.col("id").cast("string")).alias("activity_id"),
            F.lit(kind).alias("kind"),
            F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit(fallback)).alias("title"),
            detail.alias("detail"),
            F.col("created_at").alias("occurred_at"),
        )

    shown_id = F.coalesce(F.nullif(F.col("animal_id").cast("string"), F.lit("")), F.lit("Unavailable"))
    animal_detail = F.concat(F.lit("ID: "), shown_id, F.lit(" • "), display_species(F.col("species")))
    batch_detail = F.concat(display_species(F.col("species")), F.lit(" • "), F.col("head_count").cast("string"), F.lit(" recorded"))
    return union_feed(
        [
            rows(animals, "Livestock added", "livestock-", "animal_name", "Livestock record", animal_detail),
            rows(batches, "Batch created", "batch-", "batch_name", "Batch record", batch_detail),
        ]
    )


def owned_upsert(
    current: DataFrame, incoming: DataFrame, key: str, owner: str, time: Column, tiebreak: str
) -> DataFrame:
    """I4: incoming records replace current ones with the same key and owner.

    An incoming record whose owner differs from the current one's is ignored.
    Of the others the newest of a key wins, whoever owns it, so keys stay unique.
    """
    newest = latest_per_key(incoming, [key, owner], time, tiebreak)
    owners = current.select(F.col(key).alias("__k"), F.col(owner).alias("__o"))
    known = newest.join(owners, F.col(key) == F.col("__k"), "left")
    allowed = known.filter(F.col("__k").isNull() | F.col("__o").eqNullSafe(F.col(owner))).drop("__k", "__o")
    accepted = latest_per_key(allowed, [key], time, tiebreak)
    kept = current.join(accepted.select(key), key, "left_anti")
    return kept.unionByName(accepted.select(*current.columns))


def visible_records(df: DataFrame, owner: str, user: str, strict: bool = True) -> DataFrame:
    """A5: an owner's records; the lenient form also shows records without owner."""
    mine = F.col(owner) == user
    if strict:
        return df.filter(mine)
    unowned = F.coalesce(stripped(F.col(owner).cast("string")), F.lit("")) == ""
    return df.filter(mine | unowned)


def visible_to_owners(df: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """A5 for many owners at once."""
    return df.join(owners.select(owner).distinct(), owner, "left_semi")

"""Alerts, attention counts and overview tables for all owners at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.text import display_species, first_text
from herdspark.functions.values import finite_or_null, stripped
from herdspark.operators.joins import looked_up_rows, with_optional_dimension
from herdspark.operators.requests import profile_gap

# Health words that raise an alert, and the urgent ones.
ACTIVE_STATUSES = ("in treatment", "sick", "critical", "under treatment", "recovering")
URGENT_STATUSES = ("critical", "sick")
FOLLOW_UP_STATUSES = ("in treatment", "under treatment", "recovering")

ALERT_COLUMNS = ("user_id", "alert_id", "kind", "related_name", "priority", "message", "sort_date")


def linked_vaccinations(vaccinations: DataFrame, animals: DataFrame, batches: DataFrame) -> DataFrame:
    """Vaccination records with their animal and batch, orphans dropped."""
    with_animal = with_optional_dimension(
        vaccinations, animals.select("id", "animal_id", "animal_name"), "livestock_id", "id", "animal__"
    )
    return with_optional_dimension(with_animal, batches.select("id", "batch_name"), "batch_id", "id", "batch__")


def vaccination_alerts(linked: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Overdue and due-soon alerts with message and priority."""
    due = F.to_date(F.col("next_due_date"))
    left = F.datediff(due, as_of)
    vaccine = F.coalesce(first_text([F.col("vaccine_name")]), F.lit("Vaccination"))
    own_name = F.col("animal_name") if "animal_name" in linked.columns else F.lit(None).cast("string")
    own_batch = F.col("batch_name") if "batch_name" in linked.columns else F.lit(None).cast("string")
    is_batch = F.coalesce(F.col("target_type") == "Batch", F.lit(False)) | F.col("batch_id").isNotNull()
    related = F.coalesce(
        first_text([own_name, F.col("animal__animal_name"), own_batch, F.col("batch__batch_name")]),
        F.when(is_batch, "Batch record").otherwise("Livestock record"),
    )
    details = F.when(
        F.col("animal__animal_id").isNotNull(), F.concat(related, F.lit(" ("), F.col("animal__animal_id").cast("string"), F.lit(")"))
    ).otherwise(related)
    overdue = left < 0
    plural = F.when(left == 1, "").otherwise("s")
    message = (
        F.when(overdue, F.concat(vaccine, F.lit(" was due on "), due.cast("string"), F.lit(" for "), details, F.lit(".")))
        .when(left == 0, F.concat(vaccine, F.lit(" is due today for "), details, F.lit(".")))
        .otherwise(
            F.concat(vaccine, F.lit(" is due in "), left.cast("string"), F.lit(" day"), plural, F.lit(" for "), details, F.lit("."))
        )
    )
    return linked.filter(left <= days).select(
        "user_id",
        F.concat(F.when(overdue, "overdue-").otherwise("upcoming-"), F.col("id").cast("string")).alias("alert_id"),
        F.when(overdue, "vaccination_overdue").otherwise("vaccination_upcoming").alias("kind"),
        related.alias("related_name"),
        F.when(overdue, "High").when(left <= 3, "Medium").otherwise("Low").alias("priority"),
        message.alias("message"),
        due.alias("sort_date"),
    )


def stock_alerts(feed: DataFrame) -> DataFrame:
    """Stock at or below its threshold; records without numbers are skipped."""
    quantity, threshold = finite_or_null(F.col("quantity")), finite_or_null(F.col("low_stock_threshold"))
    name = F.coalesce(first_text([F.col("feed_name")]), F.lit("Feed item"))
    target = first_text([F.col("target_animal")])
    return feed.filter(quantity <= threshold).select(
        "user_id",
        F.concat(F.lit("feed-"), F.col("id").cast("string")).alias("alert_id"),
        F.lit("low_feed").alias("kind"),
        F.coalesce(target, name).alias("related_name"),
        F.when(quantity == 0, "High").otherwise("Medium").alias("priority"),
        F.concat(name, F.lit(" is running low")).alias("message"),
        F.lit(None).cast("date").alias("sort_date"),
    )


def health_alerts(records: DataFrame, animals: DataFrame) -> DataFrame:
    """Alerts, their urgent subset and follow-ups, one row per applicable kind.

    Records that name an unknown animal are dropped; the raw record status
    decides, not the animal's latest one.
    """
    fk = F.nullif(stripped(F.col("livestock_id").cast("string")), F.lit(""))
    known = animals.select(F.col("id").cast("string").alias("__id")).distinct()
    linked = looked_up_rows(records, fk, known, "__id", "inner")
    status = F.coalesce(first_text([F.col("recovery_status")]), F.lit("Needs review"))
    folded = F.lower(status)
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit("health_alert").alias("kind"), F.lit("health-").alias("prefix")),
            F.when(folded.isin(*URGENT_STATUSES), F.struct(F.lit("health_urgent").alias("kind"), F.lit("urgent-").alias("prefix"))),
            F.when(folded.isin(*FOLLOW_UP_STATUSES), F.struct(F.lit("health_follow_up").alias("kind"), F.lit("follow-up-").alias("prefix"))),
        )
    )
    disease = F.coalesce(first_text([F.col("disease_type")]), F.lit("Health issue"))
    return (
        linked.filter(folded.isin(*ACTIVE_STATUSES))
        .withColumn("__k", F.explode(kinds))
        .select(
            "user_id",
            F.concat(F.col("__k.prefix"), F.col("id").cast("string")).alias("alert_id"),
            F.col("__k.kind").alias("kind"),
            F.coalesce(first_text([F.col("animal_name")]), F.lit("Health record")).alias("related_name"),
            F.when(folded.isin(*URGENT_STATUSES), "High").when(folded == "recovering", "Low").otherwise("Medium").alias("priority"),
            F.concat(disease, F.lit(" - "), status).alias("message"),
            F.to_date("created_at").alias("sort_date"),
        )
    )


def alert_sections(parts: Sequence[DataFrame]) -> DataFrame:
    """All alert kinds as one table, tagged with the list they appear in."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    section = (
        F.when(F.col("kind").isin("health_urgent", "vaccination_overdue", "low_feed"), "urgent")
        .when(F.col("kind").isin("vaccination_upcoming", "health_follow_up"), "upcoming")
        .otherwise("recent")
    )
    return out.withColumn("section", section)


def attention_counts(
    animals_with_status: DataFrame, linked: DataFrame, feed: DataFrame, as_of: Column, days: int = 30
) -> DataFrame:
    """Five counts per owner, from one grouped union of partial counts."""
    due = F.to_date(F.col("next_due_date"))
    gap = profile_gap(
        [F.col(c) for c in ("animal_name", "animal_id", "species", "breed")], [F.col(c) for c in ("age", "weight")]
    )
    quantity = F.coalesce(finite_or_null(F.col("quantity")), F.lit(0.0))
    threshold = F.coalesce(finite_or_null(F.col("low_stock_threshold")), F.lit(0.0))
    names = ("overdue_vaccinations", "due_soon_vaccinations", "health_alerts", "incomplete_profiles", "low_feed_alerts")

    def part(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
        return df.groupBy("user_id").agg(
            *[(F.count_if(F.coalesce(tests[n], F.lit(False))) if n in tests else F.lit(0).cast("bigint")).alias(n) for n in names]
        )

    together = (
        part(linked, {names[0]: due < as_of, names[1]: due.between(as_of, F.date_add(as_of, days))})
        .unionByName(part(animals_with_status, {names[2]: ~F.col("health_status").isin("Healthy", "No Health Records"), names[3]: gap}))
        .unionByName(part(feed, {names[4]: quantity <= threshold}))
    )
    return together.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in names])


def upcoming_vaccinations(linked: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """H8: due within the window, with its label; the caller takes the first six."""
    due = F.to_date(F.col("next_due_date"))
    return linked.filter(due.between(as_of, F.date_add(as_of, days))).select(
        "user_id", "id", due.alias("due_date"),
        F.when(due <= F.date_add(as_of, 7), "Due within 7 days").otherwise("Due within 30 days").alias("status"),
    )


def species_overview(animals: DataFrame) -> DataFrame:
    """Animals per owner and shown species."""
    return animals.groupBy("user_id", display_species(F.col("species")).alias("label")).agg(
        F.count(F.lit(1)).alias("count")
    )


def batch_overview(batches: DataFrame) -> DataFrame:
    """Batches and recorded heads per owner."""
    heads = F.coalesce(finite_or_null(F.col("head_count").cast("double")), F.lit(0.0))
    return batches.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_batches"), F.sum(heads).alias("recorded_head_count")
    )


def stock_series(feed: DataFrame) -> DataFrame:
    """Quantity against threshold per feed item; no number counts as 0."""
    return feed.select(
        "user_id",
        F.coalesce(first_text([F.col("feed_name")]), F.lit("Feed item")).alias("name"),
        F.coalesce(finite_or_null(F.col("quantity")), F.lit(0.0)).alias("quantity"),
        F.coalesce(finite_or_null(F.col("low_stock_threshold")), F.lit(0.0)).alias("threshold"),
    )

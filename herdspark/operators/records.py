"""Stored records of several shapes brought to one, with defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.dates import resolved_age_months
from herdspark.functions.text import display_species, first_text, suitable_species
from herdspark.functions.values import first_number, quoted


def _given(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named columns a table has; a null text stands in when it has none."""
    return [quoted(n) for n in names if n in df.columns] or [F.lit(None).cast("string")]


def normalised_livestock(df: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """Animals of a suitable species under one set of columns.

    Every field has several accepted source columns, the first filled one
    counts. Records without an own number or name get the key and a default.
    """
    species = F.coalesce(first_text(_given(df, ("species", "animal_type", "type"))), F.lit(""))
    age = _given(df, ("age",))[0]
    months = resolved_age_months(
        as_of, _given(df, ("birth_date", "date_of_birth", "dob")), _given(df, ("age_months", "age_in_months")),
        _given(df, ("age_years", "age_in_years")), age,
    )
    rows = df.withColumn("__species", species)
    return rows.filter(suitable_species(F.col("__species"))).select(
        key,
        F.coalesce(first_text(_given(df, ("animal_id", "tag_id"))), F.col(key).cast("string")).alias("animal_id"),
        F.coalesce(first_text(_given(df, ("animal_name", "name"))), F.lit("Unnamed Animal")).alias("animal_name"),
        display_species(F.col("__species")).alias("species"),
        F.coalesce(first_text(_given(df, ("breed",))), F.lit("")).alias("breed"),
        months.alias("age_months"),
        first_number(_given(df, ("weight_kg", "weight"))).alias("weight_kg"),
        F.coalesce(first_text(_given(df, ("user_id",))), F.lit("")).alias("user_id"),
    )


# Health record fields with their defaults.
HEALTH_DEFAULTS = {
    "livestock_id": "", "animal_name": "Unknown Animal", "disease_type": "Unspecified Issue", "symptoms": "",
    "treatment": "", "medicine": "", "vet_notes": "", "recovery_status": "In Treatment", "user_id": "",
}


def normalised_health(df: DataFrame, key: str = "id", keep: Sequence[str] = ("created_at", "updated_at")) -> DataFrame:
    """Health records with every text trimmed and its default filled in."""
    texts = [F.coalesce(first_text(_given(df, (n,))), F.lit(d)).alias(n) for n, d in HEALTH_DEFAULTS.items()]
    return df.select(key, *texts, *[c for c in keep if c in df.columns])


def selectable_animals(df: DataFrame, key: str = "id") -> DataFrame:
    """Animals that can be picked in a list; those without name and number are left out."""
    name = first_text(_given(df, ("animal_name", "name")))
    number = first_text(_given(df, ("animal_id", "tag_id")))
    return df.filter(name.isNotNull() | number.isNotNull()).select(
        key, F.coalesce(name, F.lit("Unnamed Animal")).alias("animal_name"), F.coalesce(number, F.col(key).cast("string")).alias("animal_id")
    )

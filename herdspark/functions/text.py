"""Text, label, key and category functions as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from herdspark.functions.values import missing_text, stripped

# Species spellings shown as dairy cattle.
DAIRY_SPELLINGS = ("dairy cow", "cow", "cattle (dairy)")

# Species with a filter key of their own.
SPECIES_SLUGS = {
    "dairy cattle": "dairy-cattle",
    "cattle (beef)": "cattle-beef",
    "sheep/goats": "sheep-goats",
    "chicken": "chicken",
    "duck": "duck",
    "swine": "swine",
}

# Words that rule a species out before the allow-list is read.
UNSUITABLE_WORDS = ("sheep", "goat", "chicken", "duck", "poultry", "swine", "beef")
SUITABLE_SPECIES = ("dairy cattle", "dairy cow", "cattle (dairy)", "cow")

# Recorded health words and the status each folds to.
HEALTH_STATUSES = {
    "critical": "Critical",
    "sick": "Sick",
    "in treatment": "Under Treatment",
    "under treatment": "Under Treatment",
    "quarantined": "Under Treatment",
    "recovering": "Recovering",
    "recovered": "Healthy",
    "healthy": "Healthy",
}


def literal_map(mapping: Mapping[str, str]) -> Column:
    """A map column from a small fixed mapping."""
    parts: list[Column] = []
    for key, value in mapping.items():
        parts += [F.lit(key), F.lit(value)]
    return F.create_map(*parts)


def literal_lists(mapping: Mapping[str, Sequence[str]]) -> Column:
    """A map column from names to lists of texts."""
    parts: list[Column] = []
    for key, values in mapping.items():
        parts += [F.lit(key), F.array(*[F.lit(v) for v in values])]
    return F.create_map(*parts)


def looked_up(value: Column, mapping: Mapping[str, str]) -> Column:
    """Map lookup, null when the key is unknown."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_map(mapping), value)


def normalised_category(
    value: Column, allowed: Sequence[str], value_map: Mapping[str, str] | None = None
) -> Column:
    """Trim, blank to null, approved map, approved spelling, else kept."""
    text = stripped(value.cast("string"))
    mapped = text
    if value_map:
        folded = {k.lower(): v for k, v in value_map.items()}
        mapped = F.coalesce(looked_up(F.lower(text), folded), text)
    spelled = F.coalesce(looked_up(F.lower(mapped), {a.lower(): a for a in allowed}), mapped)
    return F.when(text != "", spelled)


def compare_key(value: Column) -> Column:
    """D3: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]+", "")


def name_tokens(value: Column) -> Column:
    """Lower-case words of a column name."""
    spaced = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def canonical_id(value: Column) -> Column:
    """Trimmed text, a whole number without its fraction, missing as null.

    A floating number is read as a number, because its text has an exponent from
    ten millions on; ``1E7`` in a text column stays the text it is.
    """
    text = stripped(value.cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?\d+)\.0+$", 1)
    number = text.try_cast("double")
    integral = F.when(number % 1 == 0, number.try_cast("decimal(38,0)").cast("string"))
    shown = F.when(F.typeof(value).isin("double", "float"), F.coalesce(integral, text)).otherwise(
        F.when(whole != "", whole).otherwise(text)
    )
    return F.when(~missing_text(value), shown)


def label_prefix(value: Column, pattern: str = r"(?i)^\s*(T[012])") -> Column:
    """The leading class label in upper case, or the trimmed text."""
    found = F.upper(F.regexp_extract(value.cast("string"), pattern, 1))
    plain = stripped(value.cast("string"))
    return F.when(~missing_text(value), F.when(found != "", found).otherwise(plain))


def bare_upper(value: Column) -> Column:
    """Upper-case without blanks, underscores and percent signs."""
    return F.when(
        ~missing_text(value), F.translate(F.upper(stripped(value.cast("string"))), "_ %", "")
    )


def composite_key(subject: Column, label: Column, part: Column) -> Column:
    """One comparable key from canonical parts."""
    part_text = F.when(~missing_text(part), stripped(part.cast("string")))
    return F.struct(
        canonical_id(subject).alias("subject"),
        label_prefix(label).alias("label"),
        part_text.alias("part"),
    )


def first_text(values: Sequence[Column]) -> Column:
    """The first non-blank text."""
    return F.coalesce(*[F.nullif(stripped(v.cast("string")), F.lit("")) for v in values])


def display_species(species: Column) -> Column:
    """Dairy spellings folded to one label, blank as ``Unknown``."""
    text = F.coalesce(stripped(species), F.lit(""))
    folded = F.regexp_replace(F.lower(text), r"\s+", " ")
    return (
        F.when(folded.isin(*DAIRY_SPELLINGS), F.lit("Dairy Cattle"))
        .when(text == "", F.lit("Unknown"))
        .otherwise(text)
    )


def species_slug(species: Column) -> Column:
    """The species filter key."""
    folded = F.trim(F.regexp_replace(F.lower(display_species(species)), r"\s+", " "))
    dashed = F.regexp_replace(folded, "[^a-z0-9]+", "-")
    return F.coalesce(
        looked_up(folded, SPECIES_SLUGS), F.regexp_replace(dashed, "^-+|-+$", "")
    )


def suitable_species(species: Column) -> Column:
    """Deny words first, then the exact allow-list."""
    folded = F.coalesce(F.lower(species), F.lit(""))
    return ~folded.rlike("|".join(UNSUITABLE_WORDS)) & folded.isin(*SUITABLE_SPECIES)


def health_status(status: Column, fallback: str = "Healthy") -> Column:
    """Recorded words folded to the known statuses, else the fallback."""
    return F.coalesce(looked_up(F.lower(stripped(status)), HEALTH_STATUSES), F.lit(fallback))


def status_text(value: Column) -> Column:
    """Lower-case words, ``_`` and ``-`` as blanks, runs squeezed."""
    spaced = F.regexp_replace(F.lower(value), "[_-]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def list_items(value: Column) -> Column:
    """Items between commas and slashes; blanks dropped."""
    parts = F.transform(F.split(value, "[,/]"), lambda p: stripped(p))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def contains_any(columns: Sequence[Column], needle: str) -> Column:
    """Case-insensitive search over several text columns; blank finds all."""
    wanted = needle.strip().lower()
    hit = F.lit(wanted == "")
    for column in columns:
        hit = hit | F.coalesce(F.lower(column.cast("string")).contains(wanted), F.lit(False))
    return hit

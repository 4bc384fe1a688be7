"""Row-level quality issues, ingredient lists and cross-table findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.text import canonical_id, list_items
from herdspark.functions.values import missing_blank, number_of, quoted
from herdspark.operators.joins import id_coverage


def _finding(test: Column, field: str, issue: str, value: Column, severity: str) -> Column:
    return F.when(
        F.coalesce(test, F.lit(False)),
        F.struct(F.lit(field).alias("field"), F.lit(issue).alias("issue_type"),
                 value.cast("string").alias("value"), F.lit(severity).alias("severity")),
    )


def row_issues(
    df: DataFrame,
    ordinal: str,
    key: str,
    numeric_text: Sequence[str] = (),
    nonnegative: Sequence[str] = (),
    doubtful_zero: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """missing, text in numbers, negative and zero values, and repeated keys."""
    columns = list(columns or [c for c in df.columns if c != ordinal])
    findings = [
        _finding(missing_blank(quoted(c)), c, "MISSING_VALUE", quoted(c), "WARNING") for c in columns
    ]
    for c in numeric_text:
        number = number_of(df, c)
        bad = ~missing_blank(quoted(c)) & (number.isNull() | (number < 0))
        findings.append(_finding(bad, c, "TEXT_IN_NUMERIC_COLUMN", quoted(c), "ERROR"))
    for c in nonnegative:
        findings.append(_finding(number_of(df, c) < 0, c, "NEGATIVE_PHYSICAL_VALUE", quoted(c), "ERROR"))
    for c in doubtful_zero:
        findings.append(_finding(number_of(df, c) == 0, c, "ZERO_VALUE", quoted(c), "WARNING"))
    per_row = df.select(
        F.col(ordinal).cast("string").alias("source_row"), quoted(key).cast("string").alias("identifier"),
        F.explode(F.array_compact(F.array(*findings))).alias("i"),
    ).select("source_row", "identifier", "i.*")
    return per_row.unionByName(repeated_keys(df, key))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """one finding per key value that several rows share."""
    counts = df.groupBy(quoted(key).cast("string").alias("identifier")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("identifier is not null and n > 1").select(
        F.lit("MULTIPLE").alias("source_row"), "identifier", F.lit(key).alias("field"),
        F.lit("DUPLICATE_SAMPLE_IDENTIFIER").alias("issue_type"), F.col("n").cast("string").alias("value"),
        F.lit("WARNING").alias("severity"),
    )


def _repeats(items: Column) -> Column:
    """The items of a list that occur more than once, sorted.

    Sorted neighbours are compared, so a long list costs a sort and not a
    search per item.
    """
    ordered = F.array_sort(items)
    shifted = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))).alias("a"), shifted.alias("b"))
    same = F.filter(pairs, lambda p: p["a"] == p["b"])
    return F.array_distinct(F.transform(same, lambda p: p["a"]))


def list_issues(df: DataFrame, column: str, keys: Sequence[str], items: Column | None = None) -> DataFrame:
    """missing lists and lists that repeat an item, ignoring case."""
    source = quoted(column)
    parts = list_items(source) if items is None else items
    repeated = _repeats(F.transform(parts, lambda p: F.lower(p)))
    missing = missing_blank(source)
    rows = df.select(*keys, missing.alias("__m"), F.when(~missing, repeated).alias("__r"), source.cast("string").alias("__v"))
    return rows.filter(F.col("__m") | (F.size("__r") > 0)).select(
        *keys,
        F.lit(column).alias("field"),
        F.when(F.col("__m"), "MISSING_INGREDIENT_LIST").otherwise("REPEATED_INGREDIENT_IN_SAMPLE").alias("issue_type"),
        F.when(F.col("__m"), F.col("__v")).otherwise(F.array_join("__r", ", ")).alias("value"),
        F.when(F.col("__m"), "ERROR").otherwise("WARNING").alias("severity"),
    )


def list_summary(df: DataFrame, column: str, items: Column | None = None) -> DataFrame:
    """samples, items, distinct items and samples that repeat one, in one row."""
    parts = list_items(quoted(column)) if items is None else items
    rows = df.select(parts.alias("p"))
    lowered = F.transform(F.col("p"), lambda x: F.lower(x))
    totals = rows.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("token_count"),
        F.count_if(F.size(F.array_distinct(lowered)) < F.size("p")).alias("samples_with_repeated_tokens"),
    )
    unique = item_counts(df, column, items).agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.withColumn("unique_token_count", unique)


def item_counts(df: DataFrame, column: str, items: Column | None = None) -> DataFrame:
    """how often every item occurs."""
    parts = list_items(quoted(column)) if items is None else items
    return df.select(F.explode(parts).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))


def top_items(df: DataFrame, column: str, limit: int = 20, items: Column | None = None) -> DataFrame:
    """the most frequent items; ties by item."""
    return item_counts(df, column, items).orderBy(F.desc("count"), F.asc("item")).limit(limit)


def uncovered_ids(left: DataFrame, right: DataFrame, left_key: str, right_key: str, ordinal: str, severity: str = "HIGH") -> DataFrame:
    """rows of either table whose identifier the other one lacks."""
    l, r = canonical_id(quoted(left_key)), canonical_id(quoted(right_key))
    only = id_coverage(left, right, l, r)

    def rows(df: DataFrame, side: str, key: Column, name: str) -> DataFrame:
        ids = only.filter(F.col("side") == side).select(F.col("id").alias("identifier"))
        return df.select(F.lit(side).alias("side"), F.col(ordinal).alias("source_row"), key.alias("identifier")).join(
            ids, "identifier", "left_semi"
        ).select("side", "source_row", "identifier", F.lit(name).alias("field"))

    both = rows(left, "left_only", l, left_key).unionByName(rows(right, "right_only", r, right_key))
    return both.withColumn("issue_type", F.lit("CROSS_TABLE_ID_COVERAGE_MISMATCH")).withColumn("severity", F.lit(severity))


def label_variants(df: DataFrame, column: str, canonical: Column, ordinal: str) -> DataFrame:
    """one representative row per spelling that differs from its canonical form."""
    source = quoted(column).cast("string")
    return (
        df.select(source.alias("label"), canonical.alias("canonical"), F.col(ordinal).alias("source_row"))
        .filter("label <> canonical")
        .groupBy("label", "canonical")
        .agg(F.min("source_row").alias("source_row"), F.count(F.lit(1)).alias("rows"))
    )


def mixed_id_types(df: DataFrame, column: str) -> DataFrame:
    """identifiers written as numbers beside identifiers written as text."""
    text = quoted(column).cast("string")
    kind = F.when(text.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), "number").otherwise("text")
    return df.filter(text.isNotNull()).groupBy(kind.alias("cell_type")).agg(F.count(F.lit(1)).alias("rows"))

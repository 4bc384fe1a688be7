"""Value cleaning that keeps every row, with a long issue log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.text import normalised_category
from herdspark.functions.values import (
    finite_number,
    finite_or_null,
    is_infinite,
    is_text,
    number_of,
    quoted,
    stripped,
)
from herdspark.operators.contracts import HERD, FieldContract, TableContract


def contract_fields(df: DataFrame, contract: TableContract) -> list[FieldContract]:
    return [f for f in contract.fields.values() if f.name in df.columns]


def cleaned_category(item: FieldContract) -> Column:
    return normalised_category(quoted(item.name), item.categories, item.value_map)


def clean_table(df: DataFrame, contract: TableContract = HERD) -> DataFrame:
    """Normalised categories and finite numbers; no row is dropped."""
    changed = {
        f.name: cleaned_category(f) if f.kind == "category" else finite_number(df, f.name)
        for f in contract_fields(df, contract)
    }
    return df.select(*[(changed[c] if c in changed else quoted(c)).alias(c) for c in df.columns])


def _finding(test: Column, field: str, issue: str, original: Column, new: Column, severity: str, action: str) -> Column:
    return F.when(
        test,
        F.struct(
            F.lit(field).alias("field"), F.lit(issue).alias("issue_type"),
            original.cast("string").alias("original_value"), new.cast("string").alias("normalized_value"),
            F.lit(severity).alias("severity"), F.lit(action).alias("action"),
        ),
    )


def _category_findings(item: FieldContract) -> list[Column]:
    source = quoted(item.name).cast("string")
    text = stripped(source)
    new = cleaned_category(item)
    empty = source.isNotNull() & (text == "")
    filled = source.isNotNull() & (text != "")
    changed = filled & (new != source)
    only_blanks = (text != source) & (text == new)
    none = F.lit(None).cast("string")
    return [
        _finding(empty, item.name, "EMPTY_STRING", source, none, "WARNING", "SET_TO_MISSING"),
        _finding(changed & only_blanks, item.name, "SURROUNDING_WHITESPACE", source, new, "INFO", "NORMALIZED"),
        _finding(changed & ~only_blanks, item.name, "APPROVED_CATEGORY_NORMALIZATION", source, new, "INFO", "NORMALIZED"),
        _finding(filled & ~new.isin(*item.categories), item.name, "UNKNOWN_CATEGORY", source, new, "WARNING", "PRESERVED"),
    ]


def _number_findings(df: DataFrame, name: str) -> list[Column]:
    source = quoted(name)
    number = number_of(df, name)
    infinite = F.coalesce(is_infinite(number), F.lit(False))
    none = F.lit(None).cast("string")
    out = [_finding(infinite, name, "NON_FINITE_NUMERIC_VALUE", source, none, "ERROR", "SET_TO_MISSING")]
    if is_text(df, name):
        out += [
            _finding(source.isNotNull() & number.isNull(), name, "INVALID_NUMERIC_VALUE", source, none, "ERROR", "SET_TO_MISSING"),
            _finding(finite_or_null(number).isNotNull(), name, "NUMERIC_STRING", source, number, "INFO", "NORMALIZED"),
        ]
    return out


def cleaning_issues(
    df: DataFrame, contract: TableContract = HERD, keys: Sequence[str] = ("source_row_number", "cattle_id")
) -> DataFrame:
    """One row per changed or doubtful value, by ``keys``."""
    findings: list[Column] = []
    for item in contract_fields(df, contract):
        findings += _category_findings(item) if item.kind == "category" else _number_findings(df, item.name)
    kept = [k for k in keys if k in df.columns]
    return df.select(*kept, F.explode(F.array_compact(F.array(*findings))).alias("i")).select(*kept, "i.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by action and by issue type in one table."""
    cells = F.array(
        F.struct(F.lit("action").alias("kind"), F.col("action").alias("name")),
        F.struct(F.lit("issue_type").alias("kind"), F.col("issue_type").alias("name")),
    )
    return issues.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.name").agg(F.count(F.lit(1)).alias("count"))


def preservation_evidence(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows in, rows out, and keys that were lost or gained."""
    left = before.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    right = after.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    both = left.join(right, key, "full_outer").fillna(0, ["a", "b"])
    return both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("input_row_count"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("output_row_count"),
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("rows_dropped"),
        F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("rows_added"),
    )



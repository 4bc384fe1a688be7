"""Contract validation: one pass over the rows, one verdict table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdspark.functions.text import looked_up
from herdspark.functions.values import is_infinite, is_text, missing_null, number_of, quoted, stripped
from herdspark.operators.contracts import HERD, INFERENCE, FieldContract, TableContract

SAMPLE_ROWS = 5
SAMPLE_VALUES = 5
LISTED_VALUES = 10


@dataclass(frozen=True)
class Check:
    """One value test of one field."""

    field: str
    issue: str
    severity: str
    action: str
    test: Column
    keeps_rows: bool = True
    keeps_values: bool = True


def _action(severity: str, otherwise: str = "PRESERVED") -> str:
    return "REJECTED_BY_SCHEMA" if severity == "ERROR" else otherwise


def category_checks(df: DataFrame, item: FieldContract, is_target: bool, mode: str, need_value: bool) -> list[Check]:
    """E2, E3, E11."""
    source = quoted(item.name).cast("string")
    exact = source.isin(*item.categories)
    text = stripped(source)
    known = looked_up(F.lower(text), {c.lower(): c for c in item.categories}).isNotNull()
    severity = "ERROR" if is_target and mode != INFERENCE else "WARNING"
    checks = [
        Check(item.name, "UNKNOWN_CATEGORY", severity, _action(severity), source.isNotNull() & ~known, keeps_rows=False),
        Check(item.name, "CATEGORY_FORMAT_VARIANT", "WARNING", "NORMALIZED", known & ~exact, keeps_rows=False),
    ]
    if need_value:
        blank = source.isNull() | (text == "")
        checks.append(Check(item.name, "MISSING_REQUIRED_CATEGORY", "ERROR", _action("ERROR"), blank, keeps_values=False))
    return checks


def number_checks(df: DataFrame, item: FieldContract, mode: str, required: bool) -> list[Check]:
    """E4, E5, E6, E7, E8, E9, E10."""
    name = item.name
    number = number_of(df, name)
    present = number.isNotNull()
    invalid = (quoted(name).isNotNull() & number.isNull()) if is_text(df, name) else F.lit(False)
    absent = quoted(name).isNull() if is_text(df, name) else missing_null(df, name)
    missing_severity = "ERROR" if required else "WARNING"
    checks = [
        Check(name, "NON_FINITE_NUMERIC_VALUE", "ERROR", _action("ERROR"), present & is_infinite(number)),
        Check(name, "MISSING_NUMERIC_VALUE", missing_severity, _action(missing_severity), absent, keeps_values=False),
    ]
    if is_text(df, name):
        checks.insert(0, Check(name, "INVALID_NUMERIC_VALUE", "ERROR", _action("ERROR"), invalid))
    if item.nonnegative:
        checks.append(Check(name, "HARD_INVALID_NEGATIVE", "ERROR", _action("ERROR"), present & (number < 0)))
    if item.percentage:
        checks.append(Check(name, "HARD_INVALID_HUMIDITY", "ERROR", _action("ERROR"), present & ~number.between(0, 100)))
    outside = F.lit(False)
    if item.minimum is not None:
        outside = outside | (number < F.lit(float(item.minimum)))
    if item.maximum is not None:
        outside = outside | (number > F.lit(float(item.maximum)))
    if item.minimum is not None or item.maximum is not None:
        severity = "ERROR" if mode == INFERENCE and item.hard_range_at_inference else "WARNING"
        checks.append(Check(name, "CONTRACT_RANGE_VIOLATION", severity, _action(severity), present & outside))
    if item.warn_zero:
        checks.append(Check(name, "ZERO_SYNTHETIC_MILK_TARGET", "WARNING", "PRESERVED", present & (number == 0), keeps_values=False))
    return checks


def model_checks(df: DataFrame, model: str, mode: str, contract: TableContract, need_target: bool) -> list[Check]:
    """All value checks of one model's fields that the table has."""
    spec = contract.model(model)
    names = [*spec.features, *([spec.target] if spec.target not in spec.features else [])]
    checks: list[Check] = []
    for name in names:
        if name not in df.columns or name not in contract.fields:
            continue
        item = contract.fields[name]
        is_target = name == spec.target
        if item.kind == "category":
            need = need_target if is_target else (mode != INFERENCE or item.required)
            checks += category_checks(df, item, is_target, mode, need)
        else:
            required = need_target if is_target else item.required
            checks += number_checks(df, item, mode, required)
    return checks


def schema_findings(columns: list[str], model: str, mode: str, contract: TableContract, need_target: bool) -> list[tuple]:
    """Findings that follow from the column names alone."""
    spec = contract.model(model)
    repeated = sorted({c for c in columns if columns.count(c) > 1})
    if repeated:
        return [("__schema__", "DUPLICATE_CANONICAL_COLUMNS", "ERROR", "REJECTED_BY_SCHEMA", len(repeated), repeated)]
    if mode == INFERENCE:
        needed = [f for f in spec.features if contract.fields[f].required]
    else:
        needed = list(spec.features)
    missing = [f for f in needed if f not in columns]
    if need_target and spec.target not in columns:
        missing.append(spec.target)
    found = []
    if missing:
        found.append(("__schema__", "MISSING_REQUIRED_FIELDS", "ERROR", "REJECTED_BY_SCHEMA", len(missing), missing))
    if mode == INFERENCE:
        supplied = sorted(set(contract.targets) & set(columns))
        if supplied:
            found.append(("__schema__", "TARGET_FIELDS_FORBIDDEN_AT_INFERENCE", "ERROR", "REJECTED_BY_SCHEMA", len(supplied), supplied))
    expected = {*spec.features, *contract.traceability, *([spec.target] if need_target else [])}
    unexpected = sorted(set(columns) - expected)
    if unexpected:
        found.append(("__schema__", "UNEXPECTED_FIELDS", "INFO", "PRESERVED", len(unexpected), unexpected))
    return found


RESULT = (
    "field string, issue_type string, severity string, action string, affected_count bigint, "
    "sample_values array<string>, sample_rows array<bigint>"
)


def value_findings(df: DataFrame, checks: list[Check], ordinal: str) -> DataFrame:
    """The failing checks of every row, exploded: one scan for all checks."""
    cells = [
        F.when(
            c.test,
            F.struct(
                F.lit(i).alias("check"),
                (quoted(c.field).cast("string") if c.keeps_values else F.lit(None).cast("string")).alias("value"),
            ),
        )
        for i, c in enumerate(checks)
    ]
    return df.select(
        F.col(ordinal).cast("bigint").alias("row"), F.explode(F.array_compact(F.array(*cells))).alias("f")
    ).select("row", "f.check", "f.value")


def _bounded_list(ranked: DataFrame, name: str, value: str, order: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return ranked.groupBy("check").agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def validate_table(
    df: DataFrame,
    model: str,
    mode: str,
    ordinal: str,
    contract: TableContract = HERD,
    need_target: bool | None = None,
) -> DataFrame:
    """E12 over E2 to E11: one row per (field, issue) with counts and bounded samples.

    Findings are counted per (check, value) with partial aggregation; samples
    come from a top-k per check that Spark trims before the shuffle.
    """
    need_target = mode != INFERENCE if need_target is None else need_target
    spark = df.sparkSession
    schema = schema_findings(list(df.columns), model, mode, contract, need_target)
    schema_rows = spark.createDataFrame([(*f, None) for f in schema], RESULT)
    if any(f[1] == "DUPLICATE_CANONICAL_COLUMNS" for f in schema):
        return schema_rows
    checks = model_checks(df, model, mode, contract, need_target)
    if not checks:
        return schema_rows
    found = value_findings(df, checks, ordinal)
    by_value = found.groupBy("check", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    counts = by_value.groupBy("check").agg(F.sum("n").alias("affected_count"))
    # Format findings list values alphabetically; numeric ones take the first seen.
    listed = [i for i, c in enumerate(checks) if c.keeps_values and not c.keeps_rows]
    sampled = [i for i, c in enumerate(checks) if c.keeps_values and c.keeps_rows]
    rowed = [i for i, c in enumerate(checks) if c.keeps_rows]
    is_listed = F.col("check").isin(listed)
    key = F.when(~is_listed, F.col("first_row"))
    rank = F.row_number().over(Window.partitionBy("check").orderBy(key, "value"))
    head = by_value.filter(F.col("check").isin([*listed, *sampled])).withColumn("rank", rank).filter(
        F.col("rank") <= LISTED_VALUES
    ).filter(is_listed | (F.col("rank") <= SAMPLE_VALUES))
    values = _bounded_list(head, "sample_values", "value", "value")
    first = Window.partitionBy("check").orderBy("row")
    rows_head = (
        found.filter(F.col("check").isin(rowed)).withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= SAMPLE_ROWS)
    )
    rows = _bounded_list(rows_head, "sample_rows", "row", "rank")
    named = [
        F.element_at(F.array(*[F.lit(pick(c)) for c in checks]), F.col("check") + 1).alias(label)
        for label, pick in _LABELS
    ]
    verdict = counts.join(values, "check", "left").join(rows, "check", "left").select(
        *named, "affected_count", "sample_values", "sample_rows"
    )
    return schema_rows.unionByName(verdict)


_LABELS: tuple[tuple[str, Callable[[Check], str]], ...] = (
    ("field", lambda c: c.field),
    ("issue_type", lambda c: c.issue),
    ("severity", lambda c: c.severity),
    ("action", lambda c: c.action),
)


def verdict(findings: DataFrame) -> DataFrame:
    """Valid flag, error and warning counts of a findings table."""
    return findings.agg(
        (F.count_if(F.col("severity") == "ERROR") == 0).alias("valid"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.coalesce(F.sum(F.when(F.col("severity") == "ERROR", F.col("affected_count"))), F.lit(0)).alias("error_rows"),
    )

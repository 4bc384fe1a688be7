"""Rule-based quality checks, near-constant columns and the audit composite."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.text import looked_up
from herdspark.functions.values import is_number, is_text, missing_null, number_of
from herdspark.operators.catalogue import leakage_classes
from herdspark.operators.mapping import candidate_presence
from herdspark.operators.profile import cell_counts, column_facts, spelling_groups
from herdspark.operators.relations import all_correlations, duplicate_rows


@dataclass(frozen=True)
class Rule:
    """M2: a named predicate over one or more numeric columns."""

    issue: str
    columns: tuple[str, ...]
    predicate: Callable[..., Column]
    evidence: str = ""
    severity: str = "WARNING"

    @property
    def label(self) -> str:
        return " + ".join(self.columns)


_INTERVAL = re.compile(r"([\[(])([^,]+),([^,]+)([\])])")


def in_intervals(value: Column, text: str) -> Column:
    """Whether a number lies in one of some intervals, written like ``(-inf,0) [5,5] (20,inf)``."""
    hit = F.lit(False)
    for opening, low, high, closing in _INTERVAL.findall(text):
        a, b = F.lit(float(low)), F.lit(float(high))
        above = value >= a if opening == "[" else value > a
        below = value <= b if closing == "]" else value < b
        hit = hit | ((above if float(low) != float("-inf") else F.lit(True)) & (below if float(high) != float("inf") else F.lit(True)))
    return hit


def interval_rule(issue: str, tests: Sequence[tuple[str, str]], severity: str = "WARNING", whole: bool = False) -> Rule:
    """A rule that flags rows whose every column lies in its intervals; ``whole`` also flags fractions."""
    def predicate(*values: Column) -> Column:
        hit = F.lit(True)
        for value, (_, text) in zip(values, tests, strict=True):
            hit = hit & in_intervals(value, text)
        return hit | (F.floor(values[0]) != values[0]) if whole else hit

    shown = " and ".join(f"{column} in {text.replace(' ', ' or ')}" for column, text in tests)
    return Rule(issue, tuple(c for c, _ in tests), predicate, f"Flagged: {shown}{' or not whole' if whole else ''}.", severity)


def multiple_rule(issue: str, larger: str, smaller: str, factor: float, severity: str = "WARNING") -> Rule:
    """A rule that flags rows where one column exceeds a multiple of another."""
    return Rule(issue, (larger, smaller), lambda a, b: a > b * factor, f"Flagged: {larger} above {factor:g} x {smaller}.", severity)


# Issues of the herd audit, the column and the flagged intervals.
HERD_INTERVALS = (
    ("Negative age", "Age_Months", "(-inf,0)"),
    ("Zero age", "Age_Months", "[0,0]"),
    ("Implausible age", "Age_Months", "(0,12) (300,inf)"),
    ("Negative weight", "Weight_kg", "(-inf,0)"),
    ("Zero weight", "Weight_kg", "[0,0]"),
    ("Implausible weight", "Weight_kg", "(0,50) (1200,inf)"),
    ("Negative milk yield", "Milk_Yield_L", "(-inf,0)"),
    ("Zero milk yield", "Milk_Yield_L", "[0,0]"),
    ("Suspiciously high milk yield", "Milk_Yield_L", "(100,inf)"),
    ("Negative feed quantity", "Feed_Quantity_kg", "(-inf,0)"),
    ("Zero feed quantity", "Feed_Quantity_kg", "[0,0]"),
    ("Suspiciously high feed quantity", "Feed_Quantity_kg", "(100,inf)"),
    ("Negative days in milk", "Days_in_Milk", "(-inf,0)"),
    ("Suspiciously high days in milk", "Days_in_Milk", "(730,inf)"),
    ("Humidity outside 0-100", "Humidity_percent", "(-inf,0) (100,inf)"),
    ("Implausible ambient temperature", "Ambient_Temperature_C", "(-inf,-20) (55,inf)"),
    ("Body-condition score outside detected 1-5 scale", "Body_Condition_Score", "(-inf,1) (5,inf)"),
)


def herd_rules() -> list[Rule]:
    """the rules of the herd audit."""
    return [
        *[interval_rule(issue, [(column, intervals)]) for issue, column, intervals in HERD_INTERVALS],
        interval_rule("Invalid parity", [("Parity", "(-inf,0) (20,inf)")], whole=True),
        multiple_rule("Impossible age/lactation combination", "Days_in_Milk", "Age_Months", 31, "ERROR"),
        interval_rule("Impossible young-age/parity combination", [("Parity", "(0,inf)"), ("Age_Months", "(-inf,18)")], "ERROR"),
    ]


# Facts a scan cannot settle, always reported as unclear.
HERD_UNCLEAR = (
    ("Mixed or undocumented feed units", "Feed_Quantity_kg"),
    ("Mixed or undocumented milk-yield period", "Milk_Yield_L"),
)


def _finish(rows: DataFrame) -> DataFrame:
    share = F.when(F.col("total_rows") > 0, F.round(F.col("affected_rows") / F.col("total_rows") * 100, 6))
    status = F.when(F.col("affected_rows") > 0, "FLAGGED").otherwise("PASS")
    return rows.select(
        "issue", "column", F.coalesce(F.col("status"), status).alias("status"), "severity",
        "affected_rows", share.alias("percentage"), "evidence",
    )


def rule_checks(
    df: DataFrame, rules: Sequence[Rule], unclear: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Every rule of a table in one aggregation, one row per rule.

    Single-column rules on an absent column read ``NOT_APPLICABLE``; rules over
    several columns are left out when one of them is absent.
    """
    active = [r for r in rules if all(c in df.columns for c in r.columns)]
    absent = [r for r in rules if r not in active and len(r.columns) == 1]
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[
            F.count_if(F.coalesce(r.predicate(*[number_of(df, c) for c in r.columns]), F.lit(False))).alias(f"r{i}")
            for i, r in enumerate(active)
        ],
    )

    def cell(issue, column, count, severity, evidence, status=None):
        return F.struct(
            F.lit(issue).alias("issue"), F.lit(column).alias("column"),
            F.lit(status).cast("string").alias("status"), F.lit(severity).alias("severity"),
            count.cast("bigint").alias("affected_rows"), F.lit(evidence).alias("evidence"),
        )

    none = F.lit(None)
    cells = [cell(r.issue, r.label, F.col(f"r{i}"), r.severity, r.evidence) for i, r in enumerate(active)]
    cells += [
        cell(r.issue, r.label, none, "INFO", "Column absent; check not applicable.", "NOT_APPLICABLE")
        for r in absent
    ]
    cells += [cell(i, c, none, "WARNING", "Not stated by the source.", "UNCLEAR") for i, c in unclear]
    return _finish(
        counted.select("total_rows", F.explode(F.array(*cells)).alias("c")).select("total_rows", "c.*")
    )


def constancy_checks(df: DataFrame, columns: Sequence[str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """constant, near-constant and very-high-cardinality columns; ``facts`` are those of ``column_facts``."""
    columns = list(columns or df.columns)
    if facts is None:
        stats = cell_counts(df, columns).groupBy("column").agg(
            F.count("value").alias("unique"), F.max("n").alias("top"), F.sum("n").alias("rows")
        )
    else:
        stats = facts.select("column", "unique", "top", F.col("total_rows").alias("rows"))
    share = F.col("top") / F.col("rows")
    numeric = {c: "y" for c in columns if is_number(df, c)}
    is_numeric = F.coalesce(looked_up(F.col("column"), numeric) == "y", F.lit(False))
    many = F.col("unique") > F.greatest(F.lit(1000), F.floor(F.col("rows") * F.lit(0.20)))

    def cell(issue, count, test):
        return F.when(test, F.struct(F.lit(issue).alias("issue"), count.cast("bigint").alias("affected_rows")))

    cells = F.array_compact(
        F.array(
            cell("Constant column", F.col("rows"), F.col("unique") <= 1),
            cell("Near-constant column", F.col("top"), (F.col("unique") > 1) & (share >= 0.999)),
            cell("Extremely high-cardinality categorical column", F.col("unique"), ~is_numeric & many),
        )
    )
    rows = stats.select("column", F.col("rows").alias("total_rows"), F.explode(cells).alias("c"))
    return _finish(
        rows.select("column", "total_rows", "c.*", F.lit(None).cast("string").alias("status"),
                    F.lit("WARNING").alias("severity"),
                    F.lit("Counted over all rows.").alias("evidence"))
    )


def missing_checks(facts: DataFrame) -> DataFrame:
    """F25 as a check: missing cells per column, from the columns' facts."""
    rows = facts.select("column", "total_rows", F.col("missing").alias("affected_rows"))
    return _checked(rows, "Missing values", "Null, NaN or a text that stands for none.")


def identifier_checks(facts: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """F13 as a check: rows that repeat an identifier, from the columns' facts."""
    rows = facts.select("column", "total_rows", F.col("repeated").alias("affected_rows"))
    return _checked(rows.filter(F.col("column").isin(*identifiers)), "Repeated identifiers", "Rows beyond the first of each identifier.")


def _checked(rows: DataFrame, issue: str, evidence: str) -> DataFrame:
    return _finish(
        rows.select(
            "column", "total_rows", "affected_rows", F.lit(issue).alias("issue"), F.lit(None).cast("string").alias("status"),
            F.lit("WARNING").alias("severity"), F.lit(evidence).alias("evidence"),
        )
    )


def leakage_checks(df: DataFrame, dataset: str, targets: Sequence[str]) -> DataFrame:
    """F29 as check rows: columns of the table that may give a target away."""
    spark = df.sparkSession
    columns = spark.createDataFrame([(dataset, c) for c in df.columns], "dataset string, column string")
    wanted = spark.createDataFrame([(dataset, t) for t in targets], "dataset string, target string")
    found = leakage_classes(columns, wanted).filter("classification in ('DEFINITE_LEAKAGE', 'POSSIBLE_LEAKAGE')")
    none = F.lit(None)
    return found.select(
        F.concat(F.lit("Leakage towards "), "target").alias("issue"), "column", F.lit("FLAGGED").alias("status"),
        F.when(F.col("classification") == "DEFINITE_LEAKAGE", "ERROR").otherwise("WARNING").alias("severity"),
        none.cast("bigint").alias("affected_rows"), none.cast("double").alias("percentage"), F.col("reason").alias("evidence"),
    )


def spelling_checks(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """F20 as a check: the number of spelling groups per text column."""
    groups = spelling_groups(df, columns, counts).select("column", "compare_key").distinct()
    found = groups.groupBy("column").agg(F.count(F.lit(1)).alias("affected_rows"))
    all_columns = df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    )
    rows = all_columns.join(found, "column", "left").select(
        "column", "total_rows", F.coalesce("affected_rows", F.lit(0)).alias("affected_rows"),
        F.lit("Inconsistent categorical spelling").alias("issue"),
        F.lit(None).cast("string").alias("status"), F.lit("WARNING").alias("severity"),
        F.lit("Groups that differ only by case, blanks or punctuation.").alias("evidence"),
    )
    return _finish(rows)


def duplicate_check(df: DataFrame) -> DataFrame:
    """F17 as a check row."""
    return _finish(
        duplicate_rows(df).select(
            F.lit("Duplicate complete rows").alias("issue"), F.lit("ALL_COLUMNS").alias("column"),
            F.lit(None).cast("string").alias("status"), F.lit("WARNING").alias("severity"),
            F.col("duplicate_row_count").alias("affected_rows"), F.col("row_count").alias("total_rows"),
            F.lit("Exact duplicate across all parsed columns.").alias("evidence"),
        )
    )


def profile_checks(df: DataFrame, counts: DataFrame) -> DataFrame:
    """F1 as check rows: type, distinct values and range of every column, from cell counts."""
    dtypes = dict(df.dtypes)
    numeric = [c for c in df.columns if is_number(df, c)]
    value, known = F.col("value"), F.col("value").isNotNull()
    number = F.when(F.col("column").isin(*numeric), F.expr("try_cast(value as double)"))
    order = F.struct(number, F.when(number.isNull(), value))
    facts = counts.groupBy("column").agg(
        F.sum("n").alias("total_rows"), F.count("value").alias("affected_rows"),
        F.min_by("value", F.when(known, order)).alias("low"), F.max_by("value", F.when(known, order)).alias("high"),
    )
    held = F.concat_ws(" to ", "low", "high")
    return _finish(
        facts.select(
            "column", "total_rows", "affected_rows", F.lit("Distinct values").alias("issue"), F.lit("INFO").alias("status"),
            F.lit("INFO").alias("severity"), F.concat_ws(": ", looked_up(F.col("column"), dtypes), F.nullif(held, F.lit(""))).alias("evidence"),
        )
    )


def empty_row_check(df: DataFrame) -> DataFrame:
    """A row without any value, as a check row."""
    empty = F.lit(True)
    for c in df.columns:
        empty = empty & missing_null(df, c)
    rows = df.agg(F.count_if(empty).alias("affected_rows"), F.count(F.lit(1)).alias("total_rows"))
    return _checked(rows.withColumn("column", F.lit("ALL_COLUMNS")), "Empty rows", "Rows whose cells are all missing.")


def blank_line_check(blanks: DataFrame) -> DataFrame:
    """A4 as a check row; ``blanks`` is the one row of ``blank_lines`` for the file behind the table."""
    rows = blanks.select(
        F.col("blank_lines").alias("affected_rows"), F.lit(None).cast("bigint").alias("total_rows"), F.lit("ALL_COLUMNS").alias("column")
    )
    return _checked(rows, "Blank lines", "Physical lines after the header that hold no text.")


def population_checks(counts: DataFrame, populations: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """F16 as check rows: rows of each population class, values that belong to none flagged."""
    member = {f"{c}\n{v}": name for c, classes in populations.items() for name, values in classes.items() for v in values}
    wanted = F.col("value").isNotNull() & F.col("column").isin(*populations)
    # The filter reads ``n``, so it stays above the counts and their shuffle is shared.
    rows = counts.filter(F.when(wanted, F.col("n")) > 0)
    found = looked_up(F.concat_ws("\n", "column", "value"), member)
    by_class = rows.groupBy("column", F.coalesce(found, F.lit("UNCLASSIFIED")).alias("class")).agg(
        F.sum("n").alias("affected_rows"), F.count(F.lit(1)).alias("values")
    )
    totals = rows.groupBy("column").agg(F.sum("n").alias("total_rows"))
    odd = F.col("class") == "UNCLASSIFIED"
    return _finish(
        by_class.join(totals, "column").select(
            "column", "total_rows", "affected_rows", F.concat(F.lit("Population "), "class").alias("issue"),
            F.when(odd, "FLAGGED").otherwise("INFO").alias("status"), F.when(odd, "WARNING").otherwise("INFO").alias("severity"),
            F.concat(F.col("values").cast("string"), F.lit(" distinct values.")).alias("evidence"),
        )
    )


def candidate_checks(
    df: DataFrame, counts: DataFrame, candidates: Mapping[str, Sequence[str]], availability: Mapping[str, str]
) -> DataFrame:
    """B15 as check rows: wanted features, the missing rows of those that are there."""
    gone = F.when(F.col("value").isNull(), F.col("n"))
    facts = counts.groupBy("column").agg(
        F.sum("n").alias("total_rows"), F.coalesce(F.sum(gone), F.lit(0)).alias("missing"), F.count("value").alias("unique_non_null")
    )
    table = facts.select(
        "column", looked_up(F.col("column"), dict(df.dtypes)).alias("data_type"),
        F.try_divide(F.col("missing") * 100.0, F.col("total_rows")).alias("missing_percentage"), "unique_non_null",
    )
    found = candidate_presence(table, candidates, availability)
    rows = found.join(facts.select(F.col("column").alias("source_column"), "missing", "total_rows"), "source_column", "left")
    safe = F.col("prediction_time_safety") == "SAFE_WITH_INPUT_VALIDATION"
    return _finish(
        rows.select(
            F.coalesce("source_column", "candidate_feature").alias("column"), "total_rows", F.col("missing").alias("affected_rows"),
            F.concat(F.lit("Candidate feature "), "candidate_feature").alias("issue"),
            F.when(~F.col("present"), "NOT_APPLICABLE").when(safe, "PASS").otherwise("FLAGGED").alias("status"),
            F.when(F.col("present") & ~safe, "WARNING").otherwise("INFO").alias("severity"),
            F.when(~F.col("present"), "No column of this name or its aliases.").otherwise(F.col("prediction_time_safety")).alias("evidence"),
        )
    )


def synthetic_checks(df: DataFrame, counts: DataFrame, balanced: Sequence[str], even: float = 0.05) -> DataFrame:
    """F32 and F10 as check rows: classes of nearly the same size, and numbers that follow each other exactly."""
    n = F.when(F.col("value").isNotNull() & F.col("column").isin(*balanced), F.col("n"))
    classes = counts.groupBy("column").agg(
        F.count(n).alias("classes"), (F.max(n) - F.min(n)).alias("affected_rows"), F.sum(n).alias("total_rows"), F.avg(n).alias("mean")
    )
    flat = (F.col("classes") > 1) & (F.col("affected_rows") <= even * F.col("mean"))
    balance = _finish(
        classes.filter(F.col("column").isin(*balanced)).select(
            "column", "total_rows", "affected_rows", F.lit("Evenly balanced classes").alias("issue"),
            F.when(flat, "FLAGGED").otherwise("PASS").alias("status"), F.lit("INFO").alias("severity"),
            F.lit("Rows between the largest and the smallest class.").alias("evidence"),
        )
    )
    numbers = [c for c in df.columns if is_number(df, c)]
    if len(numbers) < 2:
        return balance
    exact = all_correlations(df, numbers).filter("near_perfect").select(
        F.concat_ws(", ", "left", "right").alias("column"), F.col("pairs").alias("total_rows"), F.col("pairs").alias("affected_rows")
    )
    return balance.unionByName(_checked(exact, "Near-perfect correlation", "Correlation of 0.9999 or more over complete pairs."))


def table_audit(
    df: DataFrame, rules: Sequence[Rule], unclear: Sequence[tuple[str, str]] = (),
    identifiers: Sequence[str] = (), dataset: str = "table", targets: Sequence[str] = (),
) -> DataFrame:
    """all checks of one table as (section, issue, column, …) rows.

    The constancy, missing and identifier sections read one table of facts per
    column.
    """
    return _tagged(_table_sections(df, None, rules, unclear, identifiers, dataset, targets))


def dataset_audit(
    df: DataFrame, rules: Sequence[Rule], unclear: Sequence[tuple[str, str]] = (),
    identifiers: Sequence[str] = (), dataset: str = "table", targets: Sequence[str] = (),
    populations: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
    candidates: Mapping[str, Sequence[str]] | None = None, availability: Mapping[str, str] | None = None,
    balanced: Sequence[str] = (), blanks: DataFrame | None = None,
) -> DataFrame:
    """the whole audit of a dataset: those of ``table_audit``, and its profile, empty rows, blank lines of its
    file, populations, candidate features and synthetic indicators.

    ``populations`` names the known classes of a column's values, ``candidates`` the wanted features and their
    aliases. An empty table gives its sections with zero rows or none.
    """
    counts = cell_counts(df, df.columns)
    parts = _table_sections(df, counts, rules, unclear, identifiers, dataset, targets)
    parts += [("profile", profile_checks(df, counts)), ("empty rows", empty_row_check(df))]
    if blanks is not None:
        parts.append(("blank lines", blank_line_check(blanks)))
    if populations:
        parts.append(("populations", population_checks(counts, populations)))
    if candidates:
        parts.append(("candidates", candidate_checks(df, counts, candidates, availability or {})))
    if balanced:
        parts.append(("synthetic", synthetic_checks(df, counts, balanced)))
    return _tagged(parts)


def _table_sections(
    df: DataFrame, counts: DataFrame | None, rules: Sequence[Rule], unclear: Sequence[tuple[str, str]],
    identifiers: Sequence[str], dataset: str, targets: Sequence[str],
) -> list[tuple[str, DataFrame]]:
    text = [c for c in df.columns if is_text(df, c)]
    facts = column_facts(df)
    parts = [
        ("duplicates", duplicate_check(df)),
        *([("rules", rule_checks(df, rules, unclear))] if rules or unclear else []),
        ("constancy", constancy_checks(df, facts=facts)),
        ("missing", missing_checks(facts)),
    ]
    if identifiers:
        parts.append(("identifiers", identifier_checks(facts, identifiers)))
    if text:
        parts.append(("spelling", spelling_checks(df, text, counts)))
    if targets:
        parts.append(("leakage", leakage_checks(df, dataset, targets)))
    return parts


def _tagged(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for section, rows in parts:
        tagged = rows.select(F.lit(section).alias("section"), "*")
        out = tagged if out is None else out.unionByName(tagged)
    return out

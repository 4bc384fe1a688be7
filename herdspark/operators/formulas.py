"""Formula registry and reconstruction audits of stored results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.values import finite_or_null, is_text, missing_null, number_of, quoted, stripped

EXACT_TOLERANCE = 1e-9
ROUNDING_TOLERANCE = 0.01


@dataclass(frozen=True)
class Formula:
    """M1: how a stored column should follow from others.

    ``compute`` takes the numeric input columns in order and gives a number or
    a label; None stands for a formula that is stated but cannot be computed.
    """

    id: str
    domain: str
    target: str
    inputs: tuple[str, ...]
    compute: Callable[..., Column] | None
    interpretation: str = "DOCUMENTED"
    is_label: bool = False


def sql_formula(id: str, domain: str, target: str, inputs: Sequence[str], text: str) -> Formula:
    """M1: a formula written as SQL text over its input column names."""
    return Formula(id, domain, target, tuple(inputs), lambda *_: F.expr(text).cast("double"))


def _steps(value: Column, steps: Sequence[tuple[float, object]], rest: object) -> Column:
    chain = None
    for limit, result in steps:
        chain = F.when(value <= limit, F.lit(result)) if chain is None else chain.when(value <= limit, F.lit(result))
    return chain.otherwise(F.lit(rest))


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def herd_formulas() -> list[Formula]:
    """The stated formulas of the feeding study, alternatives included."""
    milk, intake, energy = "Total milk performance", "DMIcapacity (kgDM)", "MEmaint+peakmilk"
    need, maintenance = "TotalreqCP", "MW*0.589=Energyformaintenance"
    return [
        Formula("MILK-001", "MILK", "Ass.calfmilk", ("daysinmilk",),
                lambda d: _steps(d, [(60, 6.0), (90, 4.0), (120, 2.0), (200, 1.0)], 0.0)),
        Formula("MILK-002", "MILK", milk, ("Ass.calfmilk", "hand-milked yield"), lambda a, b: a + b),
        Formula("MILK-003", "MILK", "gapmilk", ("potentialmilk", milk), lambda a, b: a - b),
        Formula("MILK-004", "MILK", "%gapmilk", ("gapmilk", "potentialmilk"), _share),
        Formula("MILK-005", "MILK", "potentialmilk", (), None, "MODEL_DERIVED_UNDOCUMENTED_ALGORITHM"),
        Formula("ANIMAL-001", "ANIMAL", "MW", ("Bodyweight",), lambda w: F.pow(w, F.lit(0.75))),
        Formula("LACTATION-001", "LACTATION", "lactationperiod", ("daysinmilk",),
                lambda d: _steps(d, [(100, "Peak"), (200, "Mid")], "Late"), is_label=True),
        Formula("DMI-001", "DMI", "DMIR kg", ("Bodyweight",), lambda w: w * 0.035),
        Formula("DMI-002A", "DMI", intake, ("DM served", "leftover"), lambda a, b: a - b,
                "DOCUMENTED_DMI_INTAKE_EQUATION"),
        Formula("DMI-002B", "DMI", intake, ("NDF feeds", "Bodyweight"),
                lambda n, w: F.try_divide(F.lit(120.0), n) * w / 100.0, "DOCUMENTED_CAPACITY_EQUATION"),
        Formula("DMI-003", "DMI", "DMIindex", ("NDF feeds",), lambda n: F.try_divide(F.lit(120.0), n)),
        Formula("DMI-004", "DMI", "DMI gap", ("DMIR kg", intake), lambda a, b: a - b),
        Formula("DMI-005", "DMI", "%gapDMI", ("DMI gap", "DMIR kg"), _share),
        Formula("WATER-001", "WATER", "waterrequi.", ("DMIR kg", "potentialmilk"),
                lambda d, m: F.lit(12.3) + d * 2.15 + m * 0.73),
        Formula("WATER-002", "WATER", "gapwater", ("waterrequi.", "waterday"), lambda a, b: a - b),
        Formula("WATER-003", "WATER", "%watergap", ("gapwater", "waterrequi."), _share),
        Formula("CP-001", "PROTEIN", "Protein/content/gr/kg", ("%Protein",), lambda p: p * 10.0),
        Formula("CP-002", "PROTEIN", "Cpintakeingr", ("Protein/content/gr/kg", intake), lambda a, b: a * b),
        Formula("CP-003", "PROTEIN", "CPmaint=6.27*MW", ("MW",), lambda w: w * 6.27),
        Formula("CP-004", "PROTEIN", "CPmilk", ("potentialmilk",), lambda m: m * 82.0),
        Formula("CP-005", "PROTEIN", need, ("CPmaint=6.27*MW", "CPmilk"), lambda a, b: a + b),
        Formula("CP-006A", "PROTEIN", "gapCP", (need, "Cpintakeingr"), lambda a, b: a - b, "REPOSITORY_FORMULA"),
        Formula("CP-006B", "PROTEIN", "gapCP", (need, "CPmaint=6.27*MW"), lambda a, b: a - b, "METADATA_FORMULA"),
        Formula("CP-007", "PROTEIN", "%CP gap", ("gapCP", need), _share),
        Formula("ME-001", "ENERGY", "MEfeeds", ("G24", "%Protein"), None),
        Formula("ME-002", "ENERGY", "MEIntake", ("MEfeeds", intake), lambda a, b: a * b),
        Formula("ME-003", "ENERGY", maintenance, ("MW",), lambda w: w * 0.589),
        Formula("ME-004", "ENERGY", "5.023*peakMilk", ("potentialmilk",), lambda m: m * 5.023),
        Formula("ME-005", "ENERGY", energy, (maintenance, "5.023*peakMilk"), lambda a, b: a + b),
        Formula("ME-006", "ENERGY", "gapME", (energy, "MEIntake"), lambda a, b: a - b),
        Formula("ME-007", "ENERGY", "%MEgap", ("gapME", energy), _share),
    ]


# The formulas of the row-level consistency check.
CONSISTENCY_IDS = (
    "MILK-002", "MILK-003", "DMI-002A", "DMI-004", "WATER-002", "ME-002", "ME-005", "ME-006",
    "CP-001", "CP-002", "CP-005", "CP-006A",
)


def _status(mismatch: Column, exact: Column, close: Column, missing: Column, stored_missing: Column) -> Column:
    matched = exact + close
    return (
        F.when(matched + mismatch == 0, "NOT_REPRODUCIBLE_MISSING_INPUT")
        .when((mismatch > 0) & (matched == 0), "NOT_REPRODUCIBLE_CONFLICT")
        .when((mismatch > 0) | (missing > 0) | (stored_missing > 0), "PARTIALLY_REPRODUCIBLE")
        .when(close > 0, "REPRODUCIBLE_WITH_TOLERANCE")
        .otherwise("FULLY_REPRODUCIBLE")
    )


def expected_value(df: DataFrame, formula: Formula) -> Column:
    """What the formula gives for a row; null when an input is missing."""
    inputs = [number_of(df, c) for c in formula.inputs]
    usable = F.lit(True)
    for value in inputs:
        usable = usable & value.isNotNull()
    return F.when(usable, formula.compute(*inputs))


def audit_formulas(df: DataFrame, formulas: Sequence[Formula]) -> DataFrame:
    """Match counts and status of every formula from one aggregation."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    cells: list[Column] = []
    zero = F.lit(0).cast("bigint")
    for i, f in enumerate(formulas):
        absent = [c for c in (*f.inputs, f.target) if c not in df.columns]
        stored_known = f.target in df.columns
        if stored_known:
            aggregates.append(F.count_if(~missing_null(df, f.target)).alias(f"s{i}"))
        stored_count = F.col(f"s{i}") if stored_known else zero
        if f.compute is None or absent:
            status = "NOT_REPRODUCIBLE_MISSING_INPUT" if absent else "FORMULA_NOT_DOCUMENTED"
            missing_rows = F.col("rows") if absent else zero
            values = [zero, zero, zero, zero, missing_rows, zero, F.lit(None).cast("double"), F.lit(status)]
        else:
            expected = expected_value(df, f)
            usable = expected.isNotNull()
            stored_missing = missing_null(df, f.target)
            if f.is_label:
                stored_text = F.lower(stripped(quoted(f.target).cast("string")))
                same = stored_text == F.lower(expected)
                exact, close, difference = same, F.lit(False), F.lit(None).cast("double")
            else:
                difference = F.abs(number_of(df, f.target) - finite_or_null(expected))
                exact = F.coalesce(difference <= EXACT_TOLERANCE, F.lit(False))
                close = F.coalesce(difference <= ROUNDING_TOLERANCE, F.lit(False)) & ~exact
            compared = usable & ~stored_missing
            aggregates += [
                F.count_if(usable).alias(f"c{i}"),
                F.count_if(compared & exact).alias(f"e{i}"),
                F.count_if(compared & close).alias(f"t{i}"),
                F.count_if(compared & ~exact & ~close).alias(f"x{i}"),
                F.count_if(~usable).alias(f"m{i}"),
                F.count_if(usable & stored_missing).alias(f"n{i}"),
                F.max(F.when(compared, difference)).alias(f"d{i}"),
            ]
            e, t, x, m, n = (F.col(f"{k}{i}") for k in "etxmn")
            values = [F.col(f"c{i}"), e, t, x, m, n, F.col(f"d{i}"), _status(x, e, t, m, n)]
        names = (
            "calculable_row_count", "exact_match_count", "tolerance_match_count", "mismatch_count",
            "missing_input_row_count", "stored_missing_with_inputs_count", "maximum_absolute_difference", "status",
        )
        cells.append(
            F.struct(
                F.lit(f.id).alias("formula_id"), F.lit(f.domain).alias("domain"),
                F.lit(f.target).alias("target_field"), F.lit(f.interpretation).alias("interpretation"),
                stored_count.alias("stored_value_count"),
                F.lit("; ".join(absent)).alias("missing_required_columns"),
                *[v.alias(n) for v, n in zip(values, names)],
            )
        )
    return df.agg(*aggregates).select(F.col("rows").alias("row_count"), F.explode(F.array(*cells)).alias("c")).select(
        "row_count", "c.*"
    )


def formula_mismatches(
    df: DataFrame, formulas: Sequence[Formula], keys: Sequence[str], absolute: float = 0.01, relative: float = 1e-6
) -> DataFrame:
    """One row per stored value off by more than max(0.01, 1e-6·|expected|)."""
    cells = []
    for f in formulas:
        if f.compute is None or f.is_label or any(c not in df.columns for c in (*f.inputs, f.target)):
            continue
        expected = expected_value(df, f)
        actual = number_of(df, f.target)
        allowed = F.greatest(F.lit(absolute), F.abs(expected) * relative)
        cells.append(
            F.when(
                F.abs(actual - expected) > allowed,
                F.struct(F.lit(f.target).alias("target"), expected.alias("expected"), actual.alias("actual")),
            )
        )
    return df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("m")).select(*keys, "m.*")


def negative_readings(
    df: DataFrame,
    signed: str,
    served: str,
    stored: str,
    tolerance: float = ROUNDING_TOLERANCE,
) -> DataFrame:
    """How well each reading of negative values explains the stored result."""
    left, given, kept = number_of(df, signed), number_of(df, served), number_of(df, stored)
    rows = df.select(left.alias("l"), given.alias("g"), kept.alias("k")).filter(F.col("l") < 0)
    l, g, k = F.col("l"), F.col("g"), F.col("k")

    def matches(value: Column) -> Column:
        return F.count_if(F.abs(value - k) <= tolerance)

    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    counted = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        matches(g - l).alias("minus"), matches(g + l).alias("plus"), matches(g).alias("same"),
        F.count_if(g - l > g).alias("above"), F.count_if(g + l < 0).alias("below"),
    )
    readings = [
        ("A", "Positive refused-feed convention", F.col("minus"), F.col("above")),
        ("B", "Negative value denotes shortage or extra demand", F.col("minus"), zero),
        ("C", "Sign reversed during entry", F.col("plus"), F.col("below")),
        ("D", "Leftover already included in another derived value", F.col("same"), zero),
        ("E", "Nonstandard source convention", none, none),
    ]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("interpretation_id"), F.lit(t).alias("interpretation"),
                     m.alias("matches"), c.alias("conflicts"))
            for i, t, m, c in readings
        ]
    )
    return counted.select(F.col("rows").alias("negative_rows"), F.explode(cells).alias("c")).select("negative_rows", "c.*")


def contaminated_column(df: DataFrame, column: str, vocabulary: str) -> DataFrame:
    """text found in a number column, and whether another column explains it."""
    if not is_text(df, column):
        raise ValueError(f"{column} is not a text column")
    source, number = quoted(column), number_of(df, column)
    entry = F.when(source.isNotNull() & number.isNull(), F.lower(stripped(source)))
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(number).alias("numeric_count"),
        F.count(entry).alias("text_count"),
        F.count_if(source.isNull()).alias("missing_count"),
    )
    entries = df.select(entry.alias("entry")).filter("entry is not null").distinct()
    known = df.select(F.lower(stripped(quoted(vocabulary).cast("string"))).alias("entry")).distinct()
    flagged = entries.join(known.withColumn("__known", F.lit(1)), "entry", "left")
    overlap = flagged.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count("__known").alias("known"))
    ).scalar()
    return counts.withColumn("__o", overlap).select(
        F.lit(column).alias("column"), "row_count", "numeric_count", "text_count", "missing_count",
        F.col("__o.n").alias("unique_text_count"),
        ((F.col("__o.n") > 0) & (F.col("__o.known") == F.col("__o.n"))).alias("all_text_in_vocabulary"),
    )

"""Heat index, eligibility, ration, stock and scoring-status rules as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.text import looked_up, status_text
from herdspark.functions.values import finite_number, finite_or_null, present, quoted, round_quantity, stripped


@dataclass(frozen=True)
class Interval:
    """One class of an index; a missing bound is open."""

    label: str
    minimum: float | None
    minimum_inclusive: bool
    maximum: float | None
    maximum_inclusive: bool


# The heat classes, read on the unrounded index.
HEAT_CLASSES = (
    Interval("T0", None, False, 75.0, True),
    Interval("T1", 75.0, False, 80.0, False),
    Interval("T2", 80.0, True, None, False),
)

# Groups, stages and reasons of the eligibility gate.
GENETIC_GROUPS = ("Local", "HF50", "HF62.5", "HF75", "HF87.5")
LACTATING_STAGES = ("early lactation", "mid lactation", "late lactation")

# Statuses that call for a health review of the ration.
REVIEW_STATUSES = ("sick", "critical", "under treatment", "in treatment", "recovering")

# Units counted in whole items, and the stock limits.
WHOLE_UNITS = (
    "item", "items", "unit", "units", "piece", "pieces", "bag", "bags", "bale", "bales", "sack", "sacks",
)
STOCK_STEP = 0.1
MAX_STOCK = 1_000_000.0


def interval_class(value: Column, intervals: Sequence[Interval] = HEAT_CLASSES) -> Column:
    """The class whose interval holds the value; null outside all of them."""
    chain = None
    for item in intervals:
        tests = [F.abs(value) < float("inf")] if item.minimum is None or item.maximum is None else []
        if item.minimum is not None:
            tests.append(value >= item.minimum if item.minimum_inclusive else value > item.minimum)
        if item.maximum is not None:
            tests.append(value <= item.maximum if item.maximum_inclusive else value < item.maximum)
        inside = tests[0]
        for test in tests[1:]:
            inside = inside & test
        chain = F.when(inside, item.label) if chain is None else chain.when(inside, item.label)
    return chain


def heat_index(temperature: Column, humidity: Column) -> Column:
    """The index of a finite temperature (°C) and humidity (%)."""
    warm = temperature * 1.8
    return (warm + 32) - ((F.lit(0.55) - humidity * 0.0055) * (warm - 26))


# Heat errors in the order in which the first one counts, with
# the status and the eligibility gate each leads to.
HEAT_ERRORS = {
    "TEMPERATURE_MISSING": ("MISSING_REQUIRED_INPUT", "3"),
    "HUMIDITY_MISSING": ("MISSING_REQUIRED_INPUT", "3"),
    "TEMPERATURE_INVALID": ("INVALID_ENVIRONMENT_INPUT", "4"),
    "HUMIDITY_INVALID": ("INVALID_ENVIRONMENT_INPUT", "4"),
    "HUMIDITY_OUT_OF_RANGE": ("INVALID_ENVIRONMENT_INPUT", "4"),
    "THI_CALCULATION_FAILED": ("INVALID_ENVIRONMENT_INPUT", "4"),
    "THI_CATEGORY_UNSUPPORTED": ("UNKNOWN_THI_CATEGORY", "5"),
}


def with_heat(
    df: DataFrame,
    temperature: Column,
    humidity: Column,
    temperature_given: Column | None = None,
    humidity_given: Column | None = None,
) -> DataFrame:
    """Adds heat_error, heat_status, heat_index, heat_display and heat_class.

    The ``given`` columns tell a missing cell from one that is not a number;
    without them a null is missing and NaN or infinity is invalid.

    The steps build on each other as columns, and each refers to the one before
    as few times as it can: a filter on the result is pushed down through all
    of them, and its expression stays small enough for one compiled stage.
    """
    t, h, raw = F.col("__t"), F.col("__h"), F.col("__raw")
    rows = df.withColumns(
        {
            "__tg": temperature.isNotNull() if temperature_given is None else temperature_given,
            "__hg": humidity.isNotNull() if humidity_given is None else humidity_given,
            "__t": finite_or_null(temperature),
            "__h": finite_or_null(humidity),
        }
    ).withColumn("__raw", heat_index(t, h)).withColumn("__class", interval_class(raw))
    error = (
        F.when(~F.col("__tg"), "TEMPERATURE_MISSING")
        .when(~F.col("__hg"), "HUMIDITY_MISSING")
        .when(t.isNull(), "TEMPERATURE_INVALID")
        .when(h.isNull(), "HUMIDITY_INVALID")
        .when(F.abs(h - 50.0) > 50.0, "HUMIDITY_OUT_OF_RANGE")
        .when(F.col("__class").isNull(), F.when(F.abs(raw) < float("inf"), "THI_CATEGORY_UNSUPPORTED").otherwise("THI_CALCULATION_FAILED"))
    )
    rows = rows.withColumn("heat_error", error)
    found = F.col("heat_error")
    status = looked_up(found, {e: s for e, (s, _) in HEAT_ERRORS.items()})
    shown = F.when(F.coalesce(found, F.lit("THI_CATEGORY_UNSUPPORTED")) == "THI_CATEGORY_UNSUPPORTED", raw)
    return rows.withColumns(
        {
            "heat_status": F.coalesce(status, F.lit("ELIGIBLE")),
            "heat_index": shown,
            "heat_display": F.round(shown, 2),
            "heat_class": F.when(found.isNull(), F.col("__class")),
        }
    ).drop("__tg", "__hg", "__t", "__h", "__raw", "__class")


# What each gate answers: status, scope, reason and warning.
GATES = (
    ("OUT_OF_SCOPE_POPULATION", "OUT_OF_SCOPE", "POPULATION_OUT_OF_SCOPE", "POPULATION_SCOPE"),
    ("MISSING_REQUIRED_INPUT", "UNRESOLVED", "GENETIC_GROUP_MISSING", "BREED_NOT_USED"),
    ("MISSING_REQUIRED_INPUT", "UNRESOLVED", "ENVIRONMENT_MISSING", None),
    ("INVALID_ENVIRONMENT_INPUT", "UNRESOLVED", "ENVIRONMENT_INVALID", None),
    ("UNKNOWN_THI_CATEGORY", "UNRESOLVED", "THI_CATEGORY_UNKNOWN", None),
    ("UNKNOWN_GENETIC_GROUP", "OUT_OF_SCOPE", "GENETIC_GROUP_UNKNOWN", "BREED_NOT_USED"),
    ("ELIGIBLE", "LIMITED_SUPPORT", None, "LOCAL_LIMITED"),
    ("ELIGIBLE", "IN_SCOPE", None, None),
)


def with_eligibility(df: DataFrame, stage: Column, group: Column) -> DataFrame:
    """Adds eligibility, scope, fallback_reason and eligibility_warnings.

    The first failing gate decides, so the gate's number is found once and the
    answers are read from it. Needs the columns of ``with_heat``.
    """
    first = F.when(~F.coalesce(status_text(stage).isin(*LACTATING_STAGES), F.lit(False)), 1).when(
        F.coalesce(stripped(group), F.lit("")) == "", 2
    )
    environment = looked_up(F.col("heat_error"), {e: g for e, (_, g) in HEAT_ERRORS.items()}).cast("int")
    last = F.when(~group.isin(*GENETIC_GROUPS), 6).when(group == "Local", 7).otherwise(8)
    gate = F.coalesce(first, environment, last)

    def answer(place: int) -> Column:
        return F.element_at(F.array(*[F.lit(g[place]).cast("string") for g in GATES]), F.col("__gate"))

    return df.withColumn("__gate", gate).withColumns(
        {
            "eligibility": answer(0),
            "scope": answer(1),
            "fallback_reason": answer(2),
            "eligibility_warnings": F.array_compact(F.array(answer(3))),
        }
    ).drop("__gate")


def base_ration(weight: Column, milk: Column) -> Column:
    """The first estimate of daily feed in kilograms."""
    return weight * 0.025 + milk * 0.30


def with_feed_plan(
    df: DataFrame, predicted: Column, weight: Column, milk: Column, health: Column, stage: Column,
    digits: int | None = 2,
) -> DataFrame:
    """Adds the ration plan of every row; helper columns are dropped again.

    Kilograms are rounded to ``digits`` places; None leaves them as computed.

    Fixed values: 400 kg default weight, 2.5 % fallback, 1.5–4 % bounds, the
    yield bands 5 / 15 / 25 L, a 10 % concentrate shift, 350 kg mineral limit.
    """
    clean = {"__w": finite_or_null(weight), "__m": finite_or_null(milk), "__p": finite_or_null(predicted)}
    rows = df.withColumns(clean).withColumns(
        {
            "__wbad": F.coalesce(F.col("__w") <= 0, F.lit(True)),
            "__mbad": F.coalesce(F.col("__m") < 0, F.lit(True)),
            "__pbad": F.coalesce(F.col("__p") <= 0, F.lit(True)),
            "__h": F.coalesce(F.nullif(status_text(health), F.lit("")), F.lit("unknown")),
        }
    )
    rows = rows.withColumns(
        {
            "__w": F.when(F.col("__wbad"), F.lit(400.0)).otherwise(F.col("__w")),
            "__m": F.when(F.col("__mbad"), F.lit(0.0)).otherwise(F.col("__m")),
        }
    )
    w, m = F.col("__w"), F.col("__m")
    rows = rows.withColumn("__p", F.when(F.col("__pbad"), w * 0.025).otherwise(F.col("__p")))
    rows = rows.withColumns(
        {
            "__lo": w * 0.015,
            "__hi": w * 0.04,
            "__share": F.when(m < 5, 0.25).when(m <= 15, 0.35).when(m <= 25, 0.40).otherwise(0.45),
            "__band": F.when(m < 5, "below 5 L/day").when(m <= 15, "between 5 and 15 L/day")
            .when(m <= 25, "between 15 and 25 L/day").otherwise("above 25 L/day"),
            "__review": F.col("__h").isin(*REVIEW_STATUSES),
        }
    )
    p, low, high = F.col("__p"), F.col("__lo"), F.col("__hi")
    total = F.greatest(F.least(p, high), low)
    rows = rows.withColumns({"__total": total, "__below": p < low, "__above": p > high})
    moved = F.when(F.col("__review"), F.col("__total") * F.col("__share") * 0.10).otherwise(0.0)
    rough_share = F.lit(1.0) - F.col("__share")
    unknown = F.col("__h") == "unknown"
    weak = (
        F.col("__wbad") | F.col("__mbad") | F.col("__pbad") | unknown | F.col("__below") | F.col("__above") | F.col("__review")
    )
    stage_text = F.nullif(stripped(stage), F.lit(""))
    warnings = present(
        [
            F.when(F.col("__wbad"), "WEIGHT_DEFAULTED"),
            F.when(F.col("__mbad"), "MILK_TREATED_AS_ZERO"),
            F.when(F.col("__pbad"), "PREDICTION_REPLACED_BY_WEIGHT_RULE"),
            F.when(F.col("__below"), "RAISED_TO_MINIMUM").when(F.col("__above"), "REDUCED_TO_MAXIMUM"),
            F.when(F.col("__review"), "HEALTH_REVIEW_SHIFT").when(unknown, "HEALTH_UNKNOWN"),
        ]
    )
    explanation = present(
        [
            F.format_string("estimated feed %.2f kg/day", p),
            F.format_string("range %.2f-%.2f kg/day for %.2f kg", low, high, w),
            F.format_string("milk %.2f L/day (%s)", m, F.col("__band")),
            F.concat(F.lit("health status "), F.col("__h")),
            F.when(F.col("__review"), "concentrate reduced by 10%"),
            F.when(stage_text.isNotNull(), F.concat(F.lit("stage "), stage_text)).otherwise("no stage given"),
        ]
    )
    def shown(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    plan = {
        "total_feed_kg": shown(F.col("__total")),
        "roughage_kg": shown(F.col("__total") * rough_share + moved),
        "concentrate_kg": shown(F.col("__total") * F.col("__share") - moved),
        "mineral_mix_kg": F.when(w < 350.0, 0.05).otherwise(0.10),
        "feedings_per_day": F.when(m > 25, 3).otherwise(2),
        "confidence_level": F.when(weak, "Low").otherwise("Moderate"),
        "plan_warnings": warnings,
        "explanation": explanation,
    }
    helpers = [c for c in rows.columns if c.startswith("__")]
    return rows.withColumns(plan).drop(*helpers)


def stock_level(quantity: Column, threshold: Column) -> Column:
    """The stock word; a quantity or threshold that is no number counts as 0."""
    q = F.coalesce(finite_or_null(quantity), F.lit(0.0))
    t = F.coalesce(finite_or_null(threshold), F.lit(0.0))
    return F.when(q <= 0, "Out of Stock").when(q <= t, "Low").when(q <= t * 2, "Medium").otherwise("High")


def adjusted_stock(quantity: Column, operation: Column, amount: Column, unit: Column) -> Column:
    """struct(quantity, error) after a 10 % step or a restock."""
    unit_text = F.coalesce(F.nullif(stripped(unit), F.lit("")), F.lit("kg"))
    q, a = finite_or_null(quantity), finite_or_null(amount)
    step = F.when(operation == "decrease", F.lit(1 - STOCK_STEP)).otherwise(F.lit(1 + STOCK_STEP))
    stepped = round_quantity(F.greatest(F.lit(0.0), q * step), unit_text, WHOLE_UNITS)
    restocked = round_quantity(q + a, unit_text, WHOLE_UNITS)
    new = F.when(operation == "restock", restocked).otherwise(stepped)
    error = (
        F.when(~operation.isin("decrease", "increase", "restock"), "UNKNOWN_OPERATION")
        .when(q.isNull() | (q < 0), "STOCK_INVALID")
        .when((operation == "restock") & (a.isNull() | (a <= 0)), "AMOUNT_INVALID")
        .when(new > MAX_STOCK, "ABOVE_MAXIMUM")
    )
    return F.struct(F.when(error.isNull(), new).alias("quantity"), error.alias("error"))


def guarded_prediction(value: Column, minimum: float, maximum: float) -> Column:
    """struct(value, error); a prediction is refused, never clipped."""
    usable = finite_or_null(value)
    error = (
        F.when(usable.isNull(), "NOT_FINITE").when(usable < 0, "NEGATIVE").when(~usable.between(minimum, maximum), "OUT_OF_RANGE")
    )
    return F.struct(F.when(error.isNull(), usable).alias("value"), error.alias("error"))


def scoring_status(task_values: Sequence[Column]) -> Column:
    """All, some or none of the tasks gave a value."""
    got = sum((v.isNotNull().cast("int") for v in task_values), F.lit(0))
    return F.when(got == len(task_values), "ELIGIBLE").when(got > 0, "PARTIAL").otherwise("FALLBACK_REQUIRED")


# Reasons in the order in which the first one decides the message.
MESSAGE_BY_REASON: tuple[tuple[tuple[str, ...], str], ...] = (
    (("FEATURE_DISABLED",), "DISABLED"),
    (("GENETIC_GROUP_MISSING", "GENETIC_GROUP_UNKNOWN"), "NEEDS_GENETIC_GROUP"),
    (("ENVIRONMENT_MISSING", "ENVIRONMENT_INVALID", "THI_CATEGORY_UNKNOWN"), "NEEDS_ENVIRONMENT"),
    (("POPULATION_OUT_OF_SCOPE",), "OUT_OF_SCOPE"),
    (("ARTIFACT_UNAVAILABLE", "ARTIFACT_HASH_MISMATCH", "ARTIFACT_METADATA_INVALID",
      "ARTIFACT_INCOMPATIBLE", "MODEL_ERROR"), "MODEL_UNAVAILABLE"),
)


def status_message(status: Column, reasons: Column) -> Column:
    """The message code for a status and an array of reasons."""
    chain = F.when(status == "ELIGIBLE", "AVAILABLE").when(status == "PARTIAL", "PARTLY_AVAILABLE")
    for codes, message in MESSAGE_BY_REASON:
        chain = chain.when(F.arrays_overlap(reasons, F.array(*[F.lit(c) for c in codes])), message)
    return chain.otherwise("UNAVAILABLE")


# The order in which warnings are listed; others follow by arrival.
WARNING_PRIORITY = (
    "ARTIFACT_HASH_MISMATCH", "ARTIFACT_UNAVAILABLE", "MODEL_ERROR", "PREDICTION_OUT_OF_SCOPE",
    "BD_LOCAL_LIMITED", "BD_DMI_DRY_MATTER", "BD_RESEARCH_SCOPE", "BD_CANDIDATE_ONLY",
    "BD_EXTERNAL_VALIDATION_MISSING", "ADVISORY_ONLY",
)

# Warnings that come with any prediction.
PREDICTION_WARNINGS = (
    "BD_RESEARCH_SCOPE", "BD_TWO_FEATURE_MODEL", "BD_CANDIDATE_ONLY", "BD_RULE_OWNERSHIP",
    "BD_NO_RATION_LABELS", "BD_EXTERNAL_VALIDATION_MISSING", "ADVISORY_ONLY",
)


def catalogue_warnings(intake: Column, milk: Column, scopes: Column, given: Column | None = None) -> Column:
    """J16 with H12: given warnings first, then the catalogue; unique, by priority."""
    any_value = intake.isNotNull() | milk.isNotNull()
    none = F.array().cast("array<string>")
    always = F.when(any_value, F.array(*[F.lit(c) for c in PREDICTION_WARNINGS])).otherwise(none)
    extra = present(
        [
            F.when(intake.isNotNull(), "BD_DMI_DRY_MATTER"),
            F.when(milk.isNotNull(), "BD_MILK_DAILY"),
            F.when(F.array_contains(scopes, "LIMITED_SUPPORT"), "BD_LOCAL_LIMITED"),
        ]
    )
    return ordered_codes(F.concat(F.coalesce(given, none) if given is not None else none, always, extra), WARNING_PRIORITY)


def ordered_codes(codes: Column, priority: Sequence[str]) -> Column:
    """H12 on one row: the first of each code, by priority list, then by arrival."""
    unique = F.array_distinct(codes)
    ranked = F.transform(
        unique,
        lambda c, i: F.struct(
            F.coalesce(
                F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), c), F.lit(0)), F.lit(len(priority) + 1)
            ).alias("rank"),
            i.alias("seq"),
            c.alias("code"),
        ),
    )
    return F.transform(F.array_sort(ranked), lambda r: r["code"])


# Inputs of the yield model, and what stands in for optional ones.
YIELD_INPUTS: Mapping[str, str] = {
    "breed": "Breed", "ageMonths": "Age_Months", "weightKg": "Weight_kg",
    "lactationStage": "Lactation_Stage", "daysInMilk": "Days_in_Milk",
    "ambientTemperatureC": "Ambient_Temperature_C", "humidityPercent": "Humidity_percent",
    "previousWeekAvgYield": "Previous_Week_Avg_Yield", "bodyConditionScore": "Body_Condition_Score",
}
YIELD_REQUIRED = ("ageMonths", "breed", "lactationStage", "weightKg")
YIELD_DEFAULTS: Mapping[str, float] = {
    "ambientTemperatureC": 28.0, "humidityPercent": 70.0, "previousWeekAvgYield": 0.0,
    "bodyConditionScore": 3.0, "daysInMilk": 0.0,
}
YIELD_TEXT = ("breed", "lactationStage")


def model_inputs(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Default-filled, typed model inputs and one ``input_error`` per row."""
    required: list[Column] = []
    invalid: list[Column] = []
    out: dict[str, Column] = {}
    for name, feature in YIELD_INPUTS.items():
        source = quoted(name) if name in df.columns else F.lit(None).cast("string")
        blank = source.isNull() | (stripped(source.cast("string")) == "")
        if name in YIELD_TEXT:
            out[feature] = F.when(~blank, stripped(source.cast("string")))
        else:
            number = finite_number(df, name) if name in df.columns else F.lit(None).cast("double")
            default = YIELD_DEFAULTS.get(name)
            out[feature] = number if default is None else F.when(blank, F.lit(default)).otherwise(number)
            invalid.append(F.when(~blank & number.isNull(), F.lit(name)))
        if name in YIELD_REQUIRED:
            required.append(F.when(blank, F.lit(name)))
    missing, bad = F.array_sort(present(required)), present(invalid)
    error = F.when(F.size(missing) > 0, F.concat(F.lit("MISSING: "), F.array_join(missing, ", "))).when(
        F.size(bad) > 0, F.concat(F.lit("NOT_NUMERIC: "), F.element_at(bad, 1))
    )
    return df.select(*keys, *[c.alias(n) for n, c in out.items()], error.alias("input_error"))

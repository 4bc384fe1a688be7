"""Validation of request, record and prediction tables, one result per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdspark.functions.dates import age_months, parsed_date
from herdspark.functions.values import (
    finite_or_null,
    missing_blank,
    parse_number,
    present,
    quoted,
    round_quantity,
    stripped,
)
from herdspark.operators.rules import GENETIC_GROUPS, MAX_STOCK, WHOLE_UNITS

# The request contract.
REQUEST_FIELDS = (
    "breed", "genetic_group", "age_months", "weight_kg", "lactation_stage", "days_in_milk",
    "previous_week_avg_yield_l", "body_condition_score", "ambient_temperature_c",
    "humidity_percent", "health_status",
)
REQUEST_REQUIRED = ("breed", "age_months", "weight_kg", "lactation_stage")
REQUEST_TEXTS = ("breed", "lactation_stage", "genetic_group", "health_status")
REQUEST_OPTIONAL_NUMBERS = (
    "previous_week_avg_yield_l", "body_condition_score", "ambient_temperature_c", "humidity_percent",
)
MAX_TEXT = 256
PREDICTION_FIELDS = (
    "total_feed_kg", "dry_matter_intake_kg", "concentrate_kg", "roughage_kg",
    "crude_protein_requirement", "energy_requirement",
)


def _message(name: str, type_: Column, text: Column, number: Column) -> Column:
    """What is wrong with one contract field of a VARIANT type; null when nothing is, or when it is not given."""
    whole = type_ == "BIGINT"
    finite = ~type_.isin("STRING", "BOOLEAN") & number.isNotNull()
    if name in REQUEST_TEXTS:
        wrong = (
            F.when(type_ != "STRING", "Must be a string.")
            .when(stripped(text) == "", "Must not be empty.")
            .when(F.length(text) > MAX_TEXT, "Text value is too long.")
        )
    elif name == "age_months":
        wrong = F.when(~whole, "Must be an integer.").when(number <= 0, "Must be greater than zero.")
    elif name == "weight_kg":
        wrong = F.when(~finite, "Must be a finite number.").when(number <= 0, "Must be greater than zero.")
    elif name == "days_in_milk":
        wrong = F.when(~whole, "Must be an integer or null.").when(number < 0, "Must be zero or greater.")
    else:
        wrong = F.when(~finite, "Must be a finite number or null.")
        if name == "previous_week_avg_yield_l":
            wrong = wrong.when(number < 0, "Must be zero or greater.")
        if name == "body_condition_score":
            wrong = wrong.when((number < 1) | (number > 5), "Must be from 1 through 5.")
    absent = F.lit("Required field is missing." if name in REQUEST_REQUIRED else None).cast("string")
    return F.when(type_.isNull() | (type_ == "VOID"), absent).otherwise(wrong)


def error_code(errors: Column) -> Column:
    """The one code that sums up a row's errors; null when there are none."""
    messages = F.map_values(errors)
    missing = F.exists(messages, lambda m: m.contains("Required field"))
    typed = F.exists(messages, lambda m: m.rlike("string|integer|finite|Unexpected"))
    return F.when(F.size(messages) == 0, F.lit(None).cast("string")).when(missing, "MISSING_REQUIRED_FIELD").when(
        typed, "INVALID_FIELD_TYPE"
    ).otherwise("INVALID_FIELD_RANGE")


def validate_requests(df: DataFrame, json_column: str, keys: Sequence[str]) -> DataFrame:
    """E15 over a table of JSON request texts: errors, code and valid flag per row.

    The contract's fields are read as VARIANT columns that keep their JSON types,
    and each has its own flat test; the list of names serves unexpected and
    repeated ones. A text that is no object, or names a field twice, is invalid JSON.
    """
    fields = ", ".join(f"`{f}` variant" for f in REQUEST_FIELDS)
    body = quoted(json_column)
    rows = df.select(
        *keys,
        F.from_json(body, f"{fields}, `__bad` string", {"columnNameOfCorruptRecord": "__bad"}).alias("__r"),
        F.json_object_keys(body).alias("__names"),
    )
    given = {f: F.col(f"__r.`{f}`") for f in REQUEST_FIELDS}
    rows = rows.select(
        *keys, "__names",
        (F.col("__names").isNull() | F.col("__r.__bad").isNotNull() | (F.size(F.array_distinct("__names")) != F.size("__names"))).alias("__broken"),
        *[F.schema_of_variant(v).alias(f"__type_{f}") for f, v in given.items()],
        *[given[f].try_cast("string").alias(f"__text_{f}") for f in REQUEST_TEXTS],
        *[finite_or_null(given[f].try_cast("double")).alias(f"__number_{f}") for f in REQUEST_FIELDS if f not in REQUEST_TEXTS],
    )
    # Types, texts and numbers are columns of their own, so each test is a few comparisons.
    messages = [
        _message(f, F.col(f"__type_{f}"), F.col(f"__text_{f}") if f in REQUEST_TEXTS else F.lit(None), F.col(f"__number_{f}") if f not in REQUEST_TEXTS else F.lit(None)).alias(f"__message_{f}")
        for f in REQUEST_FIELDS
    ]
    rows = rows.select(*keys, "__broken", "__names", *messages)
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    found = F.array_compact(
        F.array(*[F.when(F.col(f"__message_{f}").isNotNull(), entry(F.lit(f), F.col(f"__message_{f}"))) for f in REQUEST_FIELDS])
    )
    strange = F.array_except("__names", F.array(*[F.lit(f) for f in REQUEST_FIELDS]))
    more = F.transform(strange, lambda n: entry(n, F.lit("Unexpected field.")))
    errors = F.map_from_entries(F.when(F.size(strange) > 0, F.concat(found, more)).otherwise(found))
    rows = rows.select(*keys, "__broken", F.when(~F.col("__broken"), errors).alias("errors"))
    return rows.select(
        *keys,
        "errors",
        F.when(F.col("__broken"), F.lit("INVALID_JSON")).otherwise(error_code(F.col("errors"))).alias("error_code"),
        (~F.col("__broken") & (F.size("errors") == 0)).alias("valid"),
    )


def missing_fields(df: DataFrame, fields: Sequence[str] = PREDICTION_FIELDS) -> Column:
    """Names of required outputs that are absent or null."""
    return present(
        [F.when(quoted(f).isNull(), F.lit(f)) if f in df.columns else F.lit(f) for f in fields]
    )


def prediction_set_check(df: DataFrame, prediction: str, expected_rows: int) -> DataFrame:
    """Row count and finiteness of a prediction table in one aggregation."""
    bad = finite_or_null(F.col(prediction).cast("double")).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("non_finite")
    ).withColumn("valid", (F.col("rows") == expected_rows) & (F.col("non_finite") == 0))


def manifest_integrity(
    manifest: DataFrame, key: str, split: str, group: str | None = None, fold: str | None = None,
    folds: int = 5, training: str = "train",
) -> DataFrame:
    """Duplicates, nulls, group overlap and fold coverage as (check, passed, observed) rows."""
    per_key = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(split).isNull().cast("int")).alias("nulls"))
    keys_part = per_key.agg(
        F.count_if(F.col("n") > 1).alias("DUPLICATE_KEYS"),
        F.count_if(F.col(key).isNull()).alias("NULL_KEYS"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("UNASSIGNED_ROWS"),
    )
    parts = [_unpivoted(keys_part)]
    if group is not None:
        crossing = manifest.groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b")).agg(
            F.count_if(F.col("a") != F.col("b")).alias("GROUPS_IN_SEVERAL_SPLITS")
        )
        parts.append(_unpivoted(crossing))
    if fold is not None:
        is_training = F.col(split) == training
        coverage = manifest.agg(
            F.count_if(is_training & F.col(fold).isNull()).alias("TRAINING_ROWS_WITHOUT_FOLD"),
            F.count_if(~is_training & F.col(fold).isNotNull()).alias("OTHER_ROWS_WITH_FOLD"),
            F.count_if(F.col(fold).isNotNull() & ~F.col(fold).between(1, folds)).alias("FOLD_OUT_OF_RANGE"),
            (F.lit(folds) - F.countDistinct(F.when(is_training, F.col(fold)))).alias("EMPTY_FOLDS"),
        )
        parts.append(_unpivoted(coverage))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("check", (F.col("observed") == 0).alias("passed"), "observed")


def _unpivoted(one: DataFrame) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("observed")) for c in one.columns])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def manifest_counts(manifest: DataFrame, split: str) -> DataFrame:
    """Rows per split, to be set beside the expected counts."""
    return manifest.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))


def manifest_coverage(manifest: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys of one side the other does not have, as (side, key) rows."""
    left = table.select(key).join(manifest.select(key), key, "left_anti").select(F.lit("table_only").alias("side"), key)
    right = manifest.select(key).join(table.select(key), key, "left_anti").select(F.lit("manifest_only").alias("side"), key)
    return left.unionByName(right)


def restock_quantity(raw: Column, unit: Column) -> Column:
    """struct(value, error) of a quantity typed in by hand."""
    text = F.coalesce(stripped(raw.cast("string")), F.lit(""))
    number = text.try_cast("double")
    whole = F.lower(F.coalesce(stripped(unit), F.lit(""))).isin(*WHOLE_UNITS)
    decimals = F.length(F.regexp_extract(text, r"\.(\d*)$", 1))
    error = (
        F.when(text == "", "QUANTITY_MISSING")
        .when(~text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$") | finite_or_null(number).isNull(), "NOT_NUMERIC")
        .when(number <= 0, "NOT_POSITIVE")
        .when(number > MAX_STOCK, "ABOVE_MAXIMUM")
        .when(whole & ((decimals > 0) | (F.floor(number) != number)), "WHOLE_NUMBER_NEEDED")
        .when(~whole & (decimals > 2), "TOO_MANY_DECIMALS")
    )
    value = F.when(error.isNull(), round_quantity(number, unit, WHOLE_UNITS))
    return F.struct(value.alias("value"), error.alias("error"))


def _blank(value: Column) -> Column:
    return F.coalesce(stripped(value.cast("string")), F.lit("")) == ""


def livestock_edits(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds edit_age, edit_weight and edit_error; a birth date overrides the entered age.

    Reads animal_id, animal_name, species, breed, birth_date, age and weight.
    """
    entered = F.when(_blank(F.col("age")), F.lit("0")).otherwise(F.col("age").cast("string"))
    rows = df.withColumns(
        {
            "__entered": parse_number(entered),
            "__born": parsed_date(F.col("birth_date")),
            "__kilos": finite_or_null(parse_number(F.col("weight").cast("string"))),
        }
    )
    months = F.when(_blank(F.col("birth_date")), F.col("__entered")).otherwise(
        age_months(F.col("__born"), as_of).cast("double")
    )
    rows = rows.withColumn("__months", finite_or_null(months))
    required = [_blank(F.col(c)) for c in ("animal_id", "animal_name", "species", "breed")]
    error = (
        F.when(required[0] | required[1] | required[2] | required[3], "REQUIRED_TEXT_MISSING")
        .when(F.col("__months").isNull() | (F.col("__months") < 0), "AGE_INVALID")
        .when(F.col("__kilos").isNull() | (F.col("__kilos") <= 0), "WEIGHT_INVALID")
    )
    ok = F.col("edit_error").isNull()
    return (
        rows.withColumn("edit_error", error)
        .withColumns({"edit_age": F.when(ok, F.col("__months")), "edit_weight": F.when(ok, F.col("__kilos"))})
        .drop("__entered", "__born", "__kilos", "__months")
    )


ADMISSION_NUMBERS = (
    "ambient_temperature_c", "humidity_percent", "days_in_milk", "previous_week_avg_yield_l", "body_condition_score",
)


def scoring_admission(df: DataFrame) -> DataFrame:
    """Admitted flag, field and message code; optional values only if valid."""
    rows = df.withColumns(
        {f"__{n}": F.coalesce(stripped(quoted(n).cast("string")), F.lit("")) for n in (*ADMISSION_NUMBERS, "genetic_group")}
    )
    rows = rows.withColumns({f"__n_{n}": finite_or_null(parse_number(F.col(f"__{n}"))) for n in ADMISSION_NUMBERS})
    temperature, humidity, days, yielded, score = (F.col(f"__n_{n}") for n in ADMISSION_NUMBERS)
    known = F.coalesce(quoted("genetic_group").isin(*GENETIC_GROUPS), F.lit(False))
    undecided = F.col("__genetic_group").isin("", "Unknown")
    problem = (
        F.when(~known & ~undecided, "GROUP_NOT_VERIFIED")
        .when(F.col("__ambient_temperature_c") == "", "TEMPERATURE_REQUIRED")
        .when(temperature.isNull(), "TEMPERATURE_NOT_NUMERIC")
        .when(F.col("__humidity_percent") == "", "HUMIDITY_REQUIRED")
        .when(humidity.isNull() | ~humidity.between(0, 100), "HUMIDITY_OUT_OF_RANGE")
    )
    rows = rows.withColumn("__problem", problem)
    found = F.col("__problem")
    admitted = found.isNull()
    field = (
        F.when(found == "GROUP_NOT_VERIFIED", "genetic_group")
        .when(found.startswith("TEMPERATURE"), "ambient_temperature_c")
        .when(found.startswith("HUMIDITY"), "humidity_percent")
    )
    out = rows.withColumns(
        {
            "admitted": admitted,
            "problem_field": field,
            "message": F.coalesce(found, F.when(undecided, "GROUP_NEEDED_FOR_ESTIMATE")),
            "genetic_group_sent": F.when(admitted & known, quoted("genetic_group")),
            "ambient_temperature_sent": F.when(admitted, temperature),
            "humidity_sent": F.when(admitted, humidity),
            "days_in_milk_sent": F.when(admitted & (F.floor(days) == days) & (days >= 0), days.cast("bigint")),
            "previous_yield_sent": F.when(admitted & (yielded >= 0), yielded),
            "condition_score_sent": F.when(admitted & score.between(1, 5), score),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def profile_gap(texts: Sequence[Column], numbers: Sequence[Column]) -> Column:
    """A needed text is blank or a needed number is not a number."""
    gap = F.lit(False)
    for column in texts:
        gap = gap | missing_blank(column)
    for column in numbers:
        # An empty entry counts as zero, as a number typed nowhere would.
        entry = F.coalesce(stripped(column.cast("string")), F.lit("x"))
        gap = gap | F.coalesce(finite_or_null(parse_number(F.when(entry == "", "0").otherwise(entry))).isNull(), F.lit(True))
    return gap

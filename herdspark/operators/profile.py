"""Column profiles, value counts, class distributions and type inference.

Everything starts from one count table (column, value, n): cells are unpivoted,
counted with partial aggregation, and each report reads that small table.
``exact=False`` forms use bounded-size sketches in one pass without a shuffle
of the values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdspark.functions.dates import parsed_time
from herdspark.functions.text import compare_key, looked_up
from herdspark.functions.values import (
    NUMBER_PATTERN,
    decimal_places,
    is_number,
    is_text,
    missing_blank,
    missing_null,
    missing_text,
    number_of,
    present,
    quoted,
)
from herdspark.operators.summary import long_values, numeric_summary
from herdspark.session import cut_lineage

# Names taken for identifiers whatever the column holds.
IDENTIFIER_NAMES = ("cattleid", "animalid", "farmid", "recordid", "observationid")

MISSING_TESTS = {"null": None, "text": missing_text, "blank": missing_blank}


def _plain_name(name: str) -> str:
    return "".join(ch for ch in name.strip().lower() if ch.isascii() and ch.isalnum())


def missing_cell(df: DataFrame, name: str, definition: str = "null") -> Column:
    """The chosen missing test of a column: ``null``, ``text`` (C1) or ``blank``."""
    test = MISSING_TESTS[definition]
    return missing_null(df, name) if test is None else test(quoted(name))


def cell_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    ordinal: str | None = None,
    missing: str = "null",
) -> DataFrame:
    """(column, value, n[, first_row]) with missing cells under a null value."""
    columns = list(columns or [c for c in df.columns if c != ordinal])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.when(~missing_cell(df, c, missing), quoted(c).cast("string")).alias("value"),
            )
            for c in columns
        ]
    )
    keep = [F.col(ordinal).alias("__row")] if ordinal else []
    rows = df.select(F.explode(cells).alias("__c"), *keep).select("__c.column", "__c.value", *(["__row"] if ordinal else []))
    aggregates = [F.count(F.lit(1)).alias("n")]
    if ordinal:
        aggregates.append(F.min("__row").alias("first_row"))
    return rows.groupBy("column", "value").agg(*aggregates)


#: Types whose values are counted as they are; all others are counted as texts.
COUNTED_TYPES = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "double": "double"}


def column_facts(df: DataFrame) -> DataFrame:
    """(column, total_rows, unique, top, missing, repeated) of every column: as ``cell_counts`` gives them, but no
    number is made a text, and the counts are read once."""
    kinds: dict[str, list[int]] = {}
    for i, (_, dtype) in enumerate(df.dtypes):
        kinds.setdefault(COUNTED_TYPES.get(dtype, "string"), []).append(i)
    facts = None
    for kind, places in kinds.items():
        cells = []
        for i in places:
            own = quoted(df.columns[i])
            # Grouping takes -0.0 for 0.0; their texts differ.
            below = F.coalesce(F.when(own == 0, own.cast("string").startswith("-")), F.lit(False)) if kind == "double" else F.lit(False)
            value = F.when(~missing_null(df, df.columns[i]), own.cast(kind))
            cells.append(F.struct(F.lit(i).alias("place"), value.alias("value"), below.alias("below")))
        counts = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.place", "c.value", "c.below").agg(F.count(F.lit(1)).alias("n"))
        known = F.col("value").isNotNull()
        part = counts.groupBy("place").agg(
            F.sum("n").alias("total_rows"), F.count("value").alias("unique"), F.max("n").alias("top"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
            F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("repeated"),
        )
        facts = part if facts is None else facts.unionByName(part)
    names = F.array(*[F.lit(c) for c in df.columns])
    return cut_lineage(facts.select(names[F.col("place")].alias("column"), "total_rows", "unique", "top", "missing", "repeated"))


def top_values(counts: DataFrame, limit: int, keys: Sequence[str] = ("column",)) -> DataFrame:
    """The most frequent values per key; ties by first row, else by value."""
    tie = "first_row" if "first_row" in counts.columns else "value"
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(tie))
    ranked = counts.filter(F.when(F.col("value").isNotNull(), F.col("n")) > 0)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def first_values(counts: DataFrame, limit: int = 5) -> DataFrame:
    """The first distinct values per column, as one bounded array."""
    tie = "first_row" if "first_row" in counts.columns else "value"
    order = Window.partitionBy("column").orderBy(tie)
    head = (
        counts.filter(F.when(F.col("value").isNotNull(), F.col("n")) > 0)
        .withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= limit)
    )
    pairs = F.array_sort(F.collect_list(F.struct("__rank", "value")))
    return head.groupBy("column").agg(F.transform(pairs, lambda p: p["value"]).alias("sample_values"))


def _schema_type(df: DataFrame, name: str) -> str | None:
    """The inferred type that follows from the name or the schema alone."""
    kind = df.schema[name].dataType
    if _plain_name(name) in IDENTIFIER_NAMES:
        return "identifier"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType,)):
        return "continuous_numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return None


def _maybe_date(name: str) -> bool:
    plain = _plain_name(name)
    return "date" in plain or "timestamp" in plain


def _inferred(df: DataFrame, columns: Sequence[str], rows: Column, distinct: Column, parse_rate: Column) -> Column:
    """name, schema, date share of at least 95 %, then cardinality."""
    by_schema = {c: t for c in columns if (t := _schema_type(df, c))}
    dated = [c for c in columns if _maybe_date(c)]
    few = distinct <= F.least(F.lit(100), F.greatest(F.lit(20), F.floor(rows * F.lit(0.01))))
    chain = F.when(F.col("column").isin(*dated) & (parse_rate >= 0.95), "datetime") if dated else None
    rest = F.when(few, F.lit("categorical")).otherwise(F.lit("string"))
    rest = rest if chain is None else chain.otherwise(rest)
    return F.coalesce(looked_up(F.col("column"), by_schema), rest)


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    ordinal: str | None = None,
    exact: bool = True,
) -> DataFrame:
    """F1 with F3: type, missing, distinct, samples and range, one row per column."""
    columns = list(columns or [c for c in df.columns if c != ordinal])
    dtypes = dict(df.dtypes)
    numeric = [c for c in columns if is_number(df, c)]
    if not exact:
        return _sketched_profile(df, columns, numeric, dtypes)
    counts = cell_counts(df, columns, ordinal)
    value, n = F.col("value"), F.col("n")
    as_number = F.when(F.col("column").isin(*numeric), value.try_cast("double")) if numeric else F.lit(None).cast("double")
    parsed = F.sum(F.when(parsed_time(value).isNotNull(), n))
    base = counts.groupBy("column").agg(
        F.sum("n").alias("__rows"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_non_null"),
        F.min(as_number).alias("minimum"),
        F.max(as_number).alias("maximum"),
        F.try_divide(parsed, F.sum(F.when(value.isNotNull(), n))).alias("__parse_rate"),
    )
    full = base.join(first_values(counts), "column", "left")
    return _finish_profile(df, full, columns, dtypes)


def _finish_profile(df, full, columns, dtypes):
    return full.select(
        "column",
        looked_up(F.col("column"), {c: dtypes[c] for c in columns}).alias("data_type"),
        _inferred(df, columns, F.col("__rows"), F.col("unique_non_null"), F.col("__parse_rate")).alias("inferred_type"),
        "missing_count",
        F.round(F.col("missing_count") / F.col("__rows") * 100, 6).alias("missing_percentage"),
        "unique_non_null",
        "sample_values",
        "minimum",
        "maximum",
    )


def _sketched_profile(df, columns, numeric, dtypes):
    """One pass, no value shuffle: distinct counts from HyperLogLog sketches."""
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        missing = missing_cell(df, c)
        column = quoted(c)
        as_number = column.cast("double") if c in numeric else F.lit(None).cast("double")
        aggregates += [
            F.count_if(missing).alias(f"m{i}"),
            F.approx_count_distinct(F.when(~missing, column.cast("string"))).alias(f"d{i}"),
            F.min(as_number).alias(f"lo{i}"),
            F.max(as_number).alias(f"hi{i}"),
            (F.avg(F.when(parsed_time(column).isNotNull(), 1.0).otherwise(F.when(~missing, 0.0)))
             if is_text(df, c) and _maybe_date(c) else F.lit(None).cast("double")).alias(f"p{i}"),
            F.min(F.when(~missing, column.cast("string"))).alias(f"s{i}"),
        ]
    one = df.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m{i}").alias("missing_count"),
                F.col(f"d{i}").alias("unique_non_null"),
                F.col(f"lo{i}").alias("minimum"),
                F.col(f"hi{i}").alias("maximum"),
                F.col(f"p{i}").alias("__parse_rate"),
                F.array(F.col(f"s{i}")).alias("sample_values"),
            )
            for i, c in enumerate(columns)
        ]
    )
    long = one.select("__rows", F.explode(rows).alias("r")).select("__rows", "r.*")
    return _finish_profile(df, long, columns, dtypes)


def value_type(text: Column) -> Column:
    """The kind of one non-missing cell written as text."""
    return (
        F.when(F.lower(text).isin("true", "false"), F.lit("boolean"))
        .when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.lit("integer"))
        .when(text.rlike(NUMBER_PATTERN), F.lit("number"))
        .otherwise(F.lit("string"))
    )


def value_type_counts(df: DataFrame, columns: Sequence[str], missing: str = "blank") -> DataFrame:
    """how many cells of each kind every column holds."""
    counts = cell_counts(df, columns, missing=missing)
    return (
        counts.filter(F.when(F.col("value").isNotNull(), F.col("n")) > 0)
        .groupBy("column", value_type(F.col("value")).alias("value_type"))
        .agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("unique_count"))
    )


def value_profile(
    df: DataFrame, columns: Sequence[str], limit: int = 10, ordinal: str | None = None, missing: str = "blank"
) -> DataFrame:
    """the most frequent values of every column with share and rank."""
    counts = cell_counts(df, columns, ordinal, missing)
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
    )
    return (
        top_values(counts, limit)
        .join(totals, "column")
        .select("column", "rank", "value", F.col("n").alias("count"), "row_count", "missing_count", "unique_count")
    )


def mixed_profile(df: DataFrame, columns: Sequence[str], limit: int = 20, missing: str = "text") -> DataFrame:
    """a numeric summary where every cell is a number, else the top values."""
    counts = cell_counts(df, columns, missing=missing)
    value, n = F.col("value"), F.col("n")
    number = F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))
    kinds = counts.groupBy("column").agg(
        (F.coalesce(F.sum(F.when(number.isNull(), n)), F.lit(0)) == 0).alias("all_numeric"),
        F.count(F.lit(1)).alias("unique_count"),
    )
    tagged = counts.join(kinds, "column")
    numeric_rows = (
        tagged.filter("all_numeric")
        .groupBy("column")
        .agg(
            F.sum("n").alias("count"),
            F.min(number).alias("minimum"),
            F.max(number).alias("maximum"),
            F.try_divide(F.sum(number * n), F.sum("n")).alias("mean"),
        )
        .select("column", F.lit("numeric").alias("profile"), F.lit(None).cast("string").alias("value"), "count", "minimum", "maximum", "mean")
    )
    # Cells that are missing are listed as one category of their own.
    text_rows = (
        top_values(
            tagged.filter(~F.col("all_numeric")).withColumn("value", F.coalesce("value", F.lit("MISSING"))),
            limit,
        )
        .select("column", F.lit("categorical").alias("profile"), "value", F.col("n").alias("count"),
                *[F.lit(None).cast("double").alias(c) for c in ("minimum", "maximum", "mean")])
    )
    return numeric_rows.unionByName(text_rows)


def missing_report(df: DataFrame, columns: Sequence[str] | None = None, definition: str = "text") -> DataFrame:
    """missing count and share per column, in one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(missing_cell(df, c, definition)).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(columns)]
    )
    share = F.when(F.col("__rows") > 0, F.round(F.col("missing_count") * 100.0 / F.col("__rows"), 6))
    return counted.select("__rows", F.explode(rows).alias("r")).select(
        "r.column", "r.missing_count", F.coalesce(share, F.lit(0.0)).alias("missing_percentage")
    )


def class_distribution(df: DataFrame, column: str, rare_share: float = 0.01, rare_rows: int = 100) -> DataFrame:
    """rows and share per class, rarity, and the relative max-min spread."""
    counts = df.groupBy(quoted(column).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    present_n = F.when(F.col("class").isNotNull(), F.col("count"))
    totals = counts.agg(
        F.struct(
            F.sum("count").alias("rows"), F.max(present_n).alias("most"),
            F.min(present_n).alias("least"), F.avg(present_n).alias("mean"),
        )
    ).scalar()
    n = F.col("count")
    return counts.withColumn("__t", totals).select(
        "class",
        "count",
        F.round(n / F.col("__t.rows") * 100, 6).alias("percentage"),
        (F.col("class").isNotNull() & ((n < rare_rows) | (n / F.col("__t.rows") < rare_share))).alias("is_rare"),
        F.try_divide(F.col("__t.most") - F.col("__t.least"), F.col("__t.mean")).alias("relative_spread"),
    )


def decimal_place_counts(df: DataFrame, column: str) -> DataFrame:
    """How many values show how many decimals."""
    return (
        df.select(decimal_places(number_of(df, column)).alias("decimals"))
        .filter(F.col("decimals").isNotNull())
        .groupBy("decimals")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def target_audit(df: DataFrame, facts: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """usable records, missing share and summary of target columns.

    ``facts`` names the targets and gives the stated unit, period and status.
    """
    columns = list(facts)
    summary = numeric_summary(long_values(df, columns), "value", ["column"])
    missing = missing_report(df, columns, "text").select(
        "column", F.col("missing_percentage").alias("__missing")
    )
    stated = [
        looked_up(F.col("column"), {c: facts[c].get(k, "UNCLEAR") for c in columns}).alias(k)
        for k in ("unit", "period", "status")
    ]
    return summary.join(missing, "column").select(
        "column", *stated, F.col("count").alias("usable_records"),
        F.col("__missing").alias("missing_percentage"), "minimum", "maximum", "mean", "median",
        "standard_deviation", "zero_count", "negative_count",
    )


def target_risks(df: DataFrame, classes: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """notes on targets that are hard to learn, one row per column."""
    parts: list[DataFrame] = []
    if classes:
        counts = cell_counts(df, classes)
        n = F.when(F.col("value").isNotNull(), F.col("n"))
        stats = counts.groupBy("column").agg(
            F.sum(n).alias("rows"), F.max(n).alias("top"), F.min(n).alias("low"), F.count("value").alias("classes")
        )
        notes = present(
            [
                F.when(F.col("classes") < 2, F.lit("ONE_CLASS")),
                F.when(F.col("top") / F.col("rows") >= 0.80, F.lit("MAJORITY_80_PERCENT")),
                F.when(F.col("low") / F.col("rows") <= 0.05, F.lit("MINORITY_5_PERCENT")),
                F.when(F.col("classes") > 20, F.lit("MORE_THAN_20_CLASSES")),
            ]
        )
        parts.append(stats.select("column", F.lit("classification").alias("task"), notes.alias("notes")))
    if numbers:
        stats = numeric_summary(long_values(df, numbers), "value", ["column"], (0.5,))
        notes = present(
            [
                F.when(F.col("unique_values") < 10, F.lit("FEW_DISTINCT_VALUES")),
                F.when(F.coalesce(F.col("standard_deviation"), F.lit(0.0)) < 1e-9, F.lit("NEAR_ZERO_VARIANCE")),
            ]
        )
        parts.append(stats.select("column", F.lit("regression").alias("task"), notes.alias("notes")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distribution_digest(df: DataFrame, columns: Sequence[str], limit: int = 20) -> DataFrame:
    """numeric columns as one summary row, others as their top values with share."""
    numeric = [c for c in columns if is_number(df, c)]
    others = [c for c in columns if c not in numeric]
    shape = "column string, value string, count bigint, percentage double, mean double, minimum double, maximum double"
    out: list[DataFrame] = []
    if numeric:
        summary = numeric_summary(long_values(df, numeric), "value", ["column"], (0.5,))
        out.append(summary.select("column", F.lit(None).cast("string").alias("value"), "count",
                                  F.lit(None).cast("double").alias("percentage"), "mean", "minimum", "maximum"))
    if others:
        counts = cell_counts(df, others)
        totals = counts.groupBy("column").agg(F.sum("n").alias("__rows"))
        out.append(
            top_values(counts, limit).join(totals, "column").select(
                "column", "value", F.col("n").alias("count"),
                F.round(F.col("n") / F.col("__rows") * 100, 6).alias("percentage"),
                *[F.lit(None).cast("double").alias(c) for c in ("mean", "minimum", "maximum")])
        )
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    assert [f.split()[0] for f in shape.split(", ")] == result.columns
    return result


def class_members(df: DataFrame, column: str, classes: Mapping[str, Sequence[str]], rest: str = "UNCLASSIFIED") -> DataFrame:
    """F16: the distinct values of a column under the class each belongs to."""
    member = {v: name for name, values in classes.items() for v in values}
    values = df.select(quoted(column).cast("string").alias("value")).filter("value is not null")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).select(
        F.coalesce(looked_up(F.col("value"), member), F.lit(rest)).alias("class"), "value", "rows"
    )


def spelling_groups(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """values that differ only by case, blanks or punctuation, as rows.

    ``counts`` may be the cell counts of more columns. The filter reads ``n``, so
    it stays above the counts and their shuffle is shared.
    """
    counts = cell_counts(df, columns) if counts is None else counts
    wanted = F.col("value").isNotNull() & F.col("column").isin(*columns)
    counts = counts.filter(F.when(wanted, F.col("n")) > 0)
    keyed = counts.withColumn("compare_key", compare_key(F.col("value")))
    # A count per key joined back, so that no window holds one key's spellings.
    several = keyed.groupBy("column", "compare_key").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
    return keyed.join(several, ["column", "compare_key"]).select(
        "column", "compare_key", "spellings", F.col("value").alias("spelling"), F.col("n").alias("rows")
    )


def balance_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F32: class balance per column, and the missing share of all cells."""
    counts = cell_counts(df, columns)
    n = F.when(F.col("value").isNotNull(), F.col("n"))
    balance = counts.groupBy("column").agg(
        F.count("value").alias("categories"),
        F.min(n).alias("minimum_class_count"),
        F.max(n).alias("maximum_class_count"),
        F.try_divide(F.max(n) - F.min(n), F.avg(n)).alias("relative_spread"),
    )
    return balance


def missing_cells_total(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """F32: missing cells of the whole table in one row."""
    columns = list(columns or df.columns)
    missing = sum((missing_null(df, c).cast("int") for c in columns), F.lit(0))
    total = F.count(F.lit(1)) * len(columns)
    return df.agg(F.coalesce(F.sum(missing), F.lit(0)).alias("total_missing_cells"), total.alias("total_cells")).withColumn(
        "missing_percentage",
        F.round(F.try_divide(F.col("total_missing_cells") * 100.0, F.col("total_cells")), 8),
    )



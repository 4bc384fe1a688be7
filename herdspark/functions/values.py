"""Missing-value predicates, number parsing and numeric helpers as columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that count as missing besides null and NaN.
MISSING_TEXTS = ("", "na", "n/a", "nan", "none", "null")

# One accepted decimal form, so that engines with laxer casts agree.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"


# Blank, tab and line-break characters, as a whole-text strip removes them.
WHITESPACE = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """Text without surrounding white space of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.CharType, T.VarcharType))


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def quoted(name: str) -> Column:
    """A column by its exact name, whatever dots, spaces or signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_text(value: Column) -> Column:
    """Null, NaN or one of the sentinel texts."""
    text = F.lower(stripped(value.cast("string")))
    return value.isNull() | text.isin(*MISSING_TEXTS)


def missing_blank(value: Column) -> Column:
    """Null, NaN or blank only; ``'na'`` is a value here."""
    rendered = value.cast("string")
    return value.isNull() | (rendered == "NaN") | (stripped(rendered) == "")


def missing_null(df: DataFrame, name: str) -> Column:
    """Null, and NaN for floating columns."""
    column = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def parse_number(text: Column) -> Column:
    """Text to double; infinities stay infinite and anything unparsable is null."""
    clean = stripped(text)
    infinite = F.when(clean.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(NUMBER_PATTERN), clean.try_cast("double")).when(
        text.rlike(INFINITY_PATTERN), infinite
    )


def number_of(df: DataFrame, name: str) -> Column:
    """The column as double with NaN as null; text is parsed, not trusted."""
    column = quoted(name)
    if is_number(df, name):
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    return parse_number(column.cast("string"))


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null; NaN sorts above infinity."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite_number(df: DataFrame, name: str) -> Column:
    return finite_or_null(number_of(df, name))


def first_number(texts: Sequence[Column]) -> Column:
    """The first usable number, also one embedded in text."""
    found = [F.regexp_extract(t.cast("string"), r"-?\d+(\.\d+)?", 0).try_cast("double") for t in texts]
    return F.coalesce(*found)


def decimal_places(value: Column, scale: int = 12) -> Column:
    """Shown decimals of a number, trailing zeros dropped."""
    # From 2^53 on a double is whole; beyond the decimal's range nothing is left to show.
    rendered = value.try_cast(T.DecimalType(38, scale)).cast("string")
    fraction = F.regexp_extract(rendered, r"\.(\d*?)0*$", 1)
    return F.when(value.isNotNull(), F.coalesce(F.length(fraction), F.lit(0)))


def round_quantity(quantity: Column, unit: Column, whole_units: Sequence[str]) -> Column:
    """Half-up rounding, whole for counted units and two decimals otherwise."""
    places = F.when(F.lower(stripped(unit)).isin(*whole_units), F.lit(1.0)).otherwise(F.lit(100.0))
    epsilon = F.lit(2.220446049250313e-16)
    rounded = F.floor((quantity + epsilon) * places + F.lit(0.5)).cast("double") / places
    # A double this large is whole already and would not fit a long.
    return F.when(F.abs(quantity) >= F.lit(2.0**52), quantity).otherwise(rounded)


def interval_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2] …``; outside is null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    chain = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (value > F.lit(float(low))) & (value <= F.lit(float(high)))
        if low == float("-inf"):
            inside = value <= F.lit(float(high))
        if high == float("inf"):
            inside = value > F.lit(float(low)) if low != float("-inf") else value.isNotNull()
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def present(items: Iterable[Column]) -> Column:
    """An array of the non-null items, in the given order."""
    return F.array_compact(F.array(*items))

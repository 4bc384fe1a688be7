"""Queries over values that strain a scalar function: wide identifiers, odd epochs, huge numbers, herd ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdspark.functions import dates, text, values
from herdspark.operators import latest, quality
from herdspark.plans.registry import query, table
from herdspark.plans.summary_queries import rounded


@query(
    "wide_identifiers",
    """SELECT o_orderkey, (o_orderkey + 10000000)::VARCHAR AS whole, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey // 2)::VARCHAR ELSE (o_orderkey // 2)::VARCHAR || '.5' END AS half,
       (o_orderkey * 1000000000000)::VARCHAR AS wide, '1E7' AS kept FROM orders""",
)
def wide_identifiers(spark, sf_dir):
    key = F.col("o_orderkey").cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.canonical_id(key + 10_000_000).alias("whole"), text.canonical_id(key / 2).alias("half"),
        text.canonical_id(key * 1e12).alias("wide"), text.canonical_id(F.lit("1E7")).alias("kept"),
    )


@query(
    "odd_epochs",
    f"""WITH t AS (SELECT o_orderkey, rpad(o_orderkey::VARCHAR, (5 + o_orderkey % 14)::INTEGER, '7') AS t FROM orders)
       SELECT o_orderkey, CASE WHEN length(t) BETWEEN 5 AND 18 AND t::BIGINT <= {dates.LAST_MILLISECOND} THEN epoch_ms(t::BIGINT)::DATE END AS day FROM t""",
)
def odd_epochs(spark, sf_dir):
    shown = F.rpad(F.col("o_orderkey").cast("string"), (5 + F.col("o_orderkey") % 14).cast("int"), "7")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parsed_date(shown).alias("day"))


@query(
    "huge_numbers",
    "SELECT l_orderkey, l_linenumber, 0 AS places, l_quantity * 1e30::DOUBLE AS kept, l_quantity::DOUBLE AS whole FROM lineitem",
)
def huge_numbers(spark, sf_dir):
    huge = F.col("l_quantity") * F.lit(1e30)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", values.decimal_places(huge).alias("places"),
        values.round_quantity(huge, F.lit("kg"), ["piece"]).alias("kept"),
        values.round_quantity(F.col("l_quantity") + 0.25, F.lit("Piece"), ["piece"]).alias("whole"),
    )


@query(
    "two_owner_upsert",
    """WITH cur AS (SELECT event_id AS id, user_id AS owner, ts, value FROM events WHERE event_type = 'view'),
       inc AS (SELECT event_id // 3 AS id, user_id AS owner, ts, value, event_id AS seq FROM events WHERE event_type <> 'view'),
       ok AS (SELECT i.* FROM inc i LEFT JOIN cur c USING (id) WHERE c.id IS NULL OR c.owner = i.owner QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY i.ts DESC, i.seq) = 1)
       SELECT id, owner, value FROM ok UNION ALL SELECT id, owner, value FROM cur WHERE id NOT IN (SELECT id FROM ok)""",
)
def two_owner_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "owner")
    view = F.col("event_type") == "view"
    current = events.filter(view).select(F.col("event_id").alias("id"), "owner", "ts", "value", F.col("event_id").alias("seq"))
    incoming = events.filter(~view).select(F.floor(F.col("event_id") / 3).alias("id"), "owner", "ts", "value", F.col("event_id").alias("seq"))
    return latest.owned_upsert(current, incoming, "id", "owner", F.col("ts"), "seq").select("id", "owner", "value")


# Line items under herd column names, spread over and beyond every audited range.
HERD_COLUMNS = {
    "Age_Months": "(l_quantity - 3) * 8", "Weight_kg": "l_quantity * 30 - 60", "Milk_Yield_L": "l_linenumber * 25 - 50",
    "Feed_Quantity_kg": "round(l_tax * 100) * 20 - 20", "Days_in_Milk": "round(l_discount * 100) * 100 - 100",
    "Humidity_percent": "l_quantity * 3 - 10", "Ambient_Temperature_C": "l_quantity * 2 - 30",
    "Body_Condition_Score": "l_linenumber - 1", "Parity": "(l_quantity - 5) / 2",
}
HERD_TESTS = (
    ("Negative age", "Age_Months", "Age_Months < 0"), ("Zero age", "Age_Months", "Age_Months = 0"),
    ("Implausible age", "Age_Months", "Age_Months > 300 OR Age_Months > 0 AND Age_Months < 12"),
    ("Negative weight", "Weight_kg", "Weight_kg < 0"), ("Zero weight", "Weight_kg", "Weight_kg = 0"),
    ("Implausible weight", "Weight_kg", "Weight_kg > 1200 OR Weight_kg > 0 AND Weight_kg < 50"),
    ("Negative milk yield", "Milk_Yield_L", "Milk_Yield_L < 0"), ("Zero milk yield", "Milk_Yield_L", "Milk_Yield_L = 0"),
    ("Suspiciously high milk yield", "Milk_Yield_L", "Milk_Yield_L > 100"),
    ("Negative feed quantity", "Feed_Quantity_kg", "Feed_Quantity_kg < 0"), ("Zero feed quantity", "Feed_Quantity_kg", "Feed_Quantity_kg = 0"),
    ("Suspiciously high feed quantity", "Feed_Quantity_kg", "Feed_Quantity_kg > 100"),
    ("Negative days in milk", "Days_in_Milk", "Days_in_Milk < 0"), ("Suspiciously high days in milk", "Days_in_Milk", "Days_in_Milk > 730"),
    ("Humidity outside 0-100", "Humidity_percent", "NOT Humidity_percent BETWEEN 0 AND 100"),
    ("Implausible ambient temperature", "Ambient_Temperature_C", "NOT Ambient_Temperature_C BETWEEN -20 AND 55"),
    ("Body-condition score outside detected 1-5 scale", "Body_Condition_Score", "NOT Body_Condition_Score BETWEEN 1 AND 5"),
    ("Invalid parity", "Parity", "Parity < 0 OR Parity > 20 OR floor(Parity) <> Parity"),
    ("Impossible age/lactation combination", "Days_in_Milk + Age_Months", "Days_in_Milk > Age_Months * 31"),
    ("Impossible young-age/parity combination", "Parity + Age_Months", "Parity > 0 AND Age_Months < 18"),
)


def _herd_sql() -> str:
    columns = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in HERD_COLUMNS.items())
    checks = " UNION ALL ".join(
        f"""SELECT '{issue}' AS issue, '{column}' AS "column", CASE WHEN n > 0 THEN 'FLAGGED' ELSE 'PASS' END AS status,
          '{"ERROR" if issue.startswith("Impossible") else "WARNING"}' AS severity, n AS affected_rows, round(n * 100.0 / t, 4) AS percentage
          FROM (SELECT count(*) FILTER (WHERE {test}) AS n, count(*) AS t FROM herd)"""
        for issue, column, test in HERD_TESTS
    )
    return f"WITH herd AS (SELECT {columns} FROM lineitem) {checks}"


@query("herd_range_checks", _herd_sql())
def herd_range_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(e).cast("double").alias(c) for c, e in HERD_COLUMNS.items()])
    return rounded(quality.rule_checks(rows, quality.herd_rules())).drop("evidence")

"""Summary, band and outlier queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdspark.operators import summary
from herdspark.plans.registry import query, table

SUMMARY_SQL = """
  count({v}) AS count,
  count(*) - count({v}) AS missing_count,
  round((count(*) - count({v})) * 100.0 / count(*), 4) AS missing_percentage,
  round(min({v}), 4) AS minimum, round(max({v}), 4) AS maximum,
  round(avg({v}), 4) AS mean, round(median({v}), 4) AS median,
  round(stddev_samp({v}), 4) AS standard_deviation,
  round(quantile_cont({v}, 0.01), 4) AS p01, round(quantile_cont({v}, 0.05), 4) AS p05,
  round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS p50,
  round(quantile_cont({v}, 0.75), 4) AS p75, round(quantile_cont({v}, 0.95), 4) AS p95,
  round(quantile_cont({v}, 0.99), 4) AS p99,
  count(*) FILTER (WHERE {v} = 0) AS zero_count,
  count(*) FILTER (WHERE {v} < 0) AS negative_count,
  count(DISTINCT {v}) AS unique_values
"""

LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def rounded(df, digits: int = 4):
    """Doubles rounded so that summation order does not show."""
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query(
    "grouping_sets_summary",
    f"""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'returnflag'
              WHEN grouping(l_linestatus) = 0 THEN 'linestatus' ELSE 'overall' END AS grouping,
         coalesce(l_returnflag, l_linestatus, 'ALL') AS "group", {SUMMARY_SQL.format(v='l_extendedprice')}
       FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""",
)
def grouping_sets_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    report = summary.grouping_report(
        lines, "l_extendedprice", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}, few_keys=True
    )
    return rounded(report)


@query(
    "column_numeric_summaries",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {SUMMARY_SQL.format(v=c)} FROM lineitem" for c in LINE_NUMBERS
    ),
)
def column_numeric_summaries(spark, sf_dir):
    return rounded(summary.column_summaries(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query(
    "finite_numeric_summary",
    f"""WITH t AS (SELECT CASE WHEN o_totalprice > 400000 THEN 'inf'::DOUBLE ELSE o_totalprice END AS price FROM orders),
       f AS (SELECT CASE WHEN isinf(price) THEN NULL ELSE price END AS v, price FROM t)
       SELECT 'price' AS "column", {SUMMARY_SQL.format(v='v')},
         count(*) FILTER (WHERE isinf(price)) AS non_finite_count FROM f""",
)
def finite_numeric_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_totalprice") > 400000, F.lit(float("inf")))
        .otherwise(F.col("o_totalprice"))
        .alias("price")
    )
    return summary.finite_summary(orders, ["price"], digits=4)


@query(
    "grouped_numeric_summary",
    f"""SELECT o_orderpriority, {SUMMARY_SQL.format(v='o_totalprice')}
        FROM orders GROUP BY o_orderpriority""",
)
def grouped_numeric_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(summary.numeric_summary(orders, "o_totalprice", ["o_orderpriority"]))


BAND_EDGES = (float("-inf"), 10, 20, 30, 40, float("inf"))
BAND_LABELS = ("<=10", "11-20", "21-30", "31-40", ">40")


@query(
    "banded_numeric_summary",
    f"""WITH t AS (SELECT l_extendedprice AS v, CASE WHEN l_quantity <= 10 THEN '<=10' WHEN l_quantity <= 20 THEN '11-20'
          WHEN l_quantity <= 30 THEN '21-30' WHEN l_quantity <= 40 THEN '31-40'
          WHEN l_quantity > 40 THEN '>40' END AS "group" FROM lineitem)
        SELECT "group", {SUMMARY_SQL.format(v='v')} FROM t GROUP BY "group" """,
)
def banded_numeric_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(
        summary.banded_summary(lines, "l_quantity", "l_extendedprice", BAND_EDGES, BAND_LABELS)
    )


def _fence_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", round(max(lo), 4) AS lower_fence, round(max(hi), 4) AS upper_fence,
      count(*) FILTER (WHERE {column} < lo) AS below_fence_count,
      count(*) FILTER (WHERE {column} > hi) AS above_fence_count
      FROM lineitem, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM lineitem))"""


@query("interquartile_fences", " UNION ALL ".join(_fence_sql(c) for c in LINE_NUMBERS))
def interquartile_fences(spark, sf_dir):
    return rounded(summary.outlier_fences(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))

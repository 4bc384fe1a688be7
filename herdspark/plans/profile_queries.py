"""Profile, quality, cleaning and validation queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from herdspark.functions import text, values
from herdspark.operators import cleaning, issues, profile, quality, relations, sketches, validate
from herdspark.operators.contracts import INFERENCE, TRAINING, FieldContract, ModelContract, TableContract
from herdspark.plans.derived import DIRTY_ORDERS, dirty_orders
from herdspark.plans.registry import query, table
from herdspark.plans.summary_queries import rounded
from herdspark.session import cut_lineage

ORDER_COLUMNS = {
    "o_orderkey": ("bigint", "integer"),
    "o_custkey": ("bigint", "integer"),
    "o_orderstatus": ("string", "categorical"),
    "o_totalprice": ("double", "continuous_numeric"),
    "o_orderpriority": ("string", "categorical"),
}


def _profile_sql(column: str, kind: str, inferred: str) -> str:
    low, high = (f"min({column})::DOUBLE", f"max({column})::DOUBLE") if kind != "string" else ("NULL::DOUBLE",) * 2
    return f"""SELECT '{column}' AS "column", '{kind}' AS data_type, '{inferred}' AS inferred_type,
      count(*) - count({column}) AS missing_count, 0.0::DOUBLE AS missing_percentage,
      count(DISTINCT {column}) AS unique_non_null, {low} AS minimum, {high} AS maximum FROM orders"""


@query("column_profile", " UNION ALL ".join(_profile_sql(c, *k) for c, k in ORDER_COLUMNS.items()))
def column_profile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    return profile.column_profile(orders).drop("sample_values")


@query("column_profile_sketched")
def column_profile_sketched(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    return profile.column_profile(orders, exact=False).drop("sample_values")


@query(
    "first_sample_values",
    """WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value, min(p_partkey) AS first_row FROM part GROUP BY p_brand
         UNION ALL SELECT 'p_type', p_type, min(p_partkey) FROM part GROUP BY p_type),
       r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first_row) AS rn FROM v)
       SELECT "column", string_agg(value, '|' ORDER BY rn) AS samples FROM r WHERE rn <= 5 GROUP BY "column" """,
)
def first_sample_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    counts = profile.cell_counts(part, ["p_brand", "p_type"], ordinal="p_partkey")
    return profile.first_values(counts, 5).select("column", F.array_join("sample_values", "|").alias("samples"))


@query(
    "value_type_counts",
    f"""WITH {DIRTY_ORDERS}, c AS (
         SELECT 'priority' AS "column", priority AS v FROM dirty UNION ALL SELECT 'price', price FROM dirty),
       k AS (SELECT "column", v, CASE WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '\\s*[+-]?\\d+\\s*') THEN 'integer'
         WHEN regexp_full_match(v, '\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN 'number' ELSE 'string' END AS value_type
         FROM c WHERE v IS NOT NULL AND trim(v) <> '')
       SELECT "column", value_type, count(*) AS cells, count(DISTINCT v) AS unique_count FROM k GROUP BY 1, 2""",
)
def value_type_counts(spark, sf_dir):
    return profile.value_type_counts(dirty_orders(spark, sf_dir), ["priority", "price"])


@query(
    "top_values_per_column",
    """WITH v AS (SELECT 'p_name' AS "column", p_name AS value, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_name
         UNION ALL SELECT 'p_brand', p_brand, count(*), min(p_partkey) FROM part GROUP BY p_brand),
       r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) AS rank FROM v),
       t AS (SELECT "column", sum(n)::BIGINT AS row_count, 0::BIGINT AS missing_count, count(*) AS unique_count FROM v GROUP BY 1)
       SELECT r."column", r.rank, r.value, r.n AS count, t.row_count, t.missing_count, t.unique_count
       FROM r JOIN t USING ("column") WHERE rank <= 10""",
)
def top_values_per_column(spark, sf_dir):
    return profile.value_profile(table(spark, sf_dir, "part"), ["p_name", "p_brand"], ordinal="p_partkey")


@query(
    "mixed_column_profile",
    f"""WITH {DIRTY_ORDERS}, v AS (SELECT coalesce(CASE WHEN lower(trim(priority)) IN ('', 'na', 'n/a', 'nan', 'none', 'null') THEN NULL ELSE priority END, 'MISSING') AS value FROM dirty),
       g AS (SELECT value, count(*) AS n FROM v GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM g)
       SELECT 'priority' AS "column", 'categorical' AS profile, value, n AS count, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum, NULL::DOUBLE AS mean FROM r WHERE k <= 20
       UNION ALL SELECT 'o_custkey', 'numeric', NULL, count(*), min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, round(avg(o_custkey), 4) FROM dirty""",
)
def mixed_column_profile(spark, sf_dir):
    return rounded(profile.mixed_profile(dirty_orders(spark, sf_dir), ["priority", "o_custkey"]))


def _missing_sql(column: str) -> str:
    test = f"{column} IS NULL OR lower(trim({column}::VARCHAR)) IN ('', 'na', 'n/a', 'nan', 'none', 'null')"
    return f"""SELECT '{column}' AS "column", count(*) FILTER (WHERE {test}) AS missing_count,
      round(100.0 * count(*) FILTER (WHERE {test}) / count(*), 6) AS missing_percentage FROM dirty"""


DIRTY_COLUMNS = ("o_orderkey", "priority", "price", "humidity")


@query("missing_by_sentinel", f"WITH {DIRTY_ORDERS} " + " UNION ALL ".join(_missing_sql(c) for c in DIRTY_COLUMNS))
def missing_by_sentinel(spark, sf_dir):
    return profile.missing_report(dirty_orders(spark, sf_dir), DIRTY_COLUMNS, "text")


@query(
    "missing_definitions",
    f"""WITH {DIRTY_ORDERS}, p AS (SELECT *, CASE WHEN price = 'abc' THEN 'N/A' ELSE price END AS q FROM dirty)
       SELECT count(*) FILTER (WHERE q IS NULL OR lower(trim(q)) IN ('', 'na', 'n/a', 'nan', 'none', 'null')) AS sentinel_missing,
         count(*) FILTER (WHERE q IS NULL OR trim(q) = '') AS blank_missing, count(*) FILTER (WHERE q IS NULL) AS null_missing FROM p""",
)
def missing_definitions(spark, sf_dir):
    price = F.when(F.col("price") == "abc", "N/A").otherwise(F.col("price"))
    rows = dirty_orders(spark, sf_dir).select(price.alias("q"))
    return rows.agg(
        F.count_if(values.missing_text(F.col("q"))).alias("sentinel_missing"),
        F.count_if(values.missing_blank(F.col("q"))).alias("blank_missing"),
        F.count_if(profile.missing_cell(rows, "q")).alias("null_missing"),
    )


@query(
    "class_distribution",
    f"""WITH {DIRTY_ORDERS}, g AS (SELECT priority AS class, count(*) AS n FROM dirty GROUP BY 1),
       t AS (SELECT sum(n) AS r, max(n) FILTER (WHERE class IS NOT NULL) AS hi, min(n) FILTER (WHERE class IS NOT NULL) AS lo,
         avg(n) FILTER (WHERE class IS NOT NULL) AS m FROM g)
       SELECT class, n AS count, round(n / r * 100, 4) AS percentage, class IS NOT NULL AND (n < 100 OR n / r < 0.01) AS is_rare,
         round((hi - lo) / m, 4) AS relative_spread FROM g, t""",
)
def class_distribution(spark, sf_dir):
    return rounded(profile.class_distribution(dirty_orders(spark, sf_dir), "priority"))


@query(
    "decimal_places",
    """WITH d AS (SELECT CAST(l_discount * 10 AS DECIMAL(38, 12))::VARCHAR AS s FROM lineitem)
       SELECT length(rtrim(split_part(s, '.', 2), '0')) AS decimals, count(*) AS count FROM d GROUP BY 1""",
)
def decimal_places(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("d"))
    return profile.decimal_place_counts(lines, "d")


@query(
    "target_audit",
    """SELECT 'l_quantity' AS "column", 'kg' AS unit, 'UNCLEAR' AS period, 'READY' AS status, count(l_quantity) AS usable_records,
         0.0::DOUBLE AS missing_percentage, min(l_quantity) AS minimum, max(l_quantity) AS maximum, round(avg(l_quantity), 4) AS mean,
         median(l_quantity) AS median, round(stddev_samp(l_quantity), 4) AS standard_deviation,
         count(*) FILTER (WHERE l_quantity = 0) AS zero_count, count(*) FILTER (WHERE l_quantity < 0) AS negative_count FROM lineitem""",
)
def target_audit(spark, sf_dir):
    facts = {"l_quantity": {"unit": "kg", "status": "READY"}}
    return rounded(profile.target_audit(table(spark, sf_dir, "lineitem"), facts))


def _class_risk_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", 'classification' AS task, array_to_string(list_filter([CASE WHEN count(*) < 2 THEN 'ONE_CLASS' END,
      CASE WHEN max(n) / sum(n) >= 0.8 THEN 'MAJORITY_80_PERCENT' END, CASE WHEN min(n) / sum(n) <= 0.05 THEN 'MINORITY_5_PERCENT' END,
      CASE WHEN count(*) > 20 THEN 'MORE_THAN_20_CLASSES' END], lambda x: x IS NOT NULL), ',') AS notes
      FROM (SELECT {column}, count(*) AS n FROM part GROUP BY 1)"""


@query(
    "target_risks",
    f"""{_class_risk_sql('p_name')} UNION ALL {_class_risk_sql('p_type')}
       UNION ALL SELECT 'p_retailprice', 'regression', array_to_string(list_filter([CASE WHEN count(DISTINCT p_retailprice) < 10 THEN 'FEW_DISTINCT_VALUES' END,
         CASE WHEN stddev_samp(p_retailprice) < 1e-9 THEN 'NEAR_ZERO_VARIANCE' END], lambda x: x IS NOT NULL), ',') FROM part""",
)
def target_risks(spark, sf_dir):
    risks = profile.target_risks(table(spark, sf_dir, "part"), ["p_name", "p_type"], ["p_retailprice"])
    return risks.withColumn("notes", F.array_join("notes", ","))


@query(
    "distribution_digest",
    """WITH g AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM g)
       SELECT 'p_brand' AS "column", value, n AS count, round(n * 100.0 / (SELECT count(*) FROM part), 4) AS percentage,
         NULL::DOUBLE AS mean, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum FROM r WHERE k <= 20
       UNION ALL SELECT 'p_size', NULL, count(p_size), NULL, round(avg(p_size), 4), min(p_size), max(p_size) FROM part""",
)
def distribution_digest(spark, sf_dir):
    return rounded(profile.distribution_digest(table(spark, sf_dir, "part"), ["p_brand", "p_size"]))


@query(
    "class_members",
    """SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'HOME' WHEN c_mktsegment IN ('MACHINERY') THEN 'WORK'
         ELSE 'UNCLASSIFIED' END AS class, c_mktsegment AS value, count(*) AS rows FROM customer GROUP BY 1, 2""",
)
def class_members(spark, sf_dir):
    classes = {"HOME": ("BUILDING", "FURNITURE"), "WORK": ("MACHINERY",)}
    return profile.class_members(table(spark, sf_dir, "customer"), "c_mktsegment", classes)


@query(
    "spelling_groups",
    f"""WITH {DIRTY_ORDERS}, v AS (SELECT priority AS spelling, regexp_replace(lower(priority), '[^a-z0-9]+', '', 'g') AS compare_key, count(*) AS rows
         FROM dirty WHERE priority IS NOT NULL GROUP BY 1, 2)
       SELECT 'priority' AS "column", compare_key, count(*) OVER (PARTITION BY compare_key) AS spellings, spelling, rows
       FROM v QUALIFY count(*) OVER (PARTITION BY compare_key) > 1""",
)
def spelling_groups(spark, sf_dir):
    return profile.spelling_groups(dirty_orders(spark, sf_dir), ["priority"])


def _balance_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS categories, min(n) AS minimum_class_count, max(n) AS maximum_class_count,
      round((max(n) - min(n)) / avg(n), 4) AS relative_spread FROM (SELECT {column}, count(*) AS n FROM orders GROUP BY 1)"""


@query("class_balance", " UNION ALL ".join(_balance_sql(c) for c in ("o_orderstatus", "o_orderpriority")))
def class_balance(spark, sf_dir):
    return rounded(profile.balance_indicators(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query(
    "missing_cells_total",
    f"""WITH {DIRTY_ORDERS} SELECT sum((priority IS NULL)::INT + (price IS NULL)::INT + (humidity IS NULL)::INT)::BIGINT AS total_missing_cells,
         count(*) * 5 AS total_cells, round(sum((priority IS NULL)::INT + (price IS NULL)::INT + (humidity IS NULL)::INT) * 100.0 / (count(*) * 5), 4) AS missing_percentage FROM dirty""",
)
def missing_cells_total(spark, sf_dir):
    return rounded(profile.missing_cells_total(dirty_orders(spark, sf_dir)))


PAIRS = (("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"))


@query(
    "pearson_correlations",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", count(*) AS pairs, round(corr({a}, {b}), 6) AS correlation FROM lineitem"""
        for a, b in PAIRS
    ),
)
def pearson_correlations(spark, sf_dir):
    return rounded(relations.correlations(table(spark, sf_dir, "lineitem"), PAIRS), 6)


ALL = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "all_pairs_correlation",
    "WITH t AS (SELECT *, l_quantity * 2 AS double_quantity FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", count(*) AS pairs, round(corr({a}, {b}), 6) AS correlation,
            abs(corr({a}, {b})) >= 0.9999 AS near_perfect FROM t"""
        for a, b in combinations((*ALL, "double_quantity"), 2)
    ),
)
def all_pairs_correlation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("double_quantity", F.col("l_quantity") * 2)
    return rounded(relations.all_correlations(lines, (*ALL, "double_quantity")), 6)


@query(
    "wide_correlations",
    """WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
       k AS (SELECT vec_id, i, CASE WHEN abs(x) >= 0.01 THEN x END AS x FROM v),
       p AS (SELECT a.i, b.i AS j, count(a.x + b.x) AS pairs, corr(a.x, b.x) AS r FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2)
       SELECT 'd' || i AS "left", 'd' || j AS "right", pairs, round(r, 6) AS correlation, abs(r) >= 0.9999 AS near_perfect FROM p""",
)
def wide_correlations(spark, sf_dir):
    """All pairs of an embedding's dimensions; small values count as missing."""
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    cell = [F.get("embedding", F.lit(i)).cast("double") for i in range(width)]
    wide = vectors.select(*[F.when(F.abs(c) >= 0.01, c).alias(f"d{i + 1}") for i, c in enumerate(cell)])
    return rounded(relations.all_correlations(wide, wide.columns), 6)


@query(
    "cramers_association",
    """WITH o AS (SELECT o_orderstatus AS l, o_orderpriority AS r, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
       x AS (SELECT sum(n * n / (rs * cs)) AS ratio FROM (SELECT n, sum(n) OVER (PARTITION BY l) AS rs, sum(n) OVER (PARTITION BY r) AS cs FROM o)),
       d AS (SELECT count(DISTINCT l) AS a, count(DISTINCT r) AS b FROM o)
       SELECT 'o_orderstatus' AS "left", 'o_orderpriority' AS "right", a AS left_values, b AS right_values,
         round(sqrt((ratio - 1) / (least(a, b) - 1)), 6) AS cramers_v FROM x, d""",
)
def cramers_association(spark, sf_dir):
    return rounded(relations.cramers_v(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), 6)


@query(
    "contingency_counts",
    """SELECT o_orderstatus AS "left", o_orderpriority AS "right", count(*) AS count FROM orders GROUP BY 1, 2""",
)
def contingency_counts(spark, sf_dir):
    return relations.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def _id_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", sum(n) FILTER (WHERE v IS NOT NULL)::BIGINT AS non_missing_count, count(v) AS unique_non_null,
      max(n) <= 1 AS is_unique_including_missing, count(*) FILTER (WHERE n > 1) AS distinct_repeated_values,
      coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_belonging_to_repeated_values, max(n) AS maximum_observations_per_value
      FROM (SELECT {column} AS v, count(*) AS n FROM orders GROUP BY 1)"""


@query("identifier_analysis", " UNION ALL ".join(_id_sql(c) for c in ("o_orderkey", "o_custkey")))
def identifier_analysis(spark, sf_dir):
    return relations.identifier_report(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])


@query(
    "date_analysis",
    """WITH t AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
       SELECT 'd' AS "column", count(TRY_CAST(d AS DATE)) AS parseable_count, count(*) - count(TRY_CAST(d AS DATE)) AS invalid_or_missing_count,
         min(TRY_CAST(d AS DATE)) AS minimum, max(TRY_CAST(d AS DATE)) AS maximum, count(DISTINCT TRY_CAST(d AS DATE)) AS unique_dates FROM t""",
)
def date_analysis(spark, sf_dir):
    shown = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "soon").otherwise(shown).alias("d"))
    return relations.date_report(rows, "d")


@query(
    "group_split_requirement",
    """SELECT 'o_custkey' AS identifier, count(*) FILTER (WHERE n > 1) > 0 AS group_based_split_required,
         count(*) FILTER (WHERE n > 1) > 0 AS repeated_observations_have_dates FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""",
)
def group_split_requirement(spark, sf_dir):
    return relations.group_split_requirement(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query(
    "repeated_observations",
    """SELECT count(*) AS unique_subjects, count(*) FILTER (WHERE n > 1) AS repeated_subjects, min(n) AS minimum_records,
         max(n) AS maximum_records, 'REPEATED' AS status, true AS grouped_validation_possible
       FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""",
)
def repeated_observations(spark, sf_dir):
    return relations.repeated_observations(table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "observations_histogram",
    """SELECT n AS records_per_subject, count(*) AS subjects FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1""",
)
def observations_histogram(spark, sf_dir):
    return relations.observations_histogram(table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "sequential_identifiers",
    """SELECT 's_name' AS "column", round(count(TRY_CAST(nullif(regexp_extract(s_name, '(\\d+)$', 1), '') AS DOUBLE)) * 100.0 / count(*), 6) AS numeric_suffix_parseable_percentage,
         round(count(*) FILTER (WHERE TRY_CAST(nullif(regexp_extract(s_name, '(\\d+)$', 1), '') AS DOUBLE) = s_suppkey) * 100.0 / count(*), 6) AS row_order_matches_percentage FROM supplier""",
)
def sequential_identifiers(spark, sf_dir):
    return relations.sequential_evidence(table(spark, sf_dir, "supplier"), "s_name", "s_suppkey")


@query(
    "duplicate_rows",
    """SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_row_count, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS rows_in_duplicate_groups
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def duplicate_rows(spark, sf_dir):
    return relations.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


LINE_RULES = [
    quality.Rule("Negative quantity", ("l_quantity",), lambda s: s < 0, "below 0"),
    quality.Rule("Small or large quantity", ("l_quantity",), lambda s: (s > 45) | ((s > 0) & (s < 5)), "5 to 45"),
    quality.Rule("Tax not whole percent", ("l_tax",), lambda s: F.floor(s * 100) != s * 100, "whole percent"),
    quality.Rule("Parity check", ("Parity",), lambda s: s < 0, "absent column"),
    quality.Rule("Discount above tax", ("l_discount", "l_tax"), lambda d, t: d > t, "two columns", "ERROR"),
]
UNCLEAR = (("Undocumented unit", "l_quantity"),)


def _rule_sql(issue, column, severity, test, evidence):
    return f"""SELECT '{issue}' AS issue, '{column}' AS "column", CASE WHEN count(*) FILTER (WHERE {test}) > 0 THEN 'FLAGGED' ELSE 'PASS' END AS status,
      '{severity}' AS severity, count(*) FILTER (WHERE {test}) AS affected_rows,
      round(count(*) FILTER (WHERE {test}) * 100.0 / count(*), 4) AS percentage, '{evidence}' AS evidence FROM lineitem"""


RULES_SQL = " UNION ALL ".join(
    [
        _rule_sql("Negative quantity", "l_quantity", "WARNING", "l_quantity < 0", "below 0"),
        _rule_sql("Small or large quantity", "l_quantity", "WARNING", "l_quantity > 45 OR (l_quantity > 0 AND l_quantity < 5)", "5 to 45"),
        _rule_sql("Tax not whole percent", "l_tax", "WARNING", "floor(l_tax * 100) <> l_tax * 100", "whole percent"),
        _rule_sql("Discount above tax", "l_discount + l_tax", "ERROR", "l_discount > l_tax", "two columns"),
        "SELECT 'Parity check', 'Parity', 'NOT_APPLICABLE', 'INFO', NULL, NULL, 'Column absent; check not applicable.'",
        "SELECT 'Undocumented unit', 'l_quantity', 'UNCLEAR', 'WARNING', NULL, NULL, 'Not stated by the source.'",
    ]
)


@query("range_rule_checks", RULES_SQL)
def range_rule_checks(spark, sf_dir):
    return rounded(quality.rule_checks(table(spark, sf_dir, "lineitem"), LINE_RULES, UNCLEAR))


CONSTANT_TABLE = """t AS (SELECT c_name, 'x' AS always, CASE WHEN c_custkey = 3 THEN 'odd' ELSE 'even' END AS nearly, c_nationkey FROM customer)"""


@query(
    "constancy_checks",
    f"""WITH {CONSTANT_TABLE}, c AS (
         SELECT 'always' AS "column", 'Constant column' AS issue, count(*) AS affected_rows, count(*) AS n FROM t
         UNION ALL SELECT 'nearly', 'Near-constant column', max(k), sum(k)::BIGINT FROM (SELECT count(*) AS k FROM t GROUP BY nearly) HAVING max(k) / sum(k) >= 0.999
         UNION ALL SELECT 'c_name', 'Extremely high-cardinality categorical column', count(DISTINCT c_name), count(*) FROM t HAVING count(DISTINCT c_name) > greatest(1000, floor(count(*) * 0.2)))
       SELECT issue, "column", 'FLAGGED' AS status, 'WARNING' AS severity, affected_rows, round(affected_rows * 100.0 / n, 4) AS percentage,
         'Counted over all rows.' AS evidence FROM c""",
)
def constancy_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_name", F.lit("x").alias("always"), F.when(F.col("c_custkey") == 3, "odd").otherwise("even").alias("nearly"), "c_nationkey"
    )
    return rounded(quality.constancy_checks(rows))


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def _spelling_sql(column: str) -> str:
    groups = f"(SELECT count(*) FROM (SELECT regexp_replace(lower({column}), '[^a-z0-9]+', '', 'g') AS k FROM lineitem GROUP BY k HAVING count(DISTINCT {column}) > 1))"
    return f"""SELECT 'spelling' AS section, 'Inconsistent categorical spelling' AS issue, '{column}' AS "column", CASE WHEN {groups} > 0 THEN 'FLAGGED' ELSE 'PASS' END AS status,
      'WARNING' AS severity, {groups} AS affected_rows, round({groups} * 100.0 / (SELECT count(*) FROM lineitem), 4) AS percentage,
      'Groups that differ only by case, blanks or punctuation.' AS evidence"""


@query(
    "whole_table_audit",
    f"""WITH n AS (SELECT count(*) AS rows FROM lineitem), d AS (SELECT rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS surplus, rows FROM n)
        SELECT 'duplicates' AS section, 'Duplicate complete rows' AS issue, 'ALL_COLUMNS' AS "column", CASE WHEN surplus > 0 THEN 'FLAGGED' ELSE 'PASS' END AS status,
          'WARNING' AS severity, surplus AS affected_rows, round(surplus * 100.0 / rows, 4) AS percentage, 'Exact duplicate across all parsed columns.' AS evidence FROM d
        UNION ALL SELECT 'rules', * FROM ({RULES_SQL})
        UNION ALL SELECT 'constancy', 'Extremely high-cardinality categorical column', 'l_shipdate', 'FLAGGED', 'WARNING', count(DISTINCT l_shipdate),
          round(count(DISTINCT l_shipdate) * 100.0 / count(*), 4), 'Counted over all rows.' FROM lineitem HAVING count(DISTINCT l_shipdate) > greatest(1000, floor(count(*) * 0.2))
        UNION ALL {_spelling_sql('l_returnflag')} UNION ALL {_spelling_sql('l_linestatus')}
        UNION ALL SELECT 'missing', 'Missing values', c, CASE WHEN k > 0 THEN 'FLAGGED' ELSE 'PASS' END, 'WARNING', k, round(k * 100.0 / rows, 4), 'Null, NaN or a text that stands for none.'
          FROM (SELECT unnest([{', '.join(f"'{c}'" for c in LINE_COLUMNS)}]) AS c, unnest([{', '.join(f"count(*) FILTER ({c} IS NULL)" for c in LINE_COLUMNS)}]) AS k FROM lineitem), n
        UNION ALL SELECT 'identifiers', 'Repeated identifiers', 'l_orderkey', 'FLAGGED', 'WARNING', count(*) - count(DISTINCT l_orderkey), round((count(*) - count(DISTINCT l_orderkey)) * 100.0 / count(*), 4),
          'Rows beyond the first of each identifier.' FROM lineitem
        UNION ALL SELECT 'leakage', 'Leakage towards l_tax', 'l_tax', 'FLAGGED', 'ERROR', NULL, NULL, 'TARGET'""",
)
def whole_table_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rounded(quality.table_audit(rows, LINE_RULES, UNCLEAR, ["l_orderkey"], "lines", ["l_tax"]))


SKETCHED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")


@query(
    "merged_sketch_errors",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(DISTINCT {c}) AS exact_distinct, true AS distinct_within, {'true' if c in SKETCHED[:3] else 'NULL::BOOLEAN'} AS ranks_within FROM lineitem"""
        for c in SKETCHED
    ),
)
def merged_sketch_errors(spark, sf_dir):
    """Sketches kept per return flag, those of two parts merged first and the last one later, against exact counts."""
    lines = table(spark, sf_dir, "lineitem")
    kept = cut_lineage(sketches.part_sketches(lines, SKETCHED, "l_returnflag"))
    early = sketches.merged_sketches(kept.filter("part <> 'R'"))
    profiled = cut_lineage(sketches.sketched_profile(sketches.merged_sketches(early.unionByName(kept.filter("part = 'R'")))))
    return profiled.select("column", "rows").join(sketches.sketch_errors(lines, profiled, SKETCHED), "column")


AUDITED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "customer_twice")


@query(
    "dataset_audit_sections",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
          CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 2 END AS customer_twice FROM orders),
        n AS (SELECT count(*) AS rows FROM t),
        b AS (SELECT 'o_orderstatus' AS c, max(k) - min(k) AS d, avg(k) AS m, sum(k)::BIGINT AS rows FROM (SELECT count(*) AS k FROM t GROUP BY o_orderstatus)
          UNION ALL SELECT 'o_orderpriority', max(k) - min(k), avg(k), sum(k)::BIGINT FROM (SELECT count(*) AS k FROM t GROUP BY o_orderpriority))
        SELECT 'profile' AS section, 'Distinct values' AS issue, c AS "column", 'INFO' AS status, 'INFO' AS severity, k AS affected_rows, round(k * 100.0 / rows, 4) AS percentage, e AS evidence
          FROM (SELECT unnest([{', '.join(f"'{c}'" for c in AUDITED)}]) AS c, unnest([{', '.join(f"count(DISTINCT {c})" for c in AUDITED)}]) AS k,
            unnest([{', '.join(f"'{kind}: ' || min({c})::VARCHAR || ' to ' || max({c})::VARCHAR" for c, kind in zip(AUDITED, ("bigint", "bigint", "string", "timestamp_ntz", "string", "bigint"), strict=True))}]) AS e FROM t), n
        UNION ALL SELECT 'empty rows', 'Empty rows', 'ALL_COLUMNS', 'PASS', 'WARNING', 0, 0.0, 'Rows whose cells are all missing.'
        UNION ALL SELECT 'populations', 'Population ' || CASE WHEN o_orderstatus IN ('O', 'F') THEN 'KNOWN' ELSE 'UNCLASSIFIED' END, 'o_orderstatus', CASE WHEN o_orderstatus IN ('O', 'F') THEN 'INFO' ELSE 'FLAGGED' END,
          CASE WHEN o_orderstatus IN ('O', 'F') THEN 'INFO' ELSE 'WARNING' END, count(*), round(count(*) * 100.0 / any_value(rows), 4), count(DISTINCT o_orderstatus) || ' distinct values.' FROM t, n GROUP BY ALL
        UNION ALL SELECT 'candidates', 'Candidate feature customer', 'o_custkey', 'PASS', 'INFO', count(*) - count(o_custkey), round((count(*) - count(o_custkey)) * 100.0 / count(*), 4), 'SAFE_WITH_INPUT_VALIDATION' FROM t
        UNION ALL SELECT 'candidates', 'Candidate feature weight', 'weight', 'NOT_APPLICABLE', 'INFO', NULL, NULL, 'No column of this name or its aliases.'
        UNION ALL SELECT 'synthetic', 'Evenly balanced classes', c, CASE WHEN d <= 0.05 * m THEN 'FLAGGED' ELSE 'PASS' END, 'INFO', d, round(d * 100.0 / rows, 4), 'Rows between the largest and the smallest class.' FROM b
        UNION ALL SELECT 'synthetic', 'Near-perfect correlation', 'o_custkey, customer_twice', 'FLAGGED', 'WARNING', count(o_custkey), 100.0, 'Correlation of 0.9999 or more over complete pairs.' FROM t""".replace(
        "GROUP BY ALL", "GROUP BY o_orderstatus IN ('O', 'F')").replace("CASE WHEN o_orderstatus IN ('O', 'F')", "CASE WHEN any_value(o_orderstatus) IN ('O', 'F')"),
)
def dataset_audit_sections(spark, sf_dir):
    """The sections that the whole audit has beyond those of a table."""
    customer = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", customer.alias("o_custkey"), "o_orderstatus", "o_orderdate", "o_orderpriority", (customer * 2).alias("customer_twice")
    )
    found = quality.dataset_audit(
        rows, (), populations={"o_orderstatus": {"KNOWN": ("O", "F")}}, candidates={"customer": ("O custkey",), "weight": ()},
        availability={"customer": "PROVIDED"}, balanced=("o_orderstatus", "o_orderpriority"),
    )
    return rounded(found.filter(F.col("section").isin("profile", "empty rows", "populations", "candidates", "synthetic")))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORDER_CONTRACT = TableContract(
    fields={
        "priority": FieldContract("priority", "category", True, PRIORITIES, {"rush": "1-URGENT"}),
        "price": FieldContract("price", "number", True, minimum=1000, maximum=450000, nonnegative=True, warn_zero=True,
                               hard_range_at_inference=True),
        "humidity": FieldContract("humidity", "number", minimum=2, maximum=200, percentage=True),
    },
    models={"m": ModelContract("m", ("priority", "humidity"), "price"), "s": ModelContract("s", ("price", "humidity"), "priority")},
    targets=("price",),
    traceability=("o_orderkey",),
)

NUMERIC_SQL = "regexp_full_match({c}, '\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')"
CLEAN_SQL = f"""{DIRTY_ORDERS}, base AS (SELECT *, trim(priority) AS tp,
    CASE WHEN {NUMERIC_SQL.format(c='price')} THEN price::DOUBLE END AS number FROM dirty),
  clean AS (SELECT *, CASE WHEN tp = '' THEN NULL WHEN lower(tp) = 'rush' THEN '1-URGENT'
    WHEN upper(tp) IN {PRIORITIES} THEN upper(tp) ELSE tp END AS new_priority FROM base)"""


@query(
    "cleaned_values",
    f"""WITH {CLEAN_SQL} SELECT o_orderkey, o_custkey, new_priority AS priority, number AS price, humidity FROM clean""",
)
def cleaned_values(spark, sf_dir):
    return cleaning.clean_table(dirty_orders(spark, sf_dir), ORDER_CONTRACT)


ISSUES_SQL = f"""{CLEAN_SQL}, issues AS (
  SELECT o_orderkey, 'priority' AS field, 'EMPTY_STRING' AS issue_type, priority AS original_value, NULL AS normalized_value, 'WARNING' AS severity, 'SET_TO_MISSING' AS action FROM clean WHERE tp = ''
  UNION ALL SELECT o_orderkey, 'priority', CASE WHEN tp <> priority AND tp = new_priority THEN 'SURROUNDING_WHITESPACE' ELSE 'APPROVED_CATEGORY_NORMALIZATION' END,
    priority, new_priority, 'INFO', 'NORMALIZED' FROM clean WHERE tp <> '' AND new_priority <> priority
  UNION ALL SELECT o_orderkey, 'priority', 'UNKNOWN_CATEGORY', priority, new_priority, 'WARNING', 'PRESERVED' FROM clean WHERE tp <> '' AND new_priority NOT IN {PRIORITIES}
  UNION ALL SELECT o_orderkey, 'price', 'NON_FINITE_NUMERIC_VALUE', price, NULL, 'ERROR', 'SET_TO_MISSING' FROM clean WHERE price = 'inf'
  UNION ALL SELECT o_orderkey, 'price', 'INVALID_NUMERIC_VALUE', price, NULL, 'ERROR', 'SET_TO_MISSING' FROM clean WHERE price = 'abc'
  UNION ALL SELECT o_orderkey, 'price', 'NUMERIC_STRING', price, number::VARCHAR, 'INFO', 'NORMALIZED' FROM clean WHERE number IS NOT NULL)"""


@query("cleaning_issue_log", f"WITH {ISSUES_SQL} SELECT * FROM issues")
def cleaning_issue_log(spark, sf_dir):
    return cleaning.cleaning_issues(dirty_orders(spark, sf_dir), ORDER_CONTRACT, ["o_orderkey"])


@query(
    "cleaning_issue_counts",
    f"""WITH {ISSUES_SQL} SELECT 'action' AS kind, action AS name, count(*) AS count FROM issues GROUP BY 2
        UNION ALL SELECT 'issue_type', issue_type, count(*) FROM issues GROUP BY 2""",
)
def cleaning_issue_counts(spark, sf_dir):
    return cleaning.issue_counts(cleaning.cleaning_issues(dirty_orders(spark, sf_dir), ORDER_CONTRACT, ["o_orderkey"]))


@query(
    "row_preservation",
    "SELECT count(*) AS input_row_count, count(*) AS output_row_count, 0::BIGINT AS rows_dropped, 0::BIGINT AS rows_added FROM orders",
)
def row_preservation(spark, sf_dir):
    before = dirty_orders(spark, sf_dir)
    return cleaning.preservation_evidence(before, cleaning.clean_table(before, ORDER_CONTRACT), "o_orderkey")


def _verdict_sql(mode: str) -> str:
    hard = mode == INFERENCE
    checks = [
        ("price", "INVALID_NUMERIC_VALUE", "ERROR", "price = 'abc'", "seen", True),
        ("price", "NON_FINITE_NUMERIC_VALUE", "ERROR", "price = 'inf'", "seen", True),
        ("price", "MISSING_NUMERIC_VALUE", "WARNING" if hard else "ERROR", "price IS NULL", None, True),
        ("price", "HARD_INVALID_NEGATIVE", "ERROR", "number < 0", "seen", True),
        ("price", "CONTRACT_RANGE_VIOLATION", "ERROR" if hard else "WARNING",
         "price = 'inf' OR number < 1000 OR number > 450000", "seen", True),
        ("price", "ZERO_SYNTHETIC_MILK_TARGET", "WARNING", "number = 0", None, True),
        ("humidity", "MISSING_NUMERIC_VALUE", "WARNING", "humidity IS NULL", None, True),
        ("humidity", "HARD_INVALID_HUMIDITY", "ERROR", "humidity < 0 OR humidity > 100", "seen", True),
        ("humidity", "CONTRACT_RANGE_VIOLATION", "WARNING", "humidity < 2 OR humidity > 200", "seen", True),
        ("priority", "UNKNOWN_CATEGORY", "WARNING", f"priority IS NOT NULL AND upper(tp) NOT IN {PRIORITIES}", "listed", False),
        ("priority", "CATEGORY_FORMAT_VARIANT", "WARNING", f"upper(tp) IN {PRIORITIES} AND priority NOT IN {PRIORITIES}", "listed", False),
        ("priority", "MISSING_REQUIRED_CATEGORY", "ERROR", "priority IS NULL OR tp = ''", None, True),
    ]
    parts = []
    for field, issue, severity, test, sample, rows in checks:
        action = {"ERROR": "REJECTED_BY_SCHEMA"}.get(severity, "NORMALIZED" if "VARIANT" in issue else "PRESERVED")
        # Distinct values in row order, or in text order for category findings.
        order, limit = ("f", 5) if sample == "seen" else ("v", 10)
        values_sql = "NULL" if sample is None else f"""(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT {field}::VARCHAR AS v, min(o_orderkey) AS f FROM base WHERE {test} GROUP BY 1 ORDER BY {order} LIMIT {limit}))"""
        rows_sql = f"(SELECT string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) FROM (SELECT o_orderkey FROM base WHERE {test} ORDER BY 1 LIMIT 5))" if rows else "NULL"
        parts.append(
            f"""SELECT '{field}' AS field, '{issue}' AS issue_type, '{severity}' AS severity, '{action}' AS action,
              count(*) AS affected_count, {values_sql} AS sample_values, {rows_sql} AS sample_rows FROM base WHERE {test} HAVING count(*) > 0"""
        )
    unexpected = "'o_custkey', 'price'" if hard else "'o_custkey'"
    listed = unexpected.replace("', '", "|")
    count = 2 if hard else 1
    parts.append(f"SELECT '__schema__', 'UNEXPECTED_FIELDS', 'INFO', 'PRESERVED', {count}, {listed}, NULL")
    if hard:
        parts.append("SELECT '__schema__', 'TARGET_FIELDS_FORBIDDEN_AT_INFERENCE', 'ERROR', 'REJECTED_BY_SCHEMA', 1, 'price', NULL")
    return f"WITH {CLEAN_SQL} " + " UNION ALL ".join(parts)


def _validated(spark, sf_dir, mode):
    found = validate.validate_table(dirty_orders(spark, sf_dir), "m", mode, "o_orderkey", ORDER_CONTRACT)
    return found.withColumns(
        {c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("sample_values", "sample_rows")}
    )


@query("contract_validation_training", _verdict_sql(TRAINING))
def contract_validation_training(spark, sf_dir):
    return _validated(spark, sf_dir, TRAINING)


@query("contract_validation_inference", _verdict_sql(INFERENCE))
def contract_validation_inference(spark, sf_dir):
    return _validated(spark, sf_dir, INFERENCE)


@query(
    "validation_verdict",
    f"""WITH f AS ({_verdict_sql(TRAINING)}) SELECT count(*) FILTER (WHERE severity = 'ERROR') = 0 AS valid, count(*) FILTER (WHERE severity = 'ERROR') AS errors,
        count(*) FILTER (WHERE severity = 'WARNING') AS warnings, coalesce(sum(affected_count) FILTER (WHERE severity = 'ERROR'), 0)::BIGINT AS error_rows FROM f""",
)
def validation_verdict(spark, sf_dir):
    return validate.verdict(validate.validate_table(dirty_orders(spark, sf_dir), "m", TRAINING, "o_orderkey", ORDER_CONTRACT))


@query(
    "row_quality_issues",
    f"""WITH {CLEAN_SQL}, i AS (
         SELECT o_orderkey::VARCHAR AS source_row, o_custkey::VARCHAR AS identifier, 'priority' AS field, 'MISSING_VALUE' AS issue_type, priority AS value, 'WARNING' AS severity FROM base WHERE priority IS NULL OR tp = ''
         UNION ALL SELECT o_orderkey::VARCHAR, o_custkey::VARCHAR, 'price', 'MISSING_VALUE', price, 'WARNING' FROM base WHERE price IS NULL OR trim(price) = ''
         UNION ALL SELECT o_orderkey::VARCHAR, o_custkey::VARCHAR, 'price', 'TEXT_IN_NUMERIC_COLUMN', price, 'ERROR' FROM base WHERE price = 'abc' OR number < 0
         UNION ALL SELECT o_orderkey::VARCHAR, o_custkey::VARCHAR, 'price', 'NEGATIVE_PHYSICAL_VALUE', price, 'ERROR' FROM base WHERE number < 0
         UNION ALL SELECT o_orderkey::VARCHAR, o_custkey::VARCHAR, 'price', 'ZERO_VALUE', price, 'WARNING' FROM base WHERE number = 0
         UNION ALL SELECT 'MULTIPLE', o_custkey::VARCHAR, 'o_custkey', 'DUPLICATE_SAMPLE_IDENTIFIER', count(*)::VARCHAR, 'WARNING' FROM base GROUP BY o_custkey HAVING count(*) > 1)
       SELECT * FROM i""",
)
def row_quality_issues(spark, sf_dir):
    return issues.row_issues(
        dirty_orders(spark, sf_dir), "o_orderkey", "o_custkey", ["price"], ["price"], ["price"], ["priority", "price"]
    )


NAMES = """l AS (SELECT p_partkey, CASE WHEN p_size = 3 THEN NULL WHEN p_size = 4 THEN ' , /' ELSE replace(p_name, ' ', ' / ') || CASE WHEN p_size > 40 THEN ', ' || upper(split_part(p_name, ' ', 1)) ELSE '' END END AS items FROM part),
  t AS (SELECT p_partkey, items, list_filter(list_transform(string_split_regex(coalesce(items, ''), '[,/]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM l)"""


def _ingredients(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    doubled = F.when(size > 40, F.concat(F.lit(", "), F.upper(F.split_part(name, F.lit(" "), F.lit(1))))).otherwise("")
    items = F.when(size == 3, F.lit(None)).when(size == 4, " , /").otherwise(
        F.concat(F.replace(name, F.lit(" "), F.lit(" / ")), doubled)
    )
    return table(spark, sf_dir, "part").select("p_partkey", items.alias("items"))


@query(
    "ingredient_list_issues",
    f"""WITH {NAMES}, r AS (SELECT p_partkey, x, count(*) AS n FROM (SELECT p_partkey, unnest(list_transform(p, lambda y: lower(y))) AS x FROM t) GROUP BY 1, 2 HAVING count(*) > 1)
       SELECT p_partkey, 'items' AS field, 'REPEATED_INGREDIENT_IN_SAMPLE' AS issue_type, string_agg(x, ', ' ORDER BY x) AS value, 'WARNING' AS severity FROM r GROUP BY 1
       UNION ALL SELECT p_partkey, 'items', 'MISSING_INGREDIENT_LIST', items, 'ERROR' FROM t WHERE items IS NULL""",
)
def ingredient_list_issues(spark, sf_dir):
    return issues.list_issues(_ingredients(spark, sf_dir), "items", ["p_partkey"])


@query(
    "ingredient_summary",
    f"""WITH {NAMES} SELECT (SELECT count(*) FROM t) AS sample_count, (SELECT sum(len(p))::BIGINT FROM t) AS token_count,
         (SELECT count(*) FROM t WHERE len(list_distinct(list_transform(p, lambda y: lower(y)))) < len(p)) AS samples_with_repeated_tokens,
         (SELECT count(DISTINCT x) FROM (SELECT unnest(p) AS x FROM t)) AS unique_token_count""",
)
def ingredient_summary(spark, sf_dir):
    return issues.list_summary(_ingredients(spark, sf_dir), "items")


@query(
    "top_ingredients",
    f"""WITH {NAMES}, u AS (SELECT unnest(p) AS item FROM t) SELECT item, count(*) AS count FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_ingredients(spark, sf_dir):
    return issues.top_items(_ingredients(spark, sf_dir), "items")


@query(
    "document_word_summary",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS p FROM documents)
       SELECT (SELECT count(*) FROM w) AS sample_count, (SELECT sum(len(p))::BIGINT FROM w) AS token_count,
         (SELECT count(*) FROM w WHERE len(list_distinct(list_transform(p, lambda y: lower(y)))) < len(p)) AS samples_with_repeated_tokens,
         (SELECT count(DISTINCT x) FROM (SELECT unnest(p) AS x FROM w)) AS unique_token_count""",
)
def document_word_summary(spark, sf_dir):
    words = F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda x: x != "")
    return issues.list_summary(table(spark, sf_dir, "documents"), "text", words)


@query(
    "uncovered_identifiers",
    """WITH l AS (SELECT doc_id FROM documents), r AS (SELECT doc_id + 100 AS doc_id FROM labels)
       SELECT 'left_only' AS side, doc_id AS source_row, doc_id::VARCHAR AS identifier, 'doc_id' AS field, 'CROSS_TABLE_ID_COVERAGE_MISMATCH' AS issue_type, 'HIGH' AS severity FROM l WHERE doc_id NOT IN (SELECT doc_id FROM r)
       UNION ALL SELECT 'right_only', doc_id, doc_id::VARCHAR, 'doc_id', 'CROSS_TABLE_ID_COVERAGE_MISMATCH', 'HIGH' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM l)""",
)
def uncovered_identifiers(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("doc_id")
    right = table(spark, sf_dir, "labels").select((F.col("doc_id") + 100).alias("doc_id"))
    return issues.uncovered_ids(left, right, "doc_id", "doc_id", "doc_id")


@query(
    "label_variants",
    f"""WITH {DIRTY_ORDERS} SELECT priority AS label, upper(replace(replace(replace(trim(priority), '_', ''), ' ', ''), '%', '')) AS canonical, min(o_orderkey) AS source_row, count(*) AS rows
       FROM dirty WHERE priority <> upper(replace(replace(replace(trim(priority), '_', ''), ' ', ''), '%', '')) AND trim(priority) <> '' GROUP BY 1, 2""",
)
def label_variants(spark, sf_dir):
    return issues.label_variants(dirty_orders(spark, sf_dir), "priority", text.bare_upper(F.col("priority")), "o_orderkey")


@query(
    "mixed_identifier_types",
    f"""WITH {DIRTY_ORDERS} SELECT CASE WHEN regexp_full_match(price, '\\s*[+-]?\\d+(\\.\\d+)?\\s*') THEN 'number' ELSE 'text' END AS cell_type, count(*) AS rows FROM dirty WHERE price IS NOT NULL GROUP BY 1""",
)
def mixed_identifier_types(spark, sf_dir):
    return issues.mixed_id_types(dirty_orders(spark, sf_dir), "price")

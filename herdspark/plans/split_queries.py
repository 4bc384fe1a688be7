"""Split, fold, sample, metric and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdspark.operators import metrics, requests, splits
from herdspark.plans.registry import query, table
from herdspark.plans.summary_queries import rounded

RANKED = """r AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, md5('42|' || o_orderkey::VARCHAR) AS h,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
  s AS (SELECT *, CASE WHEN k <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split FROM r)"""


def _manifest(spark, sf_dir):
    return splits.split_assignments(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


def _split_orders(spark, sf_dir):
    manifest = _manifest(spark, sf_dir).select("o_orderkey", "split")
    return table(spark, sf_dir, "orders").join(manifest, "o_orderkey")


@query(
    "stratified_split",
    f"WITH {RANKED} SELECT o_orderkey, o_orderpriority, split, 42 AS random_seed, 'split_v1' AS split_version FROM s",
)
def stratified_split(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(
    "split_checks",
    f"WITH {RANKED} SELECT count(*) AS rows, 0::BIGINT AS duplicate_keys, 0::BIGINT AS unassigned_rows, (SELECT count(*) FROM (SELECT o_custkey FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS groups_in_several_splits FROM s",
)
def split_checks(spark, sf_dir):
    return splits.split_checks(_split_orders(spark, sf_dir), "o_orderkey", "o_custkey")


@query("split_shares", f"WITH {RANKED} SELECT split, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM s), 4) AS percentage FROM s GROUP BY 1")
def split_shares(spark, sf_dir):
    return rounded(splits.split_shares(_manifest(spark, sf_dir)))


@query(
    "class_shares_by_split",
    f"WITH {RANKED} SELECT split, o_orderpriority, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 4) AS percentage FROM s GROUP BY 1, 2",
)
def class_shares_by_split(spark, sf_dir):
    return rounded(splits.class_shares(_manifest(spark, sf_dir), "o_orderpriority"))


@query(
    "numeric_summary_by_split",
    f"""WITH {RANKED} SELECT split, count(o_totalprice) AS count, 0::BIGINT AS missing_count, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS standard_deviation, min(o_totalprice) AS minimum,
        round(quantile_cont(o_totalprice, 0.25), 3) AS p25, round(median(o_totalprice), 3) AS median, round(quantile_cont(o_totalprice, 0.75), 3) AS p75, max(o_totalprice) AS maximum FROM s GROUP BY 1""",
)
def numeric_summary_by_split(spark, sf_dir):
    return rounded(splits.numeric_by_split(_split_orders(spark, sf_dir), "o_totalprice"), 3)


@query(
    "mean_difference_by_split",
    f"""WITH {RANKED}, o AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM orders)
        SELECT split, round(abs(avg(o_totalprice) - max(m)) / max(d), 4) AS standardised_difference, round(abs(avg(o_totalprice) - max(m)) / max(d), 6) > 0.1 AS material FROM s, o GROUP BY 1""",
)
def mean_difference_by_split(spark, sf_dir):
    return rounded(splits.mean_differences(_split_orders(spark, sf_dir), "o_totalprice"))


@query(
    "stratified_folds",
    f"""WITH {RANKED}, f AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42-fold|' || o_orderkey::VARCHAR), o_orderkey) AS k FROM s WHERE split = 'train')
        SELECT o_orderkey, o_orderpriority, ((k - 1) % 5 + 1)::INTEGER AS training_fold, 42 AS random_seed, 'fold_v1' AS fold_version FROM f""",
)
def stratified_folds(spark, sf_dir):
    return splits.training_folds(_manifest(spark, sf_dir), "o_orderpriority", "o_orderkey")


GROUPS = """g AS (SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1),
  h AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || l_orderkey::VARCHAR), l_orderkey) AS k, count(*) OVER () AS n FROM g),
  p AS (SELECT *, CASE WHEN k <= ceil(n * 0.2::DOUBLE) THEN 'holdout' ELSE 'development' END AS partition FROM h),
  d AS (SELECT *, row_number() OVER (ORDER BY rows DESC, k) - 1 AS pos FROM p WHERE partition = 'development'),
  a AS (SELECT l_orderkey, CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 + 1 ELSE 5 - pos % 5 END::INTEGER AS group_fold FROM d),
  assigned AS (SELECT p.l_orderkey, p.rows, p.partition, a.group_fold FROM p LEFT JOIN a USING (l_orderkey))"""


def _groups(spark, sf_dir):
    return splits.group_assignments(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("group_holdout_and_folds", f"WITH {GROUPS} SELECT * FROM assigned")
def group_holdout_and_folds(spark, sf_dir):
    return _groups(spark, sf_dir)


def _grouped_rows(spark, sf_dir):
    return splits.apply_groups(table(spark, sf_dir, "lineitem"), _groups(spark, sf_dir), "l_orderkey")


@query(
    "group_split_proof",
    f"""WITH {GROUPS}, c AS (SELECT count(DISTINCT group_fold) AS f FROM assigned)
        SELECT unnest(['GROUPS_ACROSS_PARTITIONS', 'GROUPS_ACROSS_FOLDS', 'UNASSIGNED_ROWS', 'DEVELOPMENT_ROWS_WITHOUT_FOLD', 'HOLDOUT_ROWS_WITH_FOLD', 'EMPTY_FOLDS']) AS "check",
          true AS passed, unnest([0, 0, 0, 0, 0, 5 - f])::BIGINT AS observed FROM c""",
)
def group_split_proof(spark, sf_dir):
    return splits.group_checks(_grouped_rows(spark, sf_dir), "l_orderkey")


@query("group_split_shares", f"WITH {GROUPS} SELECT partition, group_fold, sum(rows)::BIGINT AS rows, count(*) AS groups FROM assigned GROUP BY 1, 2")
def group_split_shares(spark, sf_dir):
    return splits.group_shares(_grouped_rows(spark, sf_dir), "l_orderkey")


@query("fixed_size_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def fixed_size_sample(spark, sf_dir):
    return splits.fixed_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query(
    "stratified_subset",
    f"""WITH {RANKED}, q AS (SELECT o_orderpriority, count(*) * 777.0::DOUBLE / (SELECT count(*) FROM orders) AS e FROM orders GROUP BY 1),
        w AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, o_orderpriority) <= 777 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM q)
        SELECT o_orderkey, r.o_orderpriority FROM r JOIN w USING (o_orderpriority) WHERE k <= quota""",
)
def stratified_subset(spark, sf_dir):
    rows = splits.stratified_subset(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 777)
    return rows.select("o_orderkey", "o_orderpriority")


@query("balanced_class_weights", "SELECT o_orderstatus, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS class_weight FROM orders GROUP BY 1")
def balanced_class_weights(spark, sf_dir):
    return rounded(splits.class_weights(table(spark, sf_dir, "orders"), "o_orderstatus"), 6)


@query(
    "manifest_integrity",
    f"""WITH {RANKED}, x AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1))
        SELECT unnest(['DUPLICATE_KEYS', 'NULL_KEYS', 'UNASSIGNED_ROWS', 'GROUPS_IN_SEVERAL_SPLITS', 'TRAINING_ROWS_WITHOUT_FOLD', 'OTHER_ROWS_WITH_FOLD', 'FOLD_OUT_OF_RANGE', 'EMPTY_FOLDS']) AS "check",
          unnest([true, true, true, n = 0, true, true, true, true]) AS passed, unnest([0, 0, 0, n, 0, 0, 0, 0])::BIGINT AS observed FROM x""",
)
def manifest_integrity(spark, sf_dir):
    folds = splits.training_folds(_manifest(spark, sf_dir), "o_orderpriority", "o_orderkey").select("o_orderkey", "training_fold")
    rows = _split_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "split").join(folds, "o_orderkey", "left")
    return requests.manifest_integrity(rows, "o_orderkey", "split", "o_custkey", "training_fold")


@query("manifest_coverage", "SELECT 'table_only' AS side, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'manifest_only', o_orderkey + 1000000000 FROM orders WHERE o_orderstatus = 'F'")
def manifest_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    moved = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 1000000000).otherwise(F.col("o_orderkey"))
    manifest = o.filter("o_orderstatus <> 'P'").select(moved.alias("o_orderkey"))
    kept = o.filter("o_orderstatus <> 'F'")
    return requests.manifest_coverage(manifest, kept, "o_orderkey")


@query("prediction_set_check", "SELECT count(*) AS rows, count(*) FILTER (WHERE l_discount = 0) AS non_finite, false AS valid FROM lineitem")
def prediction_set_check(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("p"))
    return requests.prediction_set_check(rows, "p", 1)


LABELS = ("F", "O", "P", "X")
GUESS = """g AS (SELECT o_orderpriority AS k, o_orderstatus AS a, CASE WHEN o_totalprice > 300000 THEN 'O' WHEN o_totalprice > 200000 THEN 'F' WHEN day(o_orderdate) < 20 THEN 'P' ELSE o_orderstatus END AS p FROM orders)"""


def _guesses(spark, sf_dir):
    price = F.col("o_totalprice")
    guess = F.when(price > 300000, "O").when(price > 200000, "F").when(F.dayofmonth("o_orderdate") < 20, "P").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("a"), guess.alias("p")
    )


PER_CLASS = f"""{GUESS}, l AS (SELECT unnest(['F', 'O', 'P', 'X']) AS label),
  c AS (SELECT label, (SELECT count(*) FROM g WHERE a = label) AS support, (SELECT count(*) FROM g WHERE p = label) AS predicted_count, (SELECT count(*) FROM g WHERE a = label AND p = label) AS hits FROM l),
  m AS (SELECT *, CASE WHEN predicted_count = 0 THEN 0 ELSE hits / predicted_count END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
    CASE WHEN support + predicted_count = 0 THEN 0 ELSE 2.0 * hits / (support + predicted_count) END AS f1 FROM c)"""


@query("per_class_scores", f"WITH {PER_CLASS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted_count, hits FROM m")
def per_class_scores(spark, sf_dir):
    return rounded(metrics.per_class_metrics(metrics.confusion(_guesses(spark, sf_dir), "a", "p"), LABELS), 6)


@query("confusion_counts", f"WITH {GUESS} SELECT k, a AS actual, p AS predicted, count(*) AS count FROM g GROUP BY 1, 2, 3")
def confusion_counts(spark, sf_dir):
    return metrics.confusion(_guesses(spark, sf_dir), "a", "p", ["k"])


@query(
    "classification_scores",
    f"""WITH {PER_CLASS} SELECT (SELECT count(*) FROM g) AS rows, round((SELECT avg((a = p)::INT) FROM g), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(precision), 6) AS macro_precision,
        round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) FILTER (WHERE predicted_count > 0) AS predicted_class_count FROM m""",
)
def classification_scores(spark, sf_dir):
    return rounded(metrics.classification_metrics(_guesses(spark, sf_dir), "a", "p", LABELS), 6)


@query(
    "classification_scores_by_group",
    f"""WITH {GUESS} SELECT k, count(*) AS rows, round(avg((a = p)::INT), 6) AS accuracy FROM g GROUP BY 1""",
)
def classification_scores_by_group(spark, sf_dir):
    scored = metrics.classification_metrics(_guesses(spark, sf_dir), "a", "p", LABELS, ["k"])
    return rounded(scored.select("k", "rows", "accuracy"), 6)


REGRESSION_SQL = """count(*) AS rows, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2,
  round(median(abs(a - p)), 4) AS median_absolute_error, round(avg(a - p), 4) AS mean_residual, round(stddev_samp(a - p), 4) AS residual_standard_deviation, round(min(p), 4) AS minimum_prediction,
  round(max(p), 4) AS maximum_prediction, count(*) FILTER (WHERE p < 0) AS negative_prediction_count"""


def regression_rounded(df):
    """Errors to four places, R² to six."""
    return df.select(
        *[F.round(F.col(c), 6 if c == "r2" else 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


PREDICTED = "x AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS a, l_quantity * 2000 - 500 * l_linenumber AS p FROM lineitem)"


def _predicted(spark, sf_dir):
    guess = F.col("l_quantity") * 2000 - 500 * F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("a"), guess.alias("p"))


@query("regression_scores", f"WITH {PREDICTED} SELECT {REGRESSION_SQL} FROM x")
def regression_scores(spark, sf_dir):
    return regression_rounded(metrics.regression_metrics(_predicted(spark, sf_dir), "a", "p"))


@query("regression_scores_by_group", f"WITH {PREDICTED} SELECT l_returnflag, l_linestatus, {REGRESSION_SQL} FROM x GROUP BY 1, 2")
def regression_scores_by_group(spark, sf_dir):
    return regression_rounded(metrics.regression_metrics(_predicted(spark, sf_dir), "a", "p", ["l_returnflag", "l_linestatus"]))


@query("category_prediction_means", f"WITH {PREDICTED} SELECT l_returnflag, count(*) AS rows, round(avg(a), 4) AS actual_mean, round(avg(p), 4) AS prediction_mean FROM x GROUP BY 1")
def category_prediction_means(spark, sf_dir):
    return rounded(metrics.category_means(_predicted(spark, sf_dir), ["l_returnflag"], "a", "p"))


# A metrics table from the data: one "task" per ship status and flag, one candidate per line number.
TRIALS = """x AS (SELECT l_returnflag AS task, l_linenumber, l_extendedprice AS a, CASE WHEN l_linenumber = 1 THEN 36000.0 WHEN l_linenumber = 2 THEN 30000.0 ELSE l_quantity * (1000 + 100 * l_linenumber) END AS p FROM lineitem),
  m AS (SELECT task, l_linenumber::VARCHAR AS candidate, l_linenumber <= 2 AS is_baseline, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2 FROM x GROUP BY 1, l_linenumber),
  b AS (SELECT task, min(mae) AS bm, min(rmse) AS br FROM m WHERE is_baseline GROUP BY 1),
  gate AS (SELECT m.*, (bm - mae) / bm AS mae_improvement, (br - rmse) / br AS rmse_improvement FROM m JOIN b USING (task) WHERE NOT is_baseline)"""


def _trials(spark, sf_dir):
    line = F.col("l_linenumber")
    guess = F.when(line == 1, 36000.0).when(line == 2, 30000.0).otherwise(F.col("l_quantity") * (1000 + 100 * line))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("task"), line.cast("string").alias("candidate"), F.col("l_extendedprice").alias("a"), guess.alias("p")
    )
    return metrics.regression_metrics(rows, "a", "p", ["task", "candidate"], few_keys=True).withColumn("is_baseline", F.col("candidate").isin("1", "2"))


@query(
    "regression_acceptance",
    f"""WITH {TRIALS} SELECT task, candidate, round(mae_improvement, 6) AS mae_improvement, round(rmse_improvement, 6) AS rmse_improvement, r2 > 0 AND mae_improvement >= 0.01 AND rmse_improvement >= 0.01 AS beats_baseline FROM gate""",
)
def regression_acceptance(spark, sf_dir):
    gate = metrics.regression_gate(_trials(spark, sf_dir), ["task"])
    return rounded(gate.select("task", "candidate", "mae_improvement", "rmse_improvement", "beats_baseline"), 6)


@query(
    "candidate_selection",
    f"""WITH {TRIALS}, ok AS (SELECT *, r2 > 0 AND mae_improvement >= 0.01 AND rmse_improvement >= 0.01 AS pass FROM gate),
        best AS (SELECT task, candidate AS c FROM ok QUALIFY row_number() OVER (PARTITION BY task ORDER BY mae, rmse, candidate) = 1),
        chosen AS (SELECT task, candidate AS s FROM ok WHERE pass QUALIFY row_number() OVER (PARTITION BY task ORDER BY mae, rmse, candidate) = 1)
        SELECT task, c AS best_research_configuration, s AS selected, CASE WHEN s IS NULL THEN 'NO_CONFIGURATION_PASSED' ELSE 'GATE_PASSED' END AS selection_status FROM best LEFT JOIN chosen USING (task)""",
)
def candidate_selection(spark, sf_dir):
    gate = metrics.regression_gate(_trials(spark, sf_dir), ["task"])
    return metrics.selected(gate, ["task"], [F.col("mae"), F.col("rmse")], F.col("beats_baseline"), "candidate")


@query(
    "near_tied_candidates",
    f"""WITH {TRIALS}, t AS (SELECT task, max(r2) AS best FROM m GROUP BY 1) SELECT task, candidate, round(r2, 6) AS r2 FROM m JOIN t USING (task) WHERE r2 >= best - 0.5""",
)
def near_tied_candidates(spark, sf_dir):
    return rounded(metrics.near_ties(_trials(spark, sf_dir), ["task"], "r2", 0.5).select("task", "candidate", "r2"), 6)


@query(
    "grouped_acceptance",
    f"""WITH {TRIALS}, f AS (SELECT task, l_linenumber::VARCHAR AS candidate, l_linenumber AS fold, avg(abs(a - p)) AS mae FROM x GROUP BY 1, 2, 3)
        SELECT task, candidate, CASE WHEN (SELECT count(*) FROM x y WHERE y.task = gate.task AND y.l_linenumber::VARCHAR = gate.candidate AND p < 0) > 0 THEN 'FAILED'
          WHEN mae_improvement >= 0.05 AND rmse_improvement >= 0.05 AND r2 > 0 AND candidate <> '7' THEN 'BEATS_BASELINE' WHEN mae_improvement > 0 AND rmse_improvement > 0 AND r2 > 0 THEN 'MARGINALLY_BEATS_BASELINE'
          WHEN candidate = '7' AND r2 > 0 THEN 'UNSTABLE' ELSE 'DOES_NOT_BEAT_BASELINE' END AS status FROM gate""",
)
def grouped_acceptance(spark, sf_dir):
    trials = _trials(spark, sf_dir).withColumns({"fold_mae_cv": F.lit(0.1), "all_fold_r2_positive": F.col("candidate") != "7"})
    return metrics.grouped_gate(trials, ["task"]).select("task", "candidate", "status")


@query(
    "fold_stability",
    """WITH x AS (SELECT l_returnflag, l_linenumber, l_extendedprice AS a, l_quantity * 2000 AS p FROM lineitem), f AS (SELECT l_returnflag, l_linenumber, avg(abs(a - p)) AS mae, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2 FROM x GROUP BY 1, 2)
       SELECT l_returnflag, round(avg(mae), 4) AS fold_mae_mean, round(stddev_samp(mae), 4) AS fold_mae_standard_deviation, round(stddev_samp(mae) / avg(mae), 4) AS fold_mae_cv, round(avg(r2), 4) AS fold_r2_mean,
         round(stddev_samp(r2), 4) AS fold_r2_standard_deviation, bool_and(r2 > 0) AS all_fold_r2_positive FROM f GROUP BY 1""",
)
def fold_stability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linenumber", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 2000).alias("p")
    )
    folds = metrics.regression_metrics(rows, "a", "p", ["l_returnflag", "l_linenumber"])
    return rounded(metrics.fold_stability(folds, ["l_returnflag"]))

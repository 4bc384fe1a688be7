"""Model, scoring, source and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from herdspark.functions import text
from herdspark.operators import joins, mapping, metrics, rules, splits
from herdspark.operators import modeling as m
from herdspark.operators.contracts import FieldContract, ModelContract, TableContract

from herdspark.plans import experiments
from herdspark.plans.profile_queries import PRIORITIES
from herdspark.plans.registry import query, table
from herdspark.plans.rule_queries import gated
from herdspark.plans.split_queries import REGRESSION_SQL, regression_rounded
from herdspark.plans.summary_queries import rounded
from herdspark.session import checkpoint_root, cut_lineage
from herdspark.sources import sinks, tables
from herdspark.streaming import ledger as stock
from herdspark.streaming import snapshot

FACTS = """facts AS (SELECT l_orderkey AS id, round(sum(l_extendedprice), 2) AS price, sum(l_quantity) AS quantity, count(*)::DOUBLE AS lines, max(l_returnflag) AS flag,
    CASE WHEN count(*) > 1 THEN round(avg(l_discount), 6) END AS discount FROM lineitem GROUP BY 1),
  rows AS (SELECT f.*, o_custkey AS customer, o_orderpriority AS priority, o_orderstatus AS status FROM facts f JOIN orders ON id = o_orderkey),
  k AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY md5('42|' || id::VARCHAR), id) AS k, count(*) OVER (PARTITION BY priority) AS n FROM rows),
  tagged AS (SELECT * EXCLUDE (k, n), CASE WHEN k <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split FROM k)"""


def order_facts(spark, sf_dir):
    """One row per order: totals of its lines beside the order's categories."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.sum("l_quantity").alias("quantity"),
        F.count(F.lit(1)).cast("double").alias("lines"), F.max("l_returnflag").alias("flag"),
        F.when(F.count(F.lit(1)) > 1, F.round(F.avg("l_discount"), 6)).alias("discount"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )
    return lines.join(orders, "id")


def dealt(rows):
    """A training table in as many parts as the session's shuffles have.

    Many passes go over it, and the seeds of tree ensembles follow its parts, so
    their number is a setting and does not follow the size of the table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "id").sortWithinPartitions("id")


def tagged_facts(spark, sf_dir):
    """The order facts with their split, materialised once for the fits that follow."""
    rows = cut_lineage(order_facts(spark, sf_dir))
    manifest = splits.split_assignments(rows, "priority", "id").select("id", "split")
    return cut_lineage(dealt(rows.join(manifest, "id")))


def _part(rows, name):
    return rows.filter(F.col("split") == name)


ALL = m.Features(("priority", "status"), ("quantity", "lines", "discount"), ("discount",), scaled=True)
ONE = m.Features(numbers=("quantity",))
LINEAR = m.Candidate("linear", "linear", linear=True)
SLOPE = "regr_slope(price, quantity) AS b, regr_intercept(price, quantity) AS a0"


@query(
    "linear_candidate",
    f"WITH {FACTS}, f AS (SELECT {SLOPE} FROM tagged WHERE split = 'train'), x AS (SELECT price AS a, a0 + b * quantity AS p FROM tagged, f WHERE split = 'validation') SELECT {REGRESSION_SQL} FROM x",
)
def linear_candidate(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    fitted = m.fit_candidate(_part(rows, "train"), ONE, "price", LINEAR)
    return regression_rounded(metrics.regression_metrics(fitted.predict(_part(rows, "validation")), "price", "prediction"))


@query(
    "ridge_candidate",
    f"""WITH {FACTS}, s AS (SELECT avg(price) AS my, avg(quantity) AS mx, regr_sxy(price, quantity) AS sxy, regr_sxx(price, quantity) AS sxx FROM tagged WHERE split = 'train'),
        x AS (SELECT price AS a, my + (quantity - mx) * sxy / (sxx + 100000) AS p FROM tagged, s WHERE split = 'validation') SELECT {REGRESSION_SQL} FROM x""",
)
def ridge_candidate(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    ridge = m.Candidate("ridge", "ridge", {"alpha": 100000.0}, linear=True)
    fitted = m.fit_candidate(_part(rows, "train"), ONE, "price", ridge)
    return regression_rounded(metrics.regression_metrics(fitted.predict(_part(rows, "validation")), "price", "prediction"))


@query(
    "dummy_regressors",
    f"""WITH {FACTS}, f AS (SELECT avg(price) AS mean, median(price) AS med FROM tagged WHERE split = 'train'), x AS (SELECT 'd_dummy_mean' AS configuration_id, price AS a, mean AS p FROM tagged, f WHERE split = 'validation'
        UNION ALL SELECT 'd_dummy_median', price, med FROM tagged, f WHERE split = 'validation') SELECT configuration_id, {REGRESSION_SQL} FROM x GROUP BY 1""",
)
def dummy_regressors(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    found, _ = m.evaluate_candidates(_part(rows, "train"), _part(rows, "validation"), ONE, "price", m.regression_candidates("d")[:2], "id")
    return regression_rounded(found.drop("algorithm", "baseline", "is_baseline", "training_seconds"))


SCORES_SQL = """count(*) AS rows, round(avg((a = p)::INT), 6) AS accuracy"""


@query(
    "dummy_classifiers",
    f"""WITH {FACTS}, c AS (SELECT flag, count(*) AS n FROM tagged WHERE split = 'train' GROUP BY 1),
        o AS (SELECT flag, n, sum(n) OVER (ORDER BY n DESC, flag) / sum(n) OVER () AS upto, row_number() OVER (ORDER BY n DESC, flag) AS r FROM c),
        u AS (SELECT id, flag AS a, ('0x' || substr(md5('42|' || id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM tagged WHERE split = 'validation'),
        x AS (SELECT 'f_dummy_most_frequent' AS configuration_id, a, (SELECT flag FROM o WHERE r = 1) AS p FROM u UNION ALL SELECT 'f_dummy_stratified', a, (SELECT min_by(flag, r) FROM o WHERE u.u < upto) FROM u)
        SELECT configuration_id, {SCORES_SQL} FROM x GROUP BY 1""",
)
def dummy_classifiers(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    found, _ = m.evaluate_candidates(
        _part(rows, "train"), _part(rows, "validation"), ALL, "flag", m.classifier_candidates("f")[:2], "id", ["A", "N", "R"]
    )
    return rounded(found.select("configuration_id", "rows", "accuracy"), 6)


@query("regression_candidates")
def regression_candidates(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    found, _ = m.evaluate_candidates(_part(rows, "train"), _part(rows, "validation"), ALL, "price", m.regression_candidates("price"), "id")
    return found


@query("classification_candidates")
def classification_candidates(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    found, _ = m.evaluate_candidates(
        _part(rows, "train"), _part(rows, "validation"), ALL, "flag", m.classifier_candidates("flag"), "id", ["A", "N", "R"]
    )
    return found


def _folded(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    folds = splits.training_folds(rows, "priority", "id").select("id", "training_fold")
    return cut_lineage(dealt(_part(rows, "train").join(folds, "id")))


FOLDED = f"""{FACTS}, folded AS (SELECT *, ((row_number() OVER (PARTITION BY priority ORDER BY md5('42-fold|' || id::VARCHAR), id) - 1) % 5 + 1)::INTEGER AS training_fold FROM tagged WHERE split = 'train'),
  sums AS (SELECT training_fold AS f, count(*) AS n, sum(price) AS sy, sum(quantity) AS sx, sum(price * quantity) AS sxy, sum(quantity * quantity) AS sxx FROM folded GROUP BY 1),
  others AS (SELECT a.f, sum(b.n) AS n, sum(b.sy) AS sy, sum(b.sx) AS sx, sum(b.sxy) AS sxy, sum(b.sxx) AS sxx FROM sums a JOIN sums b ON a.f <> b.f GROUP BY 1),
  fits AS (SELECT f, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS a0 FROM others)"""


@query("cross_fitted_predictions", f"WITH {FOLDED} SELECT id, training_fold, round(a0 + b * quantity, 2) AS prediction FROM folded JOIN fits ON f = training_fold")
def cross_fitted_predictions(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    return rounded(m.cross_fitted(rows, ONE, "price", LINEAR, "id", "training_fold", 5), 2)


@query(
    "cross_fit_audit",
    f"""WITH {FOLDED} SELECT training_fold, (SELECT count(*) FROM folded o WHERE o.training_fold <> f.training_fold) AS fit_rows, count(*) AS heldout_rows, count(*) AS predicted_rows, count(DISTINCT id) AS distinct_rows,
        (SELECT count(*) FROM folded a JOIN folded b USING (id) WHERE a.training_fold = f.training_fold AND b.training_fold <> f.training_fold) AS heldout_rows_in_fit FROM folded f GROUP BY 1""",
)
def cross_fit_audit(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    fits = []
    predictions = m.cross_fitted(rows, ONE, "price", LINEAR, "id", "training_fold", 5, fits=fits)
    return m.fold_audit(rows, predictions, fits, "id", "training_fold")


CUSTOMER_GROUPS = f"""{FACTS}, g AS (SELECT customer, count(*) AS rows FROM rows GROUP BY 1),
  h AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || customer::VARCHAR), customer) AS k, count(*) OVER () AS n FROM g),
  d AS (SELECT *, row_number() OVER (ORDER BY rows DESC, k) - 1 AS pos FROM h WHERE k > ceil(n * 0.2::DOUBLE)),
  dev AS (SELECT r.*, CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 + 1 ELSE 5 - pos % 5 END::INTEGER AS f FROM rows r JOIN d USING (customer)),
  held AS (SELECT r.* FROM rows r JOIN h USING (customer) WHERE k <= ceil(n * 0.2::DOUBLE))"""


def _grouped(spark, sf_dir):
    rows = cut_lineage(order_facts(spark, sf_dir))
    return cut_lineage(dealt(splits.apply_groups(rows, splits.group_assignments(rows, "customer"), "customer")))


@query(
    "grouped_cross_validation",
    f"""WITH {CUSTOMER_GROUPS}, m AS (SELECT a.f, avg(b.price) AS mean, median(b.price) AS med, regr_slope(b.price, b.quantity) AS s, regr_intercept(b.price, b.quantity) AS i FROM (SELECT DISTINCT f FROM dev) a JOIN dev b ON a.f <> b.f GROUP BY 1),
        x AS (SELECT unnest(['d_dummy_mean', 'd_dummy_median', 'linear']) AS configuration_id, dev.f, price AS a, unnest([mean, med, i + s * quantity]) AS p FROM dev JOIN m USING (f)),
        folds AS (SELECT configuration_id, f, avg(abs(a - p)) AS mae, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2 FROM x GROUP BY 1, 2),
        st AS (SELECT configuration_id, round(avg(mae), 3) AS fold_mae_mean, round(stddev_samp(mae), 3) AS fold_mae_standard_deviation, bool_and(r2 > 0) AS all_fold_r2_positive FROM folds GROUP BY 1),
        po AS (SELECT configuration_id, count(*) AS rows, round(avg(abs(a - p)), 3) AS mae, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 5) AS r2 FROM x GROUP BY 1)
        SELECT configuration_id, rows, mae, r2, fold_mae_mean, fold_mae_standard_deviation, all_fold_r2_positive FROM po JOIN st USING (configuration_id)""",
)
def grouped_cross_validation(spark, sf_dir):
    rows = _grouped(spark, sf_dir).filter("partition = 'development'")
    pooled, _ = m.grouped_cross_validation(rows, ONE, "price", [*m.regression_candidates("d")[:2], LINEAR], "id", "customer")
    return pooled.select(
        "configuration_id", "rows", F.round("mae", 3).alias("mae"), F.round("r2", 5).alias("r2"),
        *[F.round(c, 3).alias(c) for c in ("fold_mae_mean", "fold_mae_standard_deviation")], "all_fold_r2_positive",
    )


RIDGES = (0.0, 10.0, 1000.0, 100000.0)


@query(
    "ridge_grid_cross_validation",
    f"""WITH {CUSTOMER_GROUPS}, s AS (SELECT f, count(*) AS n, sum(price) AS sy, sum(quantity) AS sx, sum(price * quantity) AS sxy, sum(quantity * quantity) AS sxx FROM dev GROUP BY 1),
        o AS (SELECT a.f, sum(b.n) AS n, sum(b.sy) AS sy, sum(b.sx) AS sx, sum(b.sxy) AS sxy, sum(b.sxx) AS sxx FROM s a JOIN s b ON a.f <> b.f GROUP BY 1),
        m AS (SELECT f, sy / n AS my, sx / n AS mx, sxy - sx * sy / n AS c, sxx - sx * sx / n AS v FROM o),
        x AS (SELECT 'ridge_' || alpha::BIGINT AS configuration_id, dev.f, price AS a, my + c / (v + alpha) * (quantity - mx) AS p FROM dev JOIN m USING (f), (SELECT unnest({list(RIDGES)})::DOUBLE AS alpha)),
        folds AS (SELECT configuration_id, f, avg(abs(a - p)) AS mae FROM x GROUP BY 1, 2),
        st AS (SELECT configuration_id, round(avg(mae), 3) AS fold_mae_mean, round(stddev_samp(mae), 3) AS fold_mae_standard_deviation FROM folds GROUP BY 1),
        po AS (SELECT configuration_id, count(*) AS rows, round(avg(abs(a - p)), 3) AS mae, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 5) AS r2 FROM x GROUP BY 1)
        SELECT configuration_id, rows, mae, r2, fold_mae_mean, fold_mae_standard_deviation FROM po JOIN st USING (configuration_id)""",
)
def ridge_grid_cross_validation(spark, sf_dir):
    """Four penalties over five folds of customers, from one pass of sums."""
    rows = _grouped(spark, sf_dir).filter("partition = 'development'")
    grid = [m.Candidate(f"ridge_{alpha:.0f}", "ridge", {"alpha": alpha}, linear=True) for alpha in RIDGES]
    pooled, _ = m.grouped_cross_validation(rows, ONE, "price", grid, "id", "customer")
    return pooled.select(
        "configuration_id", "rows", F.round("mae", 3).alias("mae"), F.round("r2", 5).alias("r2"),
        *[F.round(c, 3).alias(c) for c in ("fold_mae_mean", "fold_mae_standard_deviation")],
    )


@query(
    "final_group_holdout",
    f"""WITH {CUSTOMER_GROUPS}, m AS (SELECT avg(price) AS mean, median(price) AS med, regr_slope(price, quantity) AS s, regr_intercept(price, quantity) AS i FROM dev),
        x AS (SELECT price AS a, i + s * quantity AS p, mean, med FROM held, m)
        SELECT 'linear' AS configuration_id, count(*) AS rows, round(avg(abs(a - p)), 3) AS mae, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 5) AS r2,
          round(1 - avg(abs(a - p)) / least(avg(abs(a - mean)), avg(abs(a - med))), 5) AS mae_improvement, 'BEATS_BASELINE' AS decision FROM x""",
)
def final_group_holdout(spark, sf_dir):
    rows = _grouped(spark, sf_dir)
    found = m.final_holdout(
        rows.filter("partition = 'development'"), rows.filter("partition = 'holdout'"), ONE, "price", LINEAR, m.regression_candidates("d")[:2], "id"
    )
    return found.select(
        "configuration_id", "rows", F.round("mae", 3).alias("mae"), F.round("r2", 5).alias("r2"), F.round("mae_improvement", 5).alias("mae_improvement"), "decision"
    )


@query(
    "leave_one_group_out",
    f"""WITH {FACTS}, t AS (SELECT count(*) AS n, sum(price) AS sy, sum(quantity) AS sx, sum(price * quantity) AS sxy, sum(quantity * quantity) AS sxx FROM rows),
        g AS (SELECT customer, count(*) AS n, sum(price) AS sy, sum(quantity) AS sx, sum(price * quantity) AS sxy, sum(quantity * quantity) AS sxx FROM rows GROUP BY 1),
        o AS (SELECT customer, t.n - g.n AS n, t.sy - g.sy AS sy, t.sx - g.sx AS sx, t.sxy - g.sxy AS sxy, t.sxx - g.sxx AS sxx FROM g, t),
        f AS (SELECT customer, (sxy - sx * sy / n) / (sxx - sx * sx / n + 10) AS b, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n + 10) * sx / n AS a0 FROM o)
        SELECT id, customer, price, round(a0 + b * quantity, 2) AS prediction FROM rows JOIN f USING (customer)""",
)
def leave_one_group_out(spark, sf_dir):
    return rounded(m.leave_one_group_out(order_facts(spark, sf_dir), ONE, "price", "customer", "id", 10.0), 2)


@query("leave_one_group_out_scores")
def leave_one_group_out_scores(spark, sf_dir):
    found = m.leave_one_group_out(cut_lineage(order_facts(spark, sf_dir)), ALL, "price", "customer", "id", 1.0)
    return metrics.regression_metrics(found, "price", "prediction", ["customer"])


@query(
    "reloaded_model_check",
    f"WITH {FACTS} SELECT count(*) AS rows, 0.0::DOUBLE AS maximum_difference, true AS identical FROM tagged WHERE split = 'validation'",
)
def reloaded_model_check(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    fitted = m.fit_candidate(_part(rows, "train"), ALL, "price", LINEAR)
    path = f"{_work_folder(spark)}/model"
    return m.reload_check(fitted, _part(rows, "validation"), "id", path)


def _work_folder(spark):
    """A new path below the shared checkpoint folder; Spark makes it when it writes."""
    return f"{checkpoint_root(spark).rstrip('/')}/run-{uuid.uuid4()}"


@query("unknown_category_smoke", f"WITH {FACTS} SELECT count(*) AS rows, 0::BIGINT AS non_finite FROM tagged WHERE split = 'validation'")
def unknown_category_smoke(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    small = splits.stratified_subset(_part(rows, "train"), "priority", "id", 500)
    fitted = m.fit_candidate(small, ALL, "price", m.Candidate("t", "tree", {"depth": 4, "leaf": 5}))
    return m.unknown_category_check(fitted, _part(rows, "validation"), "priority")


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    fitted = m.fit_candidate(_part(rows, "train"), ALL, "price", LINEAR)
    return m.permutation_importance(fitted, _part(rows, "validation"), ALL, "price", "id", repeats=3)


@query("classifier_importance")
def classifier_importance(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    tree = m.Candidate("tree", "tree", {"depth": 4, "leaf": 20})
    fitted = m.fit_candidate(_part(rows, "train"), ALL, "flag", tree, "id", classification=True)
    return m.permutation_importance(fitted, _part(rows, "validation"), ALL, "flag", "id", repeats=3, scoring="macro_f1")


@query("classifier_confidence")
def classifier_confidence(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    tree = m.Candidate("tree", "tree", {"depth": 4, "leaf": 20})
    fitted = m.fit_candidate(_part(rows, "train"), ALL, "flag", tree, "id", classification=True)
    return m.confidence(fitted.predict(_part(rows, "validation")), "flag")


BANDS = ((float("-inf"), 50.0, 100.0, float("inf")), ("<=50", "50-100", ">100"))


@query(
    "subgroup_diagnostics",
    f"""WITH {FACTS}, f AS (SELECT {SLOPE} FROM tagged WHERE split = 'train'), x AS (SELECT priority, status, flag, CASE WHEN quantity <= 50 THEN '<=50' WHEN quantity <= 100 THEN '50-100' ELSE '>100' END AS q, price AS a, a0 + b * quantity AS p FROM tagged, f WHERE split = 'validation'),
        u AS (SELECT unnest(['priority', 'status', 'quantity_range']) AS group_column, unnest([priority, status, q]) AS "group", a, p FROM x UNION ALL SELECT 'flag', flag, a, p FROM x)
        SELECT group_column, "group", count(*) AS rows, round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2 FROM u GROUP BY 1, 2 HAVING count(*) >= 100""",
)
def subgroup_diagnostics(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    fitted = m.fit_candidate(_part(rows, "train"), ONE, "price", LINEAR)
    predicted = fitted.predict(_part(rows, "validation"))
    return regression_rounded(m.diagnostics(predicted, "price", ["priority", "status"], "quantity", BANDS, "flag"))


@query("feature_ablation")
def feature_ablation(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    return experiments.ablation_experiment(_part(rows, "train"), _part(rows, "validation"), ALL, "price", "id", LINEAR, "quantity")


@query("locked_experiment")
def locked_experiment(spark, sf_dir):
    path = f"{_work_folder(spark)}/lock"
    return experiments.regression_experiment(tagged_facts(spark, sf_dir), ALL, "price", "id", m.regression_candidates("price"), path)


@query("label_and_amount_designs")
def label_and_amount_designs(spark, sf_dir):
    rows = tagged_facts(spark, sf_dir)
    folds = splits.training_folds(rows, "priority", "id").select("id", "training_fold")
    rows = cut_lineage(rows.join(folds, "id", "left"))
    chosen = {c.algorithm: c for c in [*m.classifier_candidates("flag"), *m.regression_candidates("price")[2:3]]}
    return experiments.label_and_amount_experiment(rows, ALL, "flag", "price", "id", "training_fold", 5, chosen["forest"], chosen["ridge"])


@query("first_generation_regression")
def first_generation_regression(spark, sf_dir):
    return experiments.first_generation_regression(cut_lineage(order_facts(spark, sf_dir)), "price", "id", ["quantity", "lines", "priority", "customer id"])


@query("first_generation_classification")
def first_generation_classification(spark, sf_dir):
    return experiments.first_generation_classification(cut_lineage(order_facts(spark, sf_dir)), "flag", "id", m.Features(("priority",), ("quantity", "lines")))


@query("joined_grouped_experiment")
def joined_grouped_experiment(spark, sf_dir):
    rows = cut_lineage(order_facts(spark, sf_dir))
    left = rows.select("id", "customer", "price", "quantity")
    return experiments.joined_grouped_experiment(left, rows.select("id", "lines"), ["id"], "customer", "id", ONE, ["lines"], "price", LINEAR)


@query(
    "batch_yield_scores",
    f"""WITH {FACTS}, f AS (SELECT regr_slope(price, quantity) AS b, regr_intercept(price, quantity) AS a0 FROM rows),
        t AS (SELECT id, CASE WHEN status = 'P' THEN NULL ELSE quantity END AS w, priority FROM rows)
        SELECT id, CASE WHEN priority = '5-LOW' THEN 'MISSING: breed' || CASE WHEN w IS NULL THEN ', weightKg' ELSE '' END WHEN w IS NULL THEN 'MISSING: weightKg' END AS input_error,
          CASE WHEN priority <> '5-LOW' AND w IS NOT NULL THEN round(greatest(a0 + b * w, 0), 1) END AS milk_yield FROM t, f""",
)
def batch_yield_scores(spark, sf_dir):
    rows = cut_lineage(order_facts(spark, sf_dir))
    train = rows.select(F.col("quantity").alias("Weight_kg"), "price")
    fitted = m.fit_candidate(train, m.Features(numbers=("Weight_kg",)), "price", LINEAR)
    raw = rows.select(
        "id", F.when(F.col("priority") != "5-LOW", F.col("priority")).alias("breed"), F.lit(30).alias("ageMonths"),
        F.when(F.col("status") != "P", F.col("quantity")).alias("weightKg"), F.lit("Early").alias("lactationStage"),
    )
    scored = m.non_negative_scores(rules.model_inputs(raw, ["id"]), fitted.model, "milk_yield", 1)
    return scored.select("id", "input_error", "milk_yield")


@query("candidate_scores")
def candidate_scores(spark, sf_dir):
    rows = cut_lineage(
        gated(spark, sf_dir).select(
            "l_orderkey", "l_linenumber", "genetic_group", F.col("heat_class").alias("thi_category"),
            "eligibility", "scope", "fallback_reason", "weight", "milk",
        )
    )
    train = rows.filter("eligibility = 'ELIGIBLE' and weight is not null and milk >= 0")
    features = m.Features(("genetic_group", "thi_category"))
    ridge = m.Candidate("ridge", "ridge", {"alpha": 0.1}, linear=True)
    models = {
        "dmi": (m.fit_candidate(train, features, "weight", ridge).model, 0.0, 2000.0),
        "milk": (m.fit_candidate(train, features, "milk", ridge).model, 0.0, 30.0),
    }
    scored = m.candidate_scores(rows.drop("weight", "milk"), models, ["l_orderkey", "l_linenumber"])
    return scored.withColumn("fallback_reasons", F.array_join("fallback_reasons", ","))


DEMO = TableContract(
    fields={
        "breed": FieldContract("breed", "category", True, PRIORITIES),
        "weight_kg": FieldContract("weight_kg", "number", True, minimum=1000, maximum=450000, nonnegative=True),
        "milk_yield_l": FieldContract("milk_yield_l", "number", nonnegative=True),
    },
    models={"yield": ModelContract("yield", ("breed", "weight_kg"), "milk_yield_l")},
    targets=("milk_yield_l",),
    traceability=("source_key",),
)


def _prepared(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_key"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("Breed"),
        F.col("o_totalprice").alias("weightKg"), F.col("o_custkey").cast("double").alias("Milk_Yield_L"),
    )
    return experiments.prepare_dataset(raw, "source_key", "breed", ["yield"], DEMO)


@query(
    "preprocessing_findings",
    """SELECT 'yield' AS model, 'weight_kg' AS field, 'CONTRACT_RANGE_VIOLATION' AS issue_type, count(*) AS affected_count FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 450000 HAVING count(*) > 0
       UNION ALL SELECT 'yield', 'breed', 'CATEGORY_FORMAT_VARIANT', count(*) FROM orders""",
)
def preprocessing_findings(spark, sf_dir):
    return _prepared(spark, sf_dir).findings.select("model", "field", "issue_type", "affected_count")


SPLIT_PRINT = """f AS (SELECT o_orderkey, CASE WHEN k <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split FROM
  (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)),
  p AS (SELECT count(*) AS rows, sum(('0x' || substr(md5(o_orderkey::VARCHAR || '|' || split), 1, 8))::BIGINT)::VARCHAR AS checksum FROM f)"""


@query("preprocessing_determinism", f"WITH {SPLIT_PRINT} SELECT 'first' AS run, rows, checksum FROM p UNION ALL SELECT 'second', rows, checksum FROM p")
def preprocessing_determinism(spark, sf_dir):
    return _prepared(spark, sf_dir).evidence


# --- sources and sinks --------------------------------------------------------


@query(
    "table_fingerprint",
    """SELECT count(*) AS rows, sum(('0x' || substr(md5(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || coalesce(nullif(o_orderstatus, 'P'), '\\N') || '|' || o_orderpriority), 1, 8))::BIGINT)::VARCHAR AS checksum FROM orders""",
)
def table_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"), "o_orderpriority"
    )
    return tables.fingerprint(rows)


@query("loaded_table_facts", "SELECT count(*) AS rows, 2 AS columns, 'parquet' AS format FROM lineitem")
def loaded_table_facts(spark, sf_dir):
    loaded = tables.load_table(spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_quantity"], required=["l_tax"])
    return loaded.facts().select("rows", "columns", "format")


@query("file_inventory")
def file_inventory(spark, sf_dir):
    return tables.file_inventory(spark, sf_dir)


@query("folder_checksum")
def folder_checksum(spark, sf_dir):
    return tables.tree_checksum(tables.file_inventory(spark, sf_dir), sf_dir)


SHEET_ROWS = "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders"


@query("sheet_round_trip", f"SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(price) AS prices, min(price) AS lowest, max(price) AS highest FROM ({SHEET_ROWS})")
def sheet_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    )
    path = sinks.write_report(rows, f"{_work_folder(spark)}/sheet", order=["o_orderkey"])
    sheet = tables.sheet_table(spark, path)
    price = F.col("price").try_cast("double")
    return sheet.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("keys"), F.count(price).alias("prices"),
        F.min(price).alias("lowest"), F.max(price).alias("highest"),
    )


@query(
    "written_manifest",
    f"""WITH {SPLIT_PRINT} SELECT split, count(*) AS rows FROM f GROUP BY 1""",
)
def written_manifest(spark, sf_dir):
    manifest = splits.split_assignments(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
    stored = sinks.write_manifest(manifest, "o_orderkey", f"{_work_folder(spark)}/manifest")
    return stored.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


# --- streams ------------------------------------------------------------------


def event_stream(spark, sf_dir):
    """The event table read as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


@query(
    "live_record_view",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def live_record_view(spark, sf_dir):
    folder = _work_folder(spark)
    changes = event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    running = snapshot.start_live_view(changes, f"{folder}/view", f"{folder}/progress", "user_id", "ts", "event_id")
    running.awaitTermination()
    return snapshot.live_view(spark, f"{folder}/view", "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    "live_records_of_owner",
    """SELECT user_id, event_id, event_type, owner FROM (SELECT *, 'owner' || event_id % 3 AS owner FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
       WHERE event_type <> 'error' AND owner = 'owner1'""",
)
def live_records_of_owner(spark, sf_dir):
    folder = _work_folder(spark)
    changes = event_stream(spark, sf_dir).select(
        "user_id", "event_id", "ts", "event_type", F.concat(F.lit("owner"), (F.col("event_id") % 3).cast("string")).alias("owner"),
        (F.col("event_type") == "error").alias("gone"),
    )
    snapshot.start_live_view(changes, f"{folder}/view", f"{folder}/progress", "user_id", "ts", "event_id").awaitTermination()
    snapshot.compact_live_view(spark, f"{folder}/view", f"{folder}/compact", "user_id", "ts", "event_id")
    found = snapshot.live_view(spark, f"{folder}/compact", "user_id", "ts", "event_id", "owner", "owner1", "gone")
    return found.select("user_id", "event_id", "event_type", "owner")


@query(
    "merged_live_view",
    "SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'",
)
def merged_live_view(spark, sf_dir):
    """Twelve batches out of order, merged within the stream; records end with an error."""
    folder = _work_folder(spark)
    changes = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", (F.col("event_type") == "error").alias("gone"))
    changes.repartition(12, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    view = f"{folder}/view"
    snapshot.start_live_view(stream, view, f"{folder}/progress", "user_id", "ts", "event_id", fan=3, removed="gone").awaitTermination()
    found = snapshot.live_view(spark, view, "user_id", "ts", "event_id", removed="gone")
    return found.select("user_id", "event_id", "ts", "value")


def stock_events(events, *keep):
    """Stock changes from the event table: the sender always saw a round quantity."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "set").when(kind == "view", "decrease").when(kind == "click", "increase").otherwise("restock")
    return events.select(
        F.col("user_id").cast("string").alias("item_id"), F.col("event_id").alias("seq"), op.alias("op"),
        F.when(kind == "signup", F.round(F.col("value") / 50) * 10).otherwise(F.round("value", 2)).alias("amount"),
        F.lit("kg").alias("unit"), (F.round(F.col("value") / 50) * 10).alias("expected_quantity"), F.lit(10.0).alias("threshold"), *keep,
    )


#: One event after the other for all items at once; the stream delivers the table in one batch, so both agree.
LEDGER_SQL = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS item_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, round(value / 50) * 10 AS expected,
    CASE event_type WHEN 'signup' THEN 'set' WHEN 'view' THEN 'decrease' WHEN 'click' THEN 'increase' ELSE 'restock' END AS op, CASE WHEN event_type = 'signup' THEN round(value / 50) * 10 ELSE round(value, 2) END AS amount FROM events),
  s AS (SELECT DISTINCT item_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS status, NULL::VARCHAR AS error, NULL::DOUBLE AS quantity FROM e
    UNION ALL SELECT item_id, k, seq, status, error, CASE WHEN status <> 'updated' THEN q WHEN op = 'set' THEN amount ELSE made END FROM (
      SELECT *, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN op = 'set' OR coalesce(q = expected, false) THEN 'updated' ELSE 'stale' END AS status FROM (
        SELECT *, CASE WHEN op = 'set' THEN CASE WHEN amount IS NULL OR amount NOT BETWEEN 0 AND 1000000 THEN 'STOCK_INVALID' END WHEN q IS NULL THEN 'ITEM_UNKNOWN'
          WHEN op = 'restock' AND coalesce(amount, 0) <= 0 THEN 'AMOUNT_INVALID' WHEN made > 1000000 THEN 'ABOVE_MAXIMUM' END AS error FROM (
          SELECT e.*, s.quantity AS q, floor((CASE op WHEN 'restock' THEN s.quantity + amount WHEN 'decrease' THEN s.quantity * 0.9::DOUBLE ELSE s.quantity * 1.1::DOUBLE END + 2.220446049250313e-16::DOUBLE) * 100 + 0.5) / 100 AS made
          FROM s JOIN e ON e.item_id = s.item_id AND e.k = s.k + 1))))
  SELECT item_id, seq, status, error, quantity, CASE WHEN quantity IS NOT NULL THEN 'kg' END AS unit, 10.0::DOUBLE AS threshold,
    CASE WHEN quantity IS NULL THEN NULL WHEN quantity <= 0 THEN 'Out of Stock' WHEN quantity <= 10 THEN 'Low' WHEN quantity <= 20 THEN 'Medium' ELSE 'High' END AS stock_level FROM s WHERE k > 0"""


@query("stock_ledger", LEDGER_SQL)
def stock_ledger(spark, sf_dir):
    return stock.ledger(stock_events(table(spark, sf_dir, "events")), slice_size=2000)


@query("stock_ledger_stream", LEDGER_SQL)
def stock_ledger_stream(spark, sf_dir):
    folder = _work_folder(spark)
    outcomes = stock.ledger_stream(stock_events(event_stream(spark, sf_dir)))
    running = (
        outcomes.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/out")
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    "ordered_stock_ledger",
    LEDGER_SQL.replace("FROM events)", "FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))").replace("ORDER BY event_id) AS k", "ORDER BY ts, event_id) AS k"),
)
def ordered_stock_ledger(spark, sf_dir):
    """The ledger in the order of event time; the last hour of events still waits for its watermark."""
    folder = _work_folder(spark)
    events = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    outcomes = stock.ordered_ledger_stream(stock_events(events, "ts"), "ts", "1 hour")
    before = spark.conf.get(stock.STATE_STORE[0], None)
    spark.conf.set(*stock.STATE_STORE)
    try:
        running = (
            outcomes.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/out")
            .outputMode("append").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    finally:
        spark.conf.unset(stock.STATE_STORE[0]) if before is None else spark.conf.set(stock.STATE_STORE[0], before)
    return spark.read.parquet(f"{folder}/out")


# --- views and lookups ----------------------------------------------------------


def _observations(spark, sf_dir):
    """Orders under herd column names."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_row_number"), F.col("o_custkey").cast("string").alias("cattle_id"),
        F.col("o_orderpriority").alias("breed"), F.dayofmonth("o_orderdate").alias("age_months"), F.col("o_totalprice").alias("weight_kg"),
        F.col("o_orderstatus").alias("lactation_stage"), (F.col("o_totalprice") / 100).alias("feed_quantity_kg"),
        F.col("o_orderstatus").alias("feed_type"), F.lit(3.0).alias("body_condition_score"), F.lit(50.0).alias("humidity_percent"),
    )


@query(
    "inference_feature_view",
    """SELECT o_orderkey AS source_row_number, o_orderpriority AS breed, day(o_orderdate)::INTEGER AS age_months, o_totalprice AS weight_kg, o_orderstatus AS lactation_stage, NULL::DOUBLE AS days_in_milk,
       NULL::DOUBLE AS previous_week_avg_yield_l, 3.0::DOUBLE AS body_condition_score, NULL::DOUBLE AS ambient_temperature_c, 50.0::DOUBLE AS humidity_percent FROM orders""",
)
def inference_feature_view(spark, sf_dir):
    rows = _observations(spark, sf_dir)
    return mapping.feature_view(rows, "milk_yield_regressor", include_target=False, keys=["source_row_number"]).features


@query(
    "design_views",
    """SELECT o_orderkey AS source_row_number, feed_quantity_kg, design, predicted_feed_type FROM (SELECT o_orderkey, o_totalprice / 100 AS feed_quantity_kg, unnest(['A', 'B']) AS design,
       unnest([NULL, CASE WHEN o_totalprice > 200000 THEN 'Hay' ELSE 'Silage' END]) AS predicted_feed_type FROM orders)""",
)
def design_views(spark, sf_dir):
    full = {n: F.lit(1.0) for n in ("days_in_milk", "previous_week_avg_yield_l", "ambient_temperature_c")}
    rows = _observations(spark, sf_dir).withColumns(full)
    label = F.when(F.col("weight_kg") > 200000, "Hay").otherwise("Silage")
    predicted = rows.select("source_row_number", label.alias("predicted_feed_type"))
    given = mapping.attach_prediction(rows, predicted, "source_row_number", "predicted_feed_type")
    plain, labelled = mapping.design_views(given, ["source_row_number"])
    columns = ["source_row_number", "feed_quantity_kg"]
    return plain.features.select(*columns, F.lit("A").alias("design"), F.lit(None).cast("string").alias("predicted_feed_type")).unionByName(
        labelled.features.select(*columns, F.lit("B").alias("design"), "predicted_feed_type")
    )


@query(
    "rule_selected_features",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
)
def rule_selected_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "part_id").withColumnRenamed("l_shipdate", "ship_date")
    names = mapping.select_features(rows, "l_extendedprice", ["l_quantity", "part_id", "ship_date", "l_returnflag", "l_tax"], leakage=["L_TAX"])
    categories, numbers = mapping.split_feature_types(rows, names)
    return rows.select("l_orderkey", "l_linenumber", *numbers, *categories)


@query(
    "canonical_key_audit",
    """WITH l AS (SELECT l_orderkey::VARCHAR AS a, CASE l_returnflag WHEN 'A' THEN 'T0' WHEN 'N' THEN 'T1' ELSE 'T2' END AS b, l_linenumber::VARCHAR AS c FROM lineitem),
       r AS (SELECT o_orderkey::VARCHAR AS a, 'T1' AS b, '1' AS c FROM orders),
       lk AS (SELECT a, b, c, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT count(*) AS n FROM lk JOIN r USING (a, b, c))
       SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM lk) AS left_unique_keys, (SELECT count(*) FROM r) AS right_unique_keys, n AS matches, (SELECT count(*) FROM lk) - n AS left_only_keys FROM m""",
)
def canonical_key_audit(spark, sf_dir):
    flag = F.col("l_returnflag")
    label = F.when(flag == "A", "t0 (≤75)").when(flag == "N", " T1 (75-80)").otherwise("T2")
    left = {"k": text.composite_key(F.col("l_orderkey").cast("double"), label, F.col("l_linenumber"))}
    right = {"k": text.composite_key(F.col("o_orderkey"), F.lit("T1"), F.lit(" 1 "))}
    found = joins.composite_join_audit(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), left, right)
    return found.select("left_rows", "left_unique_keys", "right_unique_keys", "matches", "left_only_keys")


@query(
    "manifest_partition",
    f"""WITH {SPLIT_PRINT} SELECT o_orderkey, o_totalprice FROM orders JOIN f USING (o_orderkey) WHERE split = 'validation'""",
)
def manifest_partition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    manifest = splits.split_assignments(orders, "o_orderpriority", "o_orderkey")
    return joins.manifest_partition(orders, manifest, "o_orderkey", "split", "validation").select("o_orderkey", "o_totalprice")


@query("fold_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, length(p_name)::INTEGER AS fold FROM lineitem JOIN part ON l_partkey = p_partkey")
def fold_lookup(spark, sf_dir):
    folds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.length("p_name").cast("int").alias("fold"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.attach_fold(rows, folds, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "fold")

"""Classification and regression metrics, acceptance gates and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdspark.operators.summary import null_safe_join, one_group, quantiles_from_counts, value_counts

REGRESSION_METRICS = (
    "mae", "rmse", "r2", "median_absolute_error", "mean_residual", "residual_standard_deviation",
    "minimum_prediction", "maximum_prediction", "negative_prediction_count",
)


def confusion(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per (actual, predicted); all other metrics come from these rows."""
    return df.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count")
    )


def per_class_metrics(counts: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support and predicted count per label.

    Every listed label appears, also when it never occurs; divisions by zero
    give 0. The labels are spread by an array, so no grid is joined.
    """
    keys = list(keys)
    n = F.col("count")
    cells = F.array(
        F.struct(F.col("actual").alias("label"), n.alias("support"), F.lit(0).alias("predicted_count"),
                 F.when(F.col("actual") == F.col("predicted"), n).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), n.alias("predicted_count"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    spread = counts.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    listed = counts.select(*keys).distinct() if keys else counts.agg(F.count(F.lit(1)).alias("__n")).select()
    listed = listed.select(*keys, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")).select(
        *keys, "label", *[F.lit(0).cast("bigint").alias(c) for c in ("support", "predicted_count", "hits")]
    )
    sums = spread.unionByName(listed).filter(F.col("label").isin(*labels)).groupBy(*keys, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted_count", "hits")]
    )
    hits = F.col("hits")
    precision = F.coalesce(F.try_divide(hits, F.col("predicted_count")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hits, F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(hits * 2.0, F.col("predicted_count") + F.col("support")), F.lit(0.0))
    return sums.select(
        *keys, "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "predicted_count", "hits"
    )


def classification_metrics(
    df: DataFrame, actual: str, predicted: str, labels: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores in one row per key."""
    keys = list(keys)
    counts = confusion(df, actual, predicted, keys)
    classes = per_class_metrics(counts, labels, keys)
    seen = F.col("support") > 0
    rows = counts.groupBy(*keys).agg(
        F.sum("count").alias("rows"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("__right"),
    )
    scores = classes.groupBy(*keys).agg(
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.count_if(F.col("predicted_count") > 0).alias("predicted_class_count"),
    )
    if keys:
        joined = null_safe_join(rows, scores, keys)
    else:
        joined = rows.withColumn("__s", scores.select(F.struct(*scores.columns)).scalar()).select("*", "__s.*").drop("__s")
    return joined.select(
        *keys, "rows", (F.col("__right") / F.col("rows")).alias("accuracy"), "balanced_accuracy", "macro_precision",
        "macro_recall", "macro_f1", "weighted_f1", "predicted_class_count",
    )


def _residuals(df: DataFrame, actual: str, predicted: str, by: Sequence[str]) -> DataFrame:
    return df.select(
        *by, F.col(actual).cast("double").alias("__a"), F.col(predicted).cast("double").alias("__p")
    ).withColumn("__e", F.col("__a") - F.col("__p"))


def regression_sums(df: DataFrame, actual: str, predicted: str, keys: Sequence[str]) -> DataFrame:
    """K12 but for the median error: what one pass of sums over the rows tells per key."""
    a, p, e = F.col("__a"), F.col("__p"), F.col("__e")
    sums = _residuals(df, actual, predicted, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        # Population variance is computed around a running mean, not from raw squares.
        F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(F.lit(1))).alias("__unexplained"),
        F.sum(e * e).alias("__sse"),
        F.avg(e).alias("mean_residual"),
        F.stddev_samp(e).alias("residual_standard_deviation"),
        F.min(p).alias("minimum_prediction"),
        F.max(p).alias("maximum_prediction"),
        F.count_if(p < 0).alias("negative_prediction_count"),
    )
    constant = F.when(F.col("__sse") == 0, 1.0).otherwise(0.0)
    return sums.withColumn("r2", F.coalesce(F.lit(1.0) - F.col("__unexplained"), constant))


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (), few_keys: bool = False
) -> DataFrame:
    """Errors and residuals per key, or over all rows.

    The spread of the target is summed around each key's own mean, found in a
    first pass, so large offsets do not cost precision. ``few_keys`` is that of
    ``quantiles_from_counts``.
    """
    keys = list(keys)
    rows = df if keys else one_group(df)
    by = keys or ["__all"]
    sums = regression_sums(rows, actual, predicted, by)
    # Nearly every error is distinct, so errors are not counted by value first.
    errors = _residuals(rows, actual, predicted, by).select(*by, F.abs("__e").alias("value"), F.lit(1).cast("bigint").alias("n"))
    median = quantiles_from_counts(errors, by, (0.5,), few_keys=few_keys or not keys).withColumnRenamed("p50", "median_absolute_error")
    return null_safe_join(sums, median, by).select(*keys, "rows", *REGRESSION_METRICS)


def improvements(baselines: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with their relative gain over the best baseline of the same keys."""
    best = baselines.groupBy(*keys).agg(F.min("mae").alias("__mae"), F.min("rmse").alias("__rmse"))
    return candidates.join(best, list(keys)).withColumns(
        {
            "mae_improvement": F.try_divide(F.col("__mae") - F.col("mae"), F.col("__mae")),
            "rmse_improvement": F.try_divide(F.col("__rmse") - F.col("rmse"), F.col("__rmse")),
        }
    ).drop("__mae", "__rmse")


def regression_gate(metrics: DataFrame, keys: Sequence[str], minimum: float = 0.01) -> DataFrame:
    """Does a candidate beat the best baseline by ``minimum`` on MAE and RMSE with R² > 0?"""
    scored = improvements(metrics.filter("is_baseline"), metrics.filter("not is_baseline"), keys)
    passed = (F.col("r2") > 0) & (F.col("mae_improvement") >= minimum) & (F.col("rmse_improvement") >= minimum)
    return scored.withColumn("beats_baseline", F.coalesce(passed, F.lit(False)))


def classification_gate(metrics: DataFrame, keys: Sequence[str], minimum: float = 0.01) -> DataFrame:
    """Macro-F1 gain and balanced accuracy over the drawn baseline, accuracy over the most frequent."""
    drawn = metrics.filter("baseline = 'stratified'").select(
        *keys, F.col("macro_f1").alias("__f1"), F.col("balanced_accuracy").alias("__ba")
    )
    frequent = metrics.filter("baseline = 'most_frequent'").select(*keys, F.col("accuracy").alias("__acc"))
    rows = metrics.filter("baseline is null").join(drawn, list(keys)).join(frequent, list(keys))
    passed = (
        (F.col("macro_f1") >= F.col("__f1") + minimum)
        & (F.col("balanced_accuracy") > F.col("__ba"))
        & (F.col("accuracy") > F.col("__acc"))
        & (F.col("predicted_class_count") > 1)
    )
    return rows.withColumn("beats_baseline", F.coalesce(passed, F.lit(False))).drop("__f1", "__ba", "__acc")


def grouped_gate(metrics: DataFrame, keys: Sequence[str], minimum: float = 0.05, maximum_cv: float = 0.35) -> DataFrame:
    """The status of grouped cross-validation candidates.

    Needs fold_mae_cv and all_fold_r2_positive beside the pooled metrics.
    """
    scored = improvements(metrics.filter("is_baseline"), metrics.filter("not is_baseline"), keys)
    stable = F.coalesce((F.col("fold_mae_cv") <= maximum_cv) & F.col("all_fold_r2_positive"), F.lit(False))
    finite = F.lit(True)
    for name in ("mae", "rmse", "r2", "median_absolute_error", "mean_residual"):
        finite = finite & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))
    gain_mae, gain_rmse, r2 = F.col("mae_improvement"), F.col("rmse_improvement"), F.col("r2")
    status = (
        F.when(~finite | (F.col("negative_prediction_count") > 0), "FAILED")
        .when((gain_mae >= minimum) & (gain_rmse >= minimum) & (r2 > 0) & stable, "BEATS_BASELINE")
        .when((gain_mae > 0) & (gain_rmse > 0) & (r2 > 0), "MARGINALLY_BEATS_BASELINE")
        .when(~stable & (r2 > 0), "UNSTABLE")
        .otherwise("DOES_NOT_BEAT_BASELINE")
    )
    return scored.withColumns({"stable": stable, "status": status})


def design_gain(plain: Column, with_label: Column, error: float = 0.01, r2: float = 0.01) -> Column:
    """Is the design with the predicted label worth having? Both are metric structs."""
    mae = F.try_divide(plain["mae"] - with_label["mae"], plain["mae"])
    rmse = F.try_divide(plain["rmse"] - with_label["rmse"], plain["rmse"])
    return F.coalesce((mae >= error) & (rmse >= error) & (with_label["r2"] - plain["r2"] >= r2), F.lit(False))


def selected(
    metrics: DataFrame, keys: Sequence[str], order: Sequence[Column], passing: Column, identity: str
) -> DataFrame:
    """The first passing candidate per key in lexicographic metric order.

    Keys where none passes keep a row with a null choice and the best research
    configuration.
    """
    ranking = Window.partitionBy(*keys).orderBy(*order, F.col(identity))
    rows = metrics.withColumn("__pass", F.coalesce(passing, F.lit(False)))
    best = rows.withColumn("__rn", F.row_number().over(ranking)).filter("__rn = 1").select(
        *keys, F.col(identity).alias("best_research_configuration")
    )
    chosen = rows.filter("__pass").withColumn("__rn", F.row_number().over(ranking)).filter("__rn = 1").select(
        *keys, F.col(identity).alias("selected")
    )
    return best.join(chosen, list(keys), "left").withColumn(
        "selection_status", F.when(F.col("selected").isNull(), "NO_CONFIGURATION_PASSED").otherwise("GATE_PASSED")
    )


def near_ties(metrics: DataFrame, keys: Sequence[str], score: str, width: float = 0.002) -> DataFrame:
    """Candidates within ``width`` of the best score of their key."""
    best = metrics.groupBy(*keys).agg(F.max(score).alias("__best"))
    return metrics.join(best, list(keys)).filter(F.col(score) >= F.col("__best") - width).drop("__best")


def fold_stability(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of fold errors per configuration."""
    return fold_metrics.groupBy(*keys).agg(
        F.avg("mae").alias("fold_mae_mean"),
        F.stddev_samp("mae").alias("fold_mae_standard_deviation"),
        F.try_divide(F.stddev_samp("mae"), F.avg("mae")).alias("fold_mae_cv"),
        F.avg("r2").alias("fold_r2_mean"),
        F.stddev_samp("r2").alias("fold_r2_standard_deviation"),
        F.bool_and(F.col("r2") > 0).alias("all_fold_r2_positive"),
    )


def category_means(df: DataFrame, categories: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Rows and mean actual and predicted value per category combination."""
    return df.groupBy(*categories).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(actual).alias("actual_mean"), F.avg(predicted).alias("prediction_mean")
    )


def confidence_report(
    df: DataFrame, probability: str, actual: str, predicted: str, low: float = 0.50, high: float = 0.80
) -> DataFrame:
    """The largest class probability: spread, unsure rows, and sure but wrong rows."""
    wrong = F.col(actual) != F.col(predicted)
    p = F.col(probability)
    rows = df.select(p.alias("value"), (p < low).alias("__low"), (wrong & (p >= high)).alias("__sure"))
    counts = rows.agg(
        F.count("value").alias("rows"), F.avg("value").alias("mean"), F.min("value").alias("minimum"),
        F.max("value").alias("maximum"), F.count_if("__low").alias("low_confidence_rows"),
        F.count_if("__sure").alias("wrong_high_confidence_rows"),
    )
    keyed = one_group(rows)
    quartiles = quantiles_from_counts(value_counts(keyed, ["__all"]), ["__all"], (0.25, 0.5, 0.75))
    found = quartiles.select(F.struct("p25", F.col("p50").alias("median"), "p75")).scalar()
    return counts.withColumn("__q", found).select("rows", "mean", "minimum", "__q.p25", "__q.median", "__q.p75", "maximum",
                                                  "low_confidence_rows", "wrong_high_confidence_rows")


def retest_status(
    metrics: DataFrame, is_classification: bool = False
) -> DataFrame:
    """The status after the single test scoring.

    Needs validation_beats, test_beats and gain; classification also
    validation_macro_f1 and test_macro_f1, regression validation_mae and test_mae.
    """
    if is_classification:
        stable = F.abs(F.col("validation_macro_f1") - F.col("test_macro_f1")) <= 0.02
        clear = 0.02
    else:
        base = F.greatest(F.col("validation_mae"), F.lit(1e-12))
        stable = F.abs(F.col("test_mae") - F.col("validation_mae")) / base <= 0.20
        clear = 0.05
    status = (
        F.when(~(F.col("validation_beats") & F.col("test_beats")), "DOES_NOT_BEAT_BASELINE")
        .when(~stable, "UNSTABLE")
        .when(F.col("gain") < clear, "MARGINALLY_BEATS_BASELINE")
        .otherwise("BEATS_BASELINE")
    )
    return metrics.withColumn("status", status)

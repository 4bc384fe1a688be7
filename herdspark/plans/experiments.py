"""Composite jobs: preprocessing, task experiments and first-generation training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdspark.operators import cleaning, joins, mapping, splits, validate
from herdspark.operators import metrics as scores
from herdspark.operators import modeling as m
from herdspark.operators.contracts import HERD, HERD_ALIASES, TRAINING, TableContract
from herdspark.session import cut_lineage
from herdspark.sources.sinks import lock_selection
from herdspark.sources.tables import fingerprint


@dataclass(frozen=True)
class Prepared:
    """What the preprocessing job hands on."""

    table: DataFrame
    findings: DataFrame
    issues: DataFrame
    manifest: DataFrame
    folds: DataFrame
    evidence: DataFrame


def prepare_dataset(
    raw: DataFrame,
    key: str,
    stratum: str,
    models: Sequence[str],
    contract: TableContract = HERD,
    aliases: Mapping[str, Sequence[str]] = HERD_ALIASES,
    seed: int = 42,
    folds: int = 5,
) -> Prepared:
    """Map, validate, clean, view, split and fold a raw table.

    The split is made twice and both manifests must have one fingerprint.
    """
    mapped = mapping.map_columns(raw, aliases=aliases).table
    findings = None
    for model in models:
        part = validate.validate_table(mapped, model, TRAINING, key, contract).select(F.lit(model).alias("model"), "*")
        findings = part if findings is None else findings.unionByName(part)
    table = cleaning.clean_table(mapped, contract)
    for model in models:
        mapping.feature_view(table, model, contract, keys=[key])
    splits.check_strata(table, stratum)
    manifest = splits.split_assignments(table, stratum, key, seed)
    again = splits.split_assignments(table, stratum, key, seed)
    first, second = (fingerprint(x.select(key, "split")) for x in (manifest, again))
    evidence = (
        first.select(F.lit("first").alias("run"), "*").unionByName(second.select(F.lit("second").alias("run"), "*"))
    )
    assigned = splits.training_folds(manifest, stratum, key, folds, seed)
    return Prepared(table, findings, cleaning.cleaning_issues(mapped, contract, [key]), manifest, assigned, evidence)


def regression_experiment(
    rows: DataFrame,
    features: m.Features,
    label: str,
    key: str,
    candidates: Sequence[m.Candidate],
    lock_path: str,
    split: str = "split",
) -> DataFrame:
    """Choose on validation rows, lock the choice, score the test rows once.

    ``rows`` carry their split. The lock is a table that can only be written
    once, so a second run on the same path stops before it sees the test rows.
    """
    parts = {name: rows.filter(F.col(split) == name).drop(split) for name in ("train", "validation", "test")}
    table, fitted = m.evaluate_candidates(parts["train"], parts["validation"], features, label, candidates, key)
    gated = scores.regression_gate(table.withColumn("task", F.lit(label)), ["task"])
    order = [F.col("mae"), F.col("rmse"), F.desc("r2"), F.col("training_seconds")]
    # Every candidate may be chosen; the gate only says whether it is good enough.
    choice = scores.selected(gated, ["task"], order, F.lit(True), "configuration_id")
    locked = lock_selection(choice.join(gated.select("task", F.col("configuration_id").alias("selected"), "mae", "beats_baseline"), ["task", "selected"]), lock_path)
    chosen = locked.first()  # one row
    best_baseline = table.filter("is_baseline").orderBy("mae", "rmse").first()["configuration_id"]
    scored = None
    for name in (chosen["selected"], best_baseline):
        tested = cut_lineage(fitted[name].predict(parts["test"]).select(label, m.PREDICTION))
        part = scores.regression_metrics(tested, label, m.PREDICTION).select(
            F.lit(name).alias("configuration_id"), F.lit(name == best_baseline).alias("is_baseline"), "*"
        )
        scored = part if scored is None else scored.unionByName(part)
    test = scores.regression_gate(scored.withColumn("task", F.lit(label)), ["task"]).select(
        "task", "configuration_id", F.col("mae").alias("test_mae"), F.col("rmse").alias("test_rmse"), F.col("r2").alias("test_r2"),
        F.col("beats_baseline").alias("test_beats"), F.col("mae_improvement").alias("gain"),
        F.lit(chosen["mae"]).alias("validation_mae"), F.lit(chosen["beats_baseline"]).alias("validation_beats"),
    )
    return scores.retest_status(test)


def label_and_amount_experiment(
    rows: DataFrame,
    features: m.Features,
    label: str,
    amount: str,
    key: str,
    fold: str,
    folds: int,
    classifier: m.Candidate,
    regressor: m.Candidate,
) -> DataFrame:
    """K41 for a label and an amount: cross-fitted label as a feature, both designs compared.

    Training rows get the label predicted by models that never saw their fold;
    validation rows get it from a model fitted on all training rows. The true
    label enters neither design.
    """
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    out_of_fold = m.cross_fitted(train, features, label, classifier, key, fold, folds, classification=True)
    final = m.fit_candidate(train, features, label, classifier, key, classification=True)
    given = final.predict(validation).select(key, "predicted_label")
    predicted = cut_lineage(out_of_fold.select(key, "predicted_label").unionByName(given))
    # Test rows take no part in the comparison and have no predicted label.
    compared = rows.filter("split IN ('train', 'validation')").drop(label)
    with_label = cut_lineage(mapping.attach_prediction(compared, predicted, key, "predicted_label"))
    labelled = m.Features((*features.categories, "predicted_label"), features.numbers, features.indicators, features.scaled)
    result = None
    for design, table, inputs in (("A", compared, features), ("B", with_label, labelled)):
        one = m.fit_candidate(table.filter("split = 'train'"), m.prepared_for(regressor, inputs), amount, regressor, forbidden=(label,))
        judged = cut_lineage(one.predict(table.filter("split = 'validation'")).select(amount, m.PREDICTION))
        scored = scores.regression_metrics(judged, amount, m.PREDICTION)
        part = scored.select(F.lit(design).alias("design"), "*")
        result = part if result is None else result.unionByName(part)
    pair = result.groupBy().pivot("design", ["A", "B"]).agg(F.first(F.struct("mae", "rmse", "r2")))
    useful = pair.select(scores.design_gain(F.col("A"), F.col("B")).alias("meaningful")).scalar()
    return result.withColumn("design_b_is_meaningful", useful)


def ablation_experiment(
    train: DataFrame, validation: DataFrame, features: m.Features, label: str, key: str, candidate: m.Candidate, dropped: str
) -> DataFrame:
    """The full view and the view without one feature, as two metric rows."""
    less = m.Features(
        tuple(c for c in features.categories if c != dropped), tuple(c for c in features.numbers if c != dropped),
        tuple(c for c in features.indicators if c != dropped), features.scaled,
    )
    result = None
    for view, inputs in (("full", features), (f"without_{dropped}", less)):
        one = m.fit_candidate(train, m.prepared_for(candidate, inputs), label, candidate)
        part = scores.regression_metrics(one.predict(validation), label, m.PREDICTION).select(F.lit(view).alias("view"), "*")
        result = part if result is None else result.unionByName(part)
    return result


def first_generation_regression(
    df: DataFrame, label: str, key: str, preferred: Sequence[str], leakage: Sequence[str] = (),
    candidates: Sequence[m.Candidate] | None = None,
) -> DataFrame:
    """An 80/20 job over all rows, features chosen by rule, judged against the mean."""
    rows = mapping.drop_unusable_target(df, label)
    names = mapping.select_features(rows, label, preferred, leakage)
    categories, numbers = mapping.split_feature_types(rows, names)
    features = m.Features(tuple(categories), tuple(numbers), scaled=True)
    drawn = splits.ranked(rows, [], key, 42).select(
        key, F.when(F.col("stratum_rank") <= F.ceil(F.col("stratum_rows") * F.lit(0.2)), "test").otherwise("train").alias("split")
    )
    tagged = rows.select(key, label, *names).join(drawn, key)
    chosen = candidates or [
        m.Candidate("dummy_mean", "mean", baseline="mean"),
        m.Candidate("random_forest", "forest", {"trees": 80, "depth": 14, "leaf": 1, "subset": "all"}),
        m.Candidate("boosted_trees", "boosted", {"rounds": 120, "step": 0.08, "leaves": 31}),
    ]
    table, _ = m.evaluate_candidates(
        tagged.filter("split = 'train'").drop("split"), tagged.filter("split = 'test'").drop("split"), features, label, chosen, key
    )
    base = table.filter("is_baseline").agg(F.first(F.struct("r2", "mae"))).scalar()
    gains = table.withColumn("__b", base).withColumns(
        {"r2_gain": F.col("r2") - F.col("__b.r2"), "mae_gain": F.col("__b.mae") - F.col("mae")}
    ).drop("__b")
    good = ~F.col("is_baseline") & (F.col("r2") >= 0.10) & (F.col("r2_gain") >= 0.10) & (F.col("mae_gain") > 0)
    return gains.withColumn("recommended", good)


def first_generation_classification(
    df: DataFrame, label: str, key: str, features: m.Features, candidates: Sequence[m.Candidate] | None = None
) -> DataFrame:
    """Class-balanced forest against the most frequent class, 20 % of each class for testing."""
    rows = df.filter(F.col(label).isNotNull())
    manifest = splits.split_assignments(rows, label, key, fractions=(("train", 0.8), ("test", 0.2))).select(key, "split")
    weights = splits.class_weights(rows, label)
    tagged = rows.select(key, label, *features.names).join(manifest, key).join(weights, label)
    labels = [r[0] for r in weights.select(label).orderBy(label).collect()]  # the classes
    chosen = candidates or [
        m.Candidate("dummy_most_frequent", "most_frequent", baseline="most_frequent"),
        m.Candidate("random_forest", "forest", {"trees": 100, "depth": 16, "leaf": 1, "subset": "sqrt"}),
    ]
    table, _ = m.evaluate_candidates(
        tagged.filter("split = 'train'").drop("split"), tagged.filter("split = 'test'").drop("split"),
        features, label, chosen, key, labels, weight="class_weight",
    )
    base = table.filter("is_baseline").agg(F.first(F.struct("balanced_accuracy", "weighted_f1"))).scalar()
    gains = table.withColumn("__b", base).withColumns(
        {"balanced_gain": F.col("balanced_accuracy") - F.col("__b.balanced_accuracy"), "f1_gain": F.col("weighted_f1") - F.col("__b.weighted_f1")}
    ).drop("__b")
    good = (
        ~F.col("is_baseline") & (F.col("balanced_accuracy") >= 0.60) & (F.col("weighted_f1") >= 0.60)
        & (F.col("balanced_gain") >= 0.10) & (F.col("f1_gain") > 0.05)
    )
    return gains.withColumn("recommended", good)


def final_recommendation(yield_recommended: bool, disease_recommended: bool) -> str:
    """Which supporting models go with the rule-based planner."""
    if yield_recommended and disease_recommended:
        return "BOTH_MODELS_AND_RULES"
    if yield_recommended:
        return "YIELD_MODEL_AND_RULES"
    return "DISEASE_MODEL_AND_RULES" if disease_recommended else "RULES_ONLY"


def joined_grouped_experiment(
    left: DataFrame, right: DataFrame, keys: Sequence[str], group: str, row_key: str, features: m.Features,
    extra: Sequence[str], label: str, candidate: m.Candidate,
) -> DataFrame:
    """One-to-one join of two measurement tables, then grouped folds with and without the extra inputs."""
    joined = joins.one_to_one_join(left, right, keys)
    assigned = splits.group_assignments(joined, group)
    rows = cut_lineage(splits.apply_groups(joined, assigned, group).filter("partition = 'development'"))
    more = m.Features(features.categories, (*features.numbers, *extra), features.indicators, features.scaled)
    result = None
    for view, inputs in (("base", features), ("with_extra", more)):
        pooled, _ = m.grouped_cross_validation(rows, inputs, label, [candidate], row_key, group)
        part = pooled.select(F.lit(view).alias("view"), "*")
        result = part if result is None else result.unionByName(part)
    return result

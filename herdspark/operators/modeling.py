"""Preprocessing, candidate models, cross-fitting, importance and batch scoring.

Linear models and trees learn on MLlib, forests in ``forest``, boosted trees in ``boosting``.
Imputation values, scales and dummy predictions are a handful of aggregates that
become ``SQLTransformer`` stages, so every fitted model is one persistable
``PipelineModel``.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
)
from pyspark.ml.feature import (
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    LinearRegression,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from herdspark.functions.values import interval_label
from herdspark.operators import boosting, forest, grams, rules
from herdspark.operators import metrics as scores
from herdspark.operators.latest import largest_groups
from herdspark.operators.splits import fixed_sample, ranked
from herdspark.operators.summary import held_out, long_values, quantiles_from_counts
from herdspark.session import cut_lineage

PREDICTION = "prediction"
#: One-hot values of a category feature; each becomes a column and a literal of the plan.
MAX_CATEGORY_VALUES = 10_000


#: Classes of a label; each is a row on the driver and a tree of a boosting round.
MAX_CLASSES = 1_000


class TooManyCategories(ValueError):
    """One-hot features with more values than a plan can hold."""


@dataclass(frozen=True)
class Features:
    """The inputs of a model and how they are prepared."""

    categories: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    indicators: tuple[str, ...] = ()
    scaled: bool = False

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.categories, *self.numbers)


@dataclass(frozen=True)
class Candidate:
    """One configuration of a task."""

    id: str
    algorithm: str
    parameters: Mapping[str, object] = field(default_factory=dict)
    baseline: str | None = None
    linear: bool = False


def regression_candidates(prefix: str, small: bool = False) -> list[Candidate]:
    """K14. The approved settings; ``small`` is the grouped study's list."""
    dummies = [
        Candidate(f"{prefix}_dummy_mean", "mean", baseline="mean"),
        Candidate(f"{prefix}_dummy_median", "median", baseline="median"),
    ]
    if small:
        return [
            *dummies,
            Candidate(f"{prefix}_linear", "linear", linear=True),
            Candidate(f"{prefix}_ridge_a0_1", "ridge", {"alpha": 0.1}, linear=True),
            Candidate(f"{prefix}_ridge_a1", "ridge", {"alpha": 1.0}, linear=True),
            Candidate(f"{prefix}_ridge_a10", "ridge", {"alpha": 10.0}, linear=True),
            Candidate(f"{prefix}_tree_d2", "tree", {"depth": 2, "leaf": 20}),
            Candidate(f"{prefix}_tree_d3", "tree", {"depth": 3, "leaf": 20}),
            Candidate(f"{prefix}_forest_d2", "forest", {"trees": 100, "depth": 2, "leaf": 10, "subset": "all"}),
            Candidate(f"{prefix}_forest_d3", "forest", {"trees": 100, "depth": 3, "leaf": 10, "subset": "all"}),
        ]
    return [
        *dummies,
        Candidate(f"{prefix}_ridge", "ridge", {"alpha": 1.0}, linear=True),
        Candidate(f"{prefix}_decision_tree", "tree", {"depth": 14, "leaf": 20}),
        Candidate(f"{prefix}_random_forest", "forest", {"trees": 60, "depth": 18, "leaf": 5, "subset": "0.8"}),
        Candidate(f"{prefix}_boosted_trees", "boosted", {"rounds": 100, "step": 0.08, "leaves": 31, "l2": 0.1}),
    ]


def classifier_candidates(prefix: str) -> list[Candidate]:
    """K15. The approved classifier settings."""
    return [
        Candidate(f"{prefix}_dummy_most_frequent", "most_frequent", baseline="most_frequent"),
        Candidate(f"{prefix}_dummy_stratified", "stratified", {"seed": 42}, baseline="stratified"),
        Candidate(f"{prefix}_logistic_c1", "logistic", {"c": 1.0, "rounds": 300}, linear=True),
        Candidate(f"{prefix}_decision_tree", "tree", {"depth": 14, "leaf": 20}),
        Candidate(f"{prefix}_random_forest", "forest", {"trees": 60, "depth": 18, "leaf": 5, "subset": "sqrt"}),
        Candidate(f"{prefix}_boosted_trees", "boosted", {"rounds": 80, "step": 0.08, "leaves": 31, "l2": 0.1}),
    ]


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Facts:
    """What preprocessing and the dummies learn from training rows."""

    labels: Mapping[str, tuple[str, ...]]  # category column -> its values, sorted
    modes: Mapping[str, str]
    medians: Mapping[str, float]
    means: Mapping[str, float]  # after median imputation
    deviations: Mapping[str, float]  # population, after median imputation
    rows: int


def _held_out(counts: DataFrame, fold: str | None, folds: int, keys: Sequence[str]) -> DataFrame:
    """Value counts of the training rows for every held-out fold, from counts per fold."""
    if fold is None:
        return counts.withColumn("heldout", F.lit(0))
    return held_out(counts, fold, folds).groupBy("heldout", *keys).agg(F.sum("n").alias("n"))


def _moments(parts: Sequence, median: float | None) -> tuple[int, float, float]:
    """Rows, mean and population deviation of some folds' numbers, nulls filled with their median."""
    rows, known, fill = sum(r["rows"] for r in parts), [r for r in parts if r["known"]], 0.0 if median is None else median
    sums = [(r["known"], r["mean"], r["variance"]) for r in known]
    if rows > sum(n for n, _, _ in sums):
        sums.append((rows - sum(n for n, _, _ in sums), fill, 0.0))
    if all(r["low"] == r["high"] == fill for r in known):
        return rows, fill, 0.0
    mean = sum(n * at for n, at, _ in sums) / rows
    return rows, mean, math.sqrt(sum(n * (spread + (at - mean) * (at - mean)) for n, at, spread in sums) / rows)


def learn_facts(
    train: DataFrame, features: Features, label: str | None = None, fold: str | None = None, folds: int = 0
) -> dict[int, Facts]:
    """Categories, modes, medians, means and deviations; with folds, for every held-out fold at once.

    Cells are counted and summed up per fold once. What holds without each fold
    follows from these, so cross-validation reads the rows one time for all its
    folds. What comes to the driver is one row per fold and feature, and per category of a one-hot
    feature; a column with more than ``MAX_CATEGORY_VALUES`` of these is refused by name.
    """
    held = [0] if fold is None else list(range(1, folds + 1))
    keep = [] if fold is None else [fold]
    labels: dict[int, dict[str, list[tuple[str, int]]]] = {h: {c: [] for c in features.categories} for h in held}
    if features.categories:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in features.categories])
        counts = (
            train.select(*keep, F.explode(cells).alias("c")).filter("c.value is not null")
            .groupBy(*keep, F.col("c.column").alias("column"), F.col("c.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        )
        # A column's distinct values are those of all folds; one row per column tells whether they may come to the driver.
        sizes = counts.groupBy("column").agg(F.countDistinct("value").alias("values")).filter(F.col("values") > MAX_CATEGORY_VALUES)
        wide = sorted((r["column"], r["values"]) for r in sizes.collect())
        if wide:
            told = ", ".join(f"{c} ({n} values)" for c, n in wide)
            raise TooManyCategories(f"{told}: more than {MAX_CATEGORY_VALUES}; hash or group them first")
        rows = _held_out(counts, fold, folds, ["column", "value"]).collect()
        for r in rows:
            labels[r["heldout"]][r["column"]].append((r["value"], r["n"]))
    numbers = [*features.numbers, *([label] if label else [])]
    found: dict[int, dict[str, object]] = {h: {} for h in held}
    if numbers:
        # Sums per fold, and medians found digit by digit: no value is shuffled.
        cells, v = long_values(train, numbers, keep), F.col("value")
        sums = cells.groupBy(*keep, "column").agg(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("known"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"),
            F.min(v).alias("low"), F.max(v).alias("high"),
        ).collect()
        without = None if fold is None else (fold, folds)
        ones = cells.withColumn("n", F.lit(1).cast("bigint"))
        medians = {
            (r["heldout"] if fold else 0, r["column"]): r["p50"]
            for r in quantiles_from_counts(ones, ["column"], (0.5,), few_keys=True, without=without).collect()
        }
        for h in held:
            for c in dict.fromkeys(numbers):
                parts = [r for r in sums if r["column"] == c and (fold is None or (r[fold] is not None and int(r[fold]) != h))]
                if parts:
                    median = medians.get((h, c))
                    total, mean, deviation = _moments(parts, median)
                    found[h][c] = {"rows": total, "median": median, "mean": mean, "deviation": deviation}
    out = {}
    for h in held:
        modes = {c: min(v, key=lambda x: (-x[1], x[0]))[0] for c, v in labels[h].items() if v}
        rows = found[h]
        out[h] = Facts(
            {c: tuple(sorted(x for x, _ in v)) for c, v in labels[h].items()}, modes,
            {c: r["median"] if r["median"] is not None else 0.0 for c, r in rows.items()},
            {c: r["mean"] for c, r in rows.items()}, {c: r["deviation"] for c, r in rows.items()},
            max((r["rows"] for r in rows.values()), default=0),
        )
    return out


def preprocessor(features: Features, facts: Facts, sample: DataFrame) -> PipelineModel:
    """Impute, flag, scale and one-hot; unknown categories become all zeros.

    ``sample`` only lends its schema.
    """
    parts = ["*"]
    for c in features.categories:
        parts.append(f"coalesce(cast({_sql_name(c)} as string), {_sql_text(facts.modes.get(c, ''))}) as {_sql_name('__c_' + c)}")
    for c in features.numbers:
        filled = f"coalesce(cast({_sql_name(c)} as double), {facts.medians.get(c, 0.0)!r}D)"
        if features.scaled:
            filled = f"({filled} - {facts.means[c]!r}D) / {(facts.deviations[c] or 1.0)!r}D"
        parts.append(f"{filled} as {_sql_name('__n_' + c)}")
    for c in features.indicators:
        parts.append(f"cast({_sql_name(c)} is null as double) as {_sql_name('__m_' + c)}")
    stages: list = [SQLTransformer(statement=f"select {', '.join(parts)} from __THIS__")]
    inputs = [f"__n_{c}" for c in features.numbers] + [f"__m_{c}" for c in features.indicators]
    if features.categories:
        names = [f"__c_{c}" for c in features.categories]
        indexed, hot = [n + "_i" for n in names], [n + "_h" for n in names]
        # "keep" adds one last index for unknown values, which dropLast turns into zeros.
        for c, name, index in zip(features.categories, names, indexed):
            stages.append(StringIndexerModel.from_labels(list(facts.labels[c]), name, index, handleInvalid="keep"))
        shaped = PipelineModel(stages).transform(sample.limit(0))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True).fit(shaped))
        inputs = hot + inputs
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return PipelineModel(stages)


def fitted_preprocessor(train: DataFrame, features: Features) -> PipelineModel:
    """K13 in one step."""
    return preprocessor(features, learn_facts(train, features)[0], train)


def _constant(value: float) -> SQLTransformer:
    return SQLTransformer(statement=f"select *, {value!r}D as {PREDICTION} from __THIS__")


def _regressor(train: DataFrame, label: str, candidate: Candidate, seed: int, facts: Facts) -> Transformer:
    p = candidate.parameters
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": PREDICTION}
    if candidate.algorithm == "mean":
        return _constant(facts.means[label])
    if candidate.algorithm == "median":
        return _constant(facts.medians[label])
    if candidate.algorithm == "linear":
        return LinearRegression(solver="normal", standardization=False, regParam=0.0, **common).fit(train)
    if candidate.algorithm == "ridge":
        penalty = float(p["alpha"]) / facts.rows * facts.deviations[label]
        return LinearRegression(
            solver="normal", standardization=False, elasticNetParam=0.0, regParam=penalty, **common
        ).fit(train)
    if candidate.algorithm == "tree":
        return DecisionTreeRegressor(maxDepth=p["depth"], minInstancesPerNode=p["leaf"], seed=seed, **common).fit(train)
    if candidate.algorithm == "forest":
        return forest.fit(train, label, forest.Settings(**p, seed=seed))
    if candidate.algorithm == "boosted":
        return boosting.fit(train, label, boosting.Settings(**p))
    raise ValueError(f"unknown regressor {candidate.algorithm}")


def _classifier(train: DataFrame, label: str, key: str, candidate: Candidate, seed: int, weight: str | None) -> PipelineModel:
    p = candidate.parameters
    if candidate.algorithm in ("most_frequent", "stratified"):
        counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
        if len(counts) > MAX_CLASSES:
            raise TooManyCategories(f"{label}: more than {MAX_CLASSES} classes")
        counts = sorted(((r[label], r["n"]) for r in counts), key=lambda x: (-x[1], x[0]))
        if candidate.algorithm == "most_frequent":
            expression = _sql_text(counts[0][0])
        else:
            total, reached, parts = sum(n for _, n in counts), 0, []
            for name, n in counts:
                reached += n
                parts.append(f"when __u < {reached / total!r}D then {_sql_text(name)}")
            unit = f"conv(substring(md5(concat('{p['seed']}|', cast({_sql_name(key)} as string))), 1, 8), 16, 10) / 4294967296D"
            expression = f"case {' '.join(parts)} else {_sql_text(counts[-1][0])} end"
            expression = expression.replace("__u", f"({unit})")
        return PipelineModel([SQLTransformer(statement=f"select *, {expression} as predicted_label from __THIS__")])
    indexer = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="error", stringOrderType="alphabetAsc").fit(train)
    if len(indexer.labels) > MAX_CLASSES:
        raise TooManyCategories(f"{label}: more than {MAX_CLASSES} classes")
    rows = indexer.transform(train)
    common = {"featuresCol": "features", "labelCol": "__label", "predictionCol": PREDICTION}
    if weight:
        common["weightCol"] = weight
    if candidate.algorithm == "logistic":
        size = rows.count()
        model = LogisticRegression(
            maxIter=p["rounds"], tol=1e-5, regParam=1.0 / (float(p["c"]) * max(size, 1)), elasticNetParam=0.0,
            standardization=False, family="multinomial", **common
        ).fit(rows)
    elif candidate.algorithm == "tree":
        model = DecisionTreeClassifier(maxDepth=p["depth"], minInstancesPerNode=p["leaf"], seed=seed, **common).fit(rows)
    elif candidate.algorithm == "forest":
        model = forest.fit(rows, "__label", forest.Settings(**p, seed=seed), len(indexer.labels), weight=weight)
    elif candidate.algorithm == "boosted":
        model = boosting.fit(rows, "__label", boosting.Settings(**p), len(indexer.labels), weight=weight)
    else:
        raise ValueError(f"unknown classifier {candidate.algorithm}")
    named = IndexToString(inputCol=PREDICTION, outputCol="predicted_label", labels=list(indexer.labels))
    return PipelineModel([model, named])


@dataclass(frozen=True)
class Fitted:
    """A fitted candidate and how long the fit took."""

    candidate: Candidate
    model: PipelineModel
    seconds: float

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_candidate(
    train: DataFrame,
    features: Features,
    label: str,
    candidate: Candidate,
    key: str | None = None,
    classification: bool = False,
    seed: int = 42,
    weight: str | None = None,
    facts: Facts | None = None,
    forbidden: Sequence[str] = (),
    vectors: tuple[PipelineModel, DataFrame] | None = None,
) -> Fitted:
    """Preprocess and fit one candidate; barred names are refused before any job.

    ``facts`` and ``vectors`` (of ``vector_table``) spare learning and computing again what several candidates share.
    """
    leaked = sorted({label, *forbidden} & set(features.names))
    if leaked:
        raise ValueError(f"target or identifier used as a feature: {', '.join(leaked)}")
    if classification and key is None:
        raise ValueError("classification needs the row key")
    started = time.perf_counter()
    facts = facts or learn_facts(train, features, None if classification else label)[0]
    if vectors is None:
        prepared = preprocessor(features, facts, train)
        rows = prepared.transform(train)
    else:
        prepared, rows = vectors
    if classification:
        stages = _classifier(rows, label, key, candidate, seed, weight).stages
    else:
        stages = [_regressor(rows, label, candidate, seed, facts)]
    model = PipelineModel([*prepared.stages, *stages])
    return Fitted(candidate, model, time.perf_counter() - started)


def vector_table(train: DataFrame, features: Features, facts: Facts, keep: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """The preprocessor and the persisted rows it makes: kept columns and the feature vector, no raw inputs."""
    prepared = preprocessor(features, facts, train)
    rows = prepared.transform(train).select(*dict.fromkeys(keep), "features")
    return prepared, rows.persist(StorageLevel.MEMORY_AND_DISK)


def prepared_for(candidate: Candidate, features: Features) -> Features:
    """Scaled numbers for linear candidates, plain ones for trees."""
    return Features(features.categories, features.numbers, features.indicators, scaled=candidate.linear and features.scaled)


def evaluate_candidates(
    train: DataFrame,
    validation: DataFrame,
    features: Features,
    label: str,
    candidates: Sequence[Candidate],
    key: str,
    labels: Sequence[str] | None = None,
    seed: int = 42,
    weight: str | None = None,
) -> tuple[DataFrame, dict[str, Fitted]]:
    """Fit every candidate, score it on the validation rows, one metrics row each.

    The rows the fits share are persisted with spill to disk; a lost executor's
    part is computed again from the source.
    """
    spark = train.sparkSession
    classification = labels is not None
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    validation = validation.persist(StorageLevel.MEMORY_AND_DISK)
    fitted: dict[str, Fitted] = {}
    tables: dict[Features, tuple[PipelineModel, DataFrame]] = {}
    keep = [label, key, *([weight] if weight else [])]
    predicted = None
    try:
        facts = learn_facts(train, features, None if classification else label)[0]
        output = "predicted_label" if classification else PREDICTION
        for c in candidates:
            inputs = prepared_for(c, features)
            if inputs not in tables and label not in inputs.names:
                tables[inputs] = vector_table(train, inputs, facts, keep)
            fitted[c.id] = fit_candidate(
                train, inputs, label, c, key, classification, seed, weight, facts, vectors=tables.get(inputs)
            )
            part = fitted[c.id].predict(validation).select(F.lit(c.id).alias("configuration_id"), label, output)
            predicted = part if predicted is None else predicted.unionByName(part)
        # The metrics read the predictions several times; no model predicts a row twice.
        predicted = cut_lineage(predicted)
        if classification:
            scored = scores.classification_metrics(predicted, label, output, labels, ["configuration_id"])
        else:
            scored = scores.regression_metrics(predicted, label, output, ["configuration_id"], few_keys=True)
        found = spark.createDataFrame(scored.collect(), scored.schema)  # one row per candidate
    finally:
        for _, rows in tables.values():
            rows.unpersist()
        train.unpersist()
        validation.unpersist()
    about = spark.createDataFrame(
        [(c.id, c.algorithm, c.baseline, c.baseline is not None, fitted[c.id].seconds) for c in candidates],
        "configuration_id string, algorithm string, baseline string, is_baseline boolean, training_seconds double",
    )
    return about.join(found, "configuration_id"), fitted


def cross_fitted(
    rows: DataFrame,
    features: Features,
    label: str,
    candidate: Candidate,
    key: str,
    fold: str,
    folds: int,
    classification: bool = False,
    seed: int = 42,
    facts: Mapping[int, Facts] | None = None,
    carry: Sequence[str] = (),
    fits: list[DataFrame] | None = None,
) -> DataFrame:
    """(key, fold, prediction) where each row's model never saw its fold.

    With ``fits`` the tables that the models are fitted on are recorded there as
    (model, key), and the result names the model of each row, for ``fold_audit``.
    """
    out = None
    output = "predicted_label" if classification else PREDICTION
    facts = facts or learn_facts(rows, features, None if classification else label, fold, folds)
    for i in range(1, folds + 1):
        train = rows.filter(F.col(fold) != i)
        if fits is not None:
            fits.append(train.select(F.lit(i).alias("model"), key))
        fitted = fit_candidate(
            train, prepared_for(candidate, features), label, candidate, key, classification, seed,
            facts=facts[i],
        )
        part = fitted.predict(rows.filter(F.col(fold) == i)).select(
            key, F.col(fold).cast("int").alias(fold), *carry, F.col(output), *([] if fits is None else [F.lit(i).alias("model")])
        )
        out = part if out is None else out.unionByName(part)
    return out


def fold_audit(rows: DataFrame, predictions: DataFrame, fits: Sequence[DataFrame], key: str, fold: str) -> DataFrame:
    """Per fold, rows its model was fitted on, rows predicted, and predicted rows that the model was fitted on.

    ``predictions`` and ``fits`` come from ``cross_fitted``: the audit joins what
    each model predicted with what it was given.
    """
    given_rows = fits[0]
    for more in fits[1:]:
        given_rows = given_rows.unionByName(more)
    sizes = rows.groupBy(F.col(fold).cast("int").alias(fold)).agg(F.count(F.lit(1)).alias("heldout_rows"))
    fitted = given_rows.groupBy(F.col("model").alias(fold)).agg(F.count(F.lit(1)).alias("fit_rows"))
    predicted = predictions.groupBy(fold).agg(
        F.count(F.lit(1)).alias("predicted_rows"), F.countDistinct(key).alias("distinct_rows")
    )
    leaks = predictions.join(given_rows, ["model", key], "left_semi").groupBy(fold).agg(F.count(F.lit(1)).alias("leaks"))
    return sizes.join(fitted, fold).join(predicted, fold).join(leaks, fold, "left").select(
        fold, "fit_rows", "heldout_rows", "predicted_rows", "distinct_rows", F.coalesce("leaks", F.lit(0)).cast("bigint").alias("heldout_rows_in_fit")
    )


def confidence(predicted: DataFrame, label: str) -> DataFrame:
    """Audit of the largest class probability of a classifier's output."""
    top = F.array_max(vector_to_array("probability"))
    return scores.confidence_report(predicted.withColumn("__p", top), "__p", label, "predicted_label")


def _macro_f1(predicted: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys, score): the mean F1 over all classes that are labels or predictions."""
    counts = predicted.groupBy(*keys, F.col(label).cast("string").alias("__is"), F.col("predicted_label").alias("__said")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    sides = F.array(
        F.struct(F.col("__is").alias("class"), F.col("__n").alias("n"), F.when(F.col("__is") == F.col("__said"), F.col("__n")).otherwise(0).alias("hit")),
        F.struct(F.col("__said").alias("class"), F.col("__n").alias("n"), F.lit(0).cast("bigint").alias("hit")),
    )
    per_class = counts.select(*keys, F.explode(sides).alias("c")).groupBy(*keys, "c.class").agg(
        (2.0 * F.sum("c.hit") / F.sum("c.n")).alias("__f1")
    )
    return per_class.groupBy(*keys).agg(F.avg("__f1").alias("score"))


def permutation_importance(
    fitted: Fitted, rows: DataFrame, features: Features, label: str, key: str,
    repeats: int = 5, sample_rows: int | None = None, seed: int = 42, scoring: str = "error",
) -> DataFrame:
    """What shuffling one feature costs: the rise of the mean absolute error, or the fall of macro F1.

    Rows are put into one hash order. A shuffle gives each row the feature of the
    row a seeded number of places further on, which is a permutation without
    fixed rows. All features and repeats are scored in one job.
    """
    base = fixed_sample(rows, key, sample_rows, seed) if sample_rows else rows
    base = base.select(key, label, *features.names)
    names, total = list(features.names), base.count()
    if total < 2:
        raise ValueError("a shuffle needs two rows")
    draw = random.Random(seed)
    shifts = [(n, r, draw.randrange(1, total)) for n in names for r in range(repeats)] + [("", 0, 0)]
    placed = ranked(base, [], key, f"{seed}-own").select(key, (F.col("stratum_rank") - 1).alias("__at")).join(base, key)
    cases = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(r).alias("repeat"), F.lit(k).cast("bigint").alias("shift")) for n, r, k in shifts])
    asked = placed.withColumn("__case", F.explode(cases)).withColumn("__from", (F.col("__at") + F.col("__case.shift")) % total)
    donors = placed.select(F.col("__at").alias("__from"), F.struct(*names).alias("__donor"))
    changed = {n: F.when(F.col("__case.feature") == n, F.col(f"__donor.{n}")).otherwise(F.col(n)) for n in names}
    moved = asked.join(donors, "__from").withColumns(changed).select(key, label, *names, "__case.feature", "__case.repeat")
    predicted = fitted.predict(moved)
    if scoring == "macro_f1":
        scored = _macro_f1(predicted, ["feature", "repeat"], label).withColumn("score", -F.col("score"))
    else:
        scored = predicted.groupBy("feature", "repeat").agg(F.avg(F.abs(F.col(label) - F.col(PREDICTION))).alias("score"))
    # One row for each feature and repeat.
    found = scored.collect()
    plain = next(r["score"] for r in found if r["feature"] == "")
    table = rows.sparkSession.createDataFrame(
        [(r["feature"], r["repeat"], r["score"] - plain) for r in found if r["feature"]], "feature string, repeat int, increase double"
    )
    return table.groupBy("feature").agg(
        F.avg("increase").alias("importance_mean"), F.stddev_pop("increase").alias("importance_standard_deviation")
    )


def subgroup_metrics(
    predicted: DataFrame, label: str, group: str, minimum_rows: int = 100, largest: int | None = None
) -> DataFrame:
    """Errors per subgroup, for the largest groups or all with enough rows."""
    rows = predicted if largest is None else largest_groups(predicted, group, largest)
    found = scores.regression_metrics(rows, label, PREDICTION, [group]).filter(F.col("rows") >= minimum_rows)
    return found.select(F.lit(group).alias("group_column"), F.col(group).cast("string").alias("group"), "rows", "mae", "rmse", "r2")


# Target bands of the subgroup reports.
INF = float("inf")
FEED_BANDS = ((-INF, 7.0, 11.0, 15.0, 19.0, INF), ("<=7", "7-11", "11-15", "15-19", ">19"))
YIELD_BANDS = ((-INF, 5.0, 10.0, 15.0, 20.0, INF), ("<=5", "5-10", "10-15", "15-20", ">20"))


def diagnostics(
    predicted: DataFrame, label: str, groups: Sequence[str], banded: str, bands, breed: str | None = None, minimum_rows: int = 100
) -> DataFrame:
    """Subgroup errors by several columns, by band, and for the ten largest breeds."""
    rows = predicted.withColumn(f"{banded}_range", interval_label(F.col(banded), *bands))
    out = None
    for group in (*groups, f"{banded}_range"):
        part = subgroup_metrics(rows, label, group, minimum_rows)
        out = part if out is None else out.unionByName(part)
    if breed:
        out = out.unionByName(subgroup_metrics(rows, label, breed, minimum_rows, 10))
    return out


def grouped_cross_validation(
    rows: DataFrame, features: Features, label: str, candidates: Sequence[Candidate], key: str, group: str,
    fold: str = "group_fold", folds: int = 5, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(pooled metrics with stability and baseline flag, fold metrics) per configuration.

    All linear candidates are fitted on all folds from one pass and predicted in another.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    facts = learn_facts(rows, features, label, fold, folds)
    linear = [c for c in candidates if c.algorithm in ("linear", "ridge")]
    grid = linear_grid(rows, features, label, linear, key, fold, folds, facts) if linear else None
    parts = None
    if grid is not None:
        parts = grid.select("configuration_id", F.lit(False).alias("is_baseline"), fold, label, PREDICTION)
    for c in candidates:
        if grid is not None and c in linear:
            continue
        predicted = cross_fitted(rows, features, label, c, key, fold, folds, seed=seed, facts=facts, carry=(label,))
        tagged = predicted.select(
            F.lit(c.id).alias("configuration_id"), F.lit(c.baseline is not None).alias("is_baseline"), fold, label, PREDICTION
        )
        parts = tagged if parts is None else parts.unionByName(tagged)
    # The metrics read the predictions several times; no model predicts a row twice.
    parts = cut_lineage(parts)
    rows.unpersist()
    keys = ["configuration_id", "is_baseline"]
    by_fold = scores.regression_metrics(parts, label, PREDICTION, [*keys, fold], few_keys=True)
    pooled = scores.regression_metrics(parts, label, PREDICTION, keys, few_keys=True)
    stability = scores.fold_stability(scores.regression_sums(parts, label, PREDICTION, [*keys, fold]), keys)
    return pooled.join(stability, keys), by_fold


def linear_grid(
    rows: DataFrame, features: Features, label: str, candidates: Sequence[Candidate], key: str, fold: str, folds: int,
    facts: Mapping[int, Facts],
) -> DataFrame | None:
    """(key, label, fold, configuration_id, prediction) of a grid of linear and ridge candidates.

    Products are summed up per fold once; a model's are the total less its held-out fold, turned into
    the features that the other folds define. None where the design is too wide; it is fitted by iteration then.
    """
    leaked = {label} & set(features.names)
    if leaked:
        raise ValueError(f"target or identifier used as a feature: {label}")
    values = tuple((c, tuple(sorted({v for f in facts.values() for v in f.labels[c]}))) for c in features.categories)
    # Indicators of columns that are no number inputs have no flag in the design.
    extra = [c for c in features.indicators if c not in features.numbers]
    design = grams.Design(values, tuple((c, facts[1].means[c]) for c in features.numbers))
    if extra or design.width > grams.MAX_WIDTH:
        return None
    centre = facts[1].means[label]
    sums = grams.fold_products(rows, design, label, centre, fold, folds)
    gram, with_label = (sum(s[i] for s in sums.values()) for i in (0, 1))
    weights = {}
    for f, (own, own_label) in sums.items():
        found = []
        for c in candidates:
            inputs = prepared_for(c, features)
            scales = {n: (facts[f].means[n], facts[f].deviations[n]) for n in inputs.numbers} if inputs.scaled else {}
            shape = design.features(facts[f].labels, facts[f].modes, facts[f].medians, scales, inputs.indicators)
            alpha = float(c.parameters["alpha"]) if c.algorithm == "ridge" else 0.0
            found.append(grams.solve(gram - own, with_label - own_label, shape, alpha, centre))
        weights[f] = np.array(found)
    return grams.predictions(rows, design, fold, weights, [c.id for c in candidates], [key, label])


def final_holdout(
    development: DataFrame, holdout: DataFrame, features: Features, label: str, selected: Candidate,
    baselines: Sequence[Candidate], key: str, minimum: float = 0.05,
) -> DataFrame:
    """The selected configuration and both baselines on rows no fit has seen."""
    table, _ = evaluate_candidates(development, holdout, features, label, [*baselines, selected], key)
    return _ungrouped_gate(table, minimum)


def _ungrouped_gate(table: DataFrame, minimum: float) -> DataFrame:
    tagged = table.withColumn("__task", F.lit("holdout"))
    gated = scores.regression_gate(tagged, ["__task"], minimum)
    passed = F.col("beats_baseline") & (F.col("negative_prediction_count") == 0)
    return gated.withColumn("decision", F.when(passed, "BEATS_BASELINE").otherwise("DOES_NOT_BEAT_BASELINE")).drop("__task")


def category_analysis(predicted: DataFrame, categories: Sequence[str], label: str) -> DataFrame:
    """Mean actual and predicted value per category combination."""
    return scores.category_means(predicted, categories, label, PREDICTION)


def leave_one_group_out(
    rows: DataFrame, features: Features, label: str, group: str, key: str, alpha: float
) -> DataFrame:
    """K31 for the linear family: (key, group, label, prediction) without the row's own group.

    Each group's Gram matrix is a set of sums (partial aggregation, any group
    size); the total minus one group's matrix is solved per group, so there is
    one pass over the rows however many groups exist.
    """
    preprocessor = fitted_preprocessor(rows, features)
    vectors = preprocessor.transform(rows).select(
        key, group, F.col(label).cast("double").alias("__y"),
        F.concat(F.array(F.lit(1.0)), vector_to_array("features")).alias("__x"),
    )
    size = len(vectors.select("__x").first()["__x"])
    x, y = F.col("__x"), F.col("__y")
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(size)]
    grams = vectors.groupBy(group).agg(*sums)
    names = [f"g{i}_{j}" for i, j in pairs] + [f"b{i}" for i in range(size)]
    packed = grams.select(group, F.array(*names).alias("__own"))
    total = grams.agg(F.array(*[F.sum(n) for n in names])).scalar()
    weights = packed.withColumn("__all", total).mapInPandas(
        _solver(size, pairs, alpha, group), f"`{group}` {dict(rows.dtypes)[group]}, __w array<double>"
    )
    dot = F.aggregate(F.zip_with("__x", "__w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return vectors.join(weights, group).select(key, group, F.col("__y").alias(label), dot.alias(PREDICTION))


def _solver(size: int, pairs: Sequence[tuple[int, int]], alpha: float, group: str) -> Callable:
    """Solve (total − own + αI) w = b per row; the intercept is not penalised."""

    def solve(batches):
        import numpy as np
        import pandas as pd

        rows, columns = zip(*pairs)
        penalty = alpha * np.eye(size)
        penalty[0, 0] = 0.0
        for batch in batches:
            found = []
            for own, everything in zip(batch["__own"], batch["__all"]):
                left = np.asarray(everything) - np.asarray(own)
                gram = np.zeros((size, size))
                gram[rows, columns] = left[: len(pairs)]
                gram[columns, rows] = left[: len(pairs)]
                found.append(np.linalg.lstsq(gram + penalty, left[len(pairs):], rcond=None)[0].tolist())
            yield pd.DataFrame({group: batch[group], "__w": found})

    return solve


def non_negative_scores(inputs: DataFrame, model: PipelineModel, output: str, digits: int = 2) -> DataFrame:
    """Batch scoring; rows with an input error keep it and get no value."""
    scored = model.transform(inputs)
    value = F.when(F.col("input_error").isNull(), F.round(F.greatest(F.col(PREDICTION), F.lit(0.0)), digits))
    return scored.select(*inputs.columns, value.alias(output))


def candidate_scores(
    gated: DataFrame, models: Mapping[str, tuple[PipelineModel, float, float]], keys: Sequence[str]
) -> DataFrame:
    """Eligibility first, then each task's model, guard and roll-up, in one pass.

    ``gated`` has the columns of ``with_heat`` and ``with_eligibility`` and the
    models' features; ``models`` gives model, minimum and maximum per task.
    """
    rows = gated
    values, errors = [], []
    for task, (model, minimum, maximum) in models.items():
        kept = rows.columns
        scored = model.transform(rows).withColumn(
            f"__{task}", rules.guarded_prediction(F.col(PREDICTION), minimum, maximum)
        )
        eligible = F.col("eligibility") == "ELIGIBLE"
        rows = scored.select(
            *kept,
            F.when(eligible, F.col(f"__{task}.value")).alias(f"{task}_value"),
            F.when(eligible & F.col(f"__{task}.error").isNotNull(), F.lit("MODEL_ERROR")).alias(f"{task}_error"),
        )
        values.append(F.col(f"{task}_value"))
        errors.append(F.col(f"{task}_error"))
    reasons = F.array_distinct(F.array_compact(F.array(F.col("fallback_reason"), *errors)))
    return rows.select(
        *keys, "eligibility", "scope", *[f"{t}_value" for t in models], reasons.alias("fallback_reasons"),
        rules.scoring_status(values).alias("prediction_status"),
    )


def reload_check(fitted: Fitted, rows: DataFrame, key: str, path: str, tolerance: float = 1e-12) -> DataFrame:
    """Save, load, predict again and compare by key."""
    fitted.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    before = fitted.predict(rows).select(key, F.col(PREDICTION).alias("__a"))
    after = loaded.transform(rows).select(key, F.col(PREDICTION).alias("__b"))
    worst = F.max(F.abs(F.col("__a") - F.col("__b")))
    return before.join(after, key).agg(F.count(F.lit(1)).alias("rows"), worst.alias("maximum_difference")).withColumn(
        "identical", F.col("maximum_difference") <= tolerance
    )


def unknown_category_check(fitted: Fitted, rows: DataFrame, category: str) -> DataFrame:
    """A category never seen in training still gives a finite prediction."""
    strange = rows.withColumn(category, F.lit("__never_seen__"))
    bad = F.col(PREDICTION).isNull() | F.isnan(PREDICTION) | (F.abs(PREDICTION) == float("inf"))
    return fitted.predict(strange).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("non_finite"))

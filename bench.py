"""Times the headline queries and model fits; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` choose
the tables and the number of local cores. Every query is run to the end with a
``noop`` write; model times are the seconds of one fit.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

import herdspark.plans  # noqa: F401
from herdspark.operators import modeling as m
from herdspark.plans.model_queries import ALL, _part, tagged_facts
from herdspark.plans.registry import QUERIES
from herdspark.session import local_session

HEADLINES = (
    "grouping_sets_summary", "column_numeric_summaries", "column_profile", "whole_table_audit", "all_pairs_correlation",
    "contract_validation_training", "cleaning_issue_log", "composite_key_audit", "derived_health_status", "alert_sections",
    "attention_counts", "eligibility_gate", "ration_plan", "request_validation", "formula_audit", "stratified_split",
    "group_holdout_and_folds", "regression_scores", "classification_scores", "leave_one_group_out", "live_record_view", "stock_ledger",
)

CLASSIFIERS = ("logistic_c1", "decision_tree", "random_forest")
REGRESSORS = ("ridge", "decision_tree", "random_forest", "boosted_trees")


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    wanted = sys.argv[1:]
    # One small run loads classes and starts the Python workers.
    QUERIES["grouping_sets_summary"](spark, "/root/testdata/sf0.001").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        if not wanted or name in wanted:
            seconds[name] = timed(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    if not wanted or "fits" in wanted:
        rows = tagged_facts(spark, sf_dir)
        train, validation = _part(rows, "train").cache(), _part(rows, "validation").cache()
        seconds["fit_rows"] = train.count()
        validation.count()
        for kind, label, chosen, names in (
            ("classify", "flag", m.classifier_candidates("flag"), CLASSIFIERS),
            ("regress", "price", m.regression_candidates("price"), REGRESSORS),
        ):
            facts = m.learn_facts(train, ALL, None if kind == "classify" else label)[0]
            for candidate in chosen:
                short = candidate.id.split("_", 1)[1]
                if short not in names:
                    continue
                fitted = m.fit_candidate(
                    train, m.prepared_for(candidate, ALL), label, candidate, "id", kind == "classify", facts=facts
                )
                seconds[f"{kind}_{short}_fit"] = round(fitted.seconds, 3)
                seconds[f"{kind}_{short}_predict"] = timed(
                    lambda: fitted.predict(validation).select("id").agg(F.count("id")).collect()
                )
    total = round(sum(v for k, v in seconds.items() if k != "fit_rows"), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

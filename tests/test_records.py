"""Key audits, joins, latest rows, alerts and splits on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from herdspark.functions import text
from herdspark.operators import alerts, joins, latest, mapping, metrics, requests, splits

AS_OF = dt.date(2024, 5, 15)


def as_of():
    return F.lit(AS_OF.isoformat()).cast("date")


def keys(*names):
    return {n: F.col(n) for n in names}


def test_composite_audit_classes(spark):
    left = spark.createDataFrame([("1", "T0"), ("2", "T0"), ("3", None)], "a string, b string")
    same = joins.composite_join_audit(left, left, keys("a", "b"), keys("a", "b")).first()
    assert (same["join_safety"], same["cardinality"], same["left_missing_keys"], same["matches"]) == ("SAFE_ONE_TO_ONE", "ONE_TO_ONE", 1, 3)
    fewer = joins.composite_join_audit(left, left.limit(2), keys("a", "b"), keys("a", "b")).first()
    assert fewer["join_safety"] == "POSSIBLE_WITH_LIMITATIONS" and fewer["left_only_keys"] == 1
    twice = left.union(left.limit(1))
    assert joins.composite_join_audit(twice, left, keys("a", "b"), keys("a", "b")).first()["join_safety"] == "SAFE_ONE_TO_MANY"
    many = joins.composite_join_audit(twice, twice, keys("a", "b"), keys("a", "b")).first()
    assert many["many_to_many"] and many["left_duplicate_key_rows"] == 2
    one = left.union(spark.createDataFrame([("9", "T1"), ("9", "T1")], "a string, b string"))
    assert joins.composite_join_audit(twice, one, keys("a", "b"), keys("a", "b")).first()["join_safety"] == "UNCLEAR"


def test_single_key_audit_counts_surplus(spark):
    left = spark.createDataFrame([("a",), ("a",), ("a",), (" ",), ("b",)], "k string")
    right = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    row = joins.single_join_audit(left, right, "k", "k").first()
    assert (row["left_duplicate_surplus"], row["left_missing_keys"], row["matched_left_rows"], row["unmatched_left_keys"]) == (2, 1, 3, 1)
    assert row["left_match_percentage"] == 60.0 and row["join_safety"] == "POSSIBLE_WITH_LIMITATIONS"


def test_one_to_one_join_refuses_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, r string")
    assert joins.one_to_one_join(a, a.withColumnRenamed("l", "r"), ["k"]).count() == 2
    with pytest.raises(Exception, match="keys are not unique"):
        joins.one_to_one_join(a, b, ["k"]).collect()


def test_fold_lookup_and_manifest(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    folds = spark.createDataFrame([(1, 3)], "k int, fold int")
    with pytest.raises(Exception, match="no fold for 2"):
        joins.attach_fold(rows, folds, "k").collect()
    manifest = spark.createDataFrame([(1, "train"), (2, "test")], "k int, split string")
    assert [r["k"] for r in joins.manifest_partition(rows, manifest, "k", "split", "test").collect()] == [2]


def test_status_by_any_of_four_keys(spark):
    animals = spark.createDataFrame([("i1", "T1"), ("i2", "T2"), ("i3", "T3")], "id string, animal_id string")
    records = spark.createDataFrame(
        [(1, "i1", None, "Sick", 10), (2, "T1", None, "Recovered", 20), (3, None, "i2", " ", 30), (4, None, "T2", "Critical", 5)],
        "rid int, livestock_id string, animal_ref string, status string, t int")
    found = joins.status_by_any_key(animals, records, ["id", "animal_id"], ["livestock_id", "animal_ref"], "id", F.trim("status"), F.col("t"), "rid")
    assert {r["id"]: r["latest_status"] for r in found.collect()} == {"i1": "Recovered", "i2": "Critical", "i3": "Healthy"}


def test_cascade_with_owner(spark):
    gone = spark.createDataFrame([("1", "me")], "id string, user_id string")
    records = spark.createDataFrame([(1, "1", "me"), (2, "1", "you"), (3, "2", "me")], "rid int, livestock_id string, user_id string")
    kept = joins.without_removed({"r": (records, "livestock_id")}, gone, "id", "user_id")["r"]
    assert sorted(r["rid"] for r in kept.collect()) == [2, 3]


def vaccinations(spark):
    days = [-1, 0, 3, 4, 7, 8, 30, 31, None]
    rows = [(str(i), "FMD", "1", None, "Individual", None if n is None else AS_OF + dt.timedelta(n), "u") for i, n in enumerate(days)]
    rows += [("orphan", "FMD", "404", None, "Individual", AS_OF, "u"), ("batch", "", None, "b1", "Batch", AS_OF, "u"), ("lost", "x", None, "b9", "Batch", AS_OF, "u")]
    return spark.createDataFrame(rows, "id string, vaccine_name string, livestock_id string, batch_id string, target_type string, next_due_date date, user_id string")


def herd(spark):
    return spark.createDataFrame([("1", "T-1", "Bella", "cow", "Gir", "30", "400", "u", dt.datetime(2024, 1, 1))],
                                 "id string, animal_id string, animal_name string, species string, breed string, age string, weight string, user_id string, created_at timestamp")


def flocks(spark):
    return spark.createDataFrame([("b1", "North", "u", 12.0, "cow", dt.datetime(2024, 2, 1))], "id string, batch_name string, user_id string, head_count double, species string, created_at timestamp")


def test_vaccination_alert_bounds(spark):
    linked = alerts.linked_vaccinations(vaccinations(spark), herd(spark), flocks(spark))
    found = {r["alert_id"]: r for r in alerts.vaccination_alerts(linked, as_of()).collect()}
    assert {k: r["priority"] for k, r in found.items()} == {
        "overdue-0": "High", "upcoming-1": "Medium", "upcoming-2": "Medium", "upcoming-3": "Low", "upcoming-4": "Low", "upcoming-batch": "Medium"}
    assert found["upcoming-1"]["message"] == "FMD is due today for Bella (T-1)."
    assert found["upcoming-batch"]["message"] == "Vaccination is due today for North."
    upcoming = {r["id"]: r["status"] for r in alerts.upcoming_vaccinations(linked, as_of()).collect()}
    assert upcoming["4"] == "Due within 7 days" and upcoming["5"] == "Due within 30 days" and "7" not in upcoming and "0" not in upcoming


def test_due_status(spark):
    animals = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    records = spark.createDataFrame([("a", AS_OF - dt.timedelta(1)), ("a", AS_OF), ("b", AS_OF + dt.timedelta(7)), ("c", AS_OF + dt.timedelta(8)), ("c", None)], "fk string, due date")
    found = latest.due_status(animals, records, "id", "fk", F.col("due"), as_of())
    assert {r["id"]: r["vaccination_status"] for r in found.collect()} == {"a": "Overdue", "b": "Due Soon", "c": "Up to date", "d": "No records"}


def test_stock_differences_between_dashboard_and_alerts(spark):
    feed = spark.createDataFrame([("1", "Hay", "", 0.0, 5.0, "u"), ("2", "Silage", "Calves", 5.0, 5.0, "u"), ("3", "", "", None, 5.0, "u"), ("4", "Bran", "", 6.0, 5.0, "u")],
                                 "id string, feed_name string, target_animal string, quantity double, low_stock_threshold double, user_id string")
    found = {r["alert_id"]: (r["priority"], r["related_name"]) for r in alerts.stock_alerts(feed).collect()}
    assert found == {"feed-1": ("High", "Hay"), "feed-2": ("Medium", "Calves")}
    linked = alerts.linked_vaccinations(vaccinations(spark), herd(spark), flocks(spark))
    row = alerts.attention_counts(herd(spark).withColumn("health_status", F.lit("Sick")), linked, feed, as_of()).first()
    assert (row["low_feed_alerts"], row["health_alerts"], row["incomplete_profiles"], row["overdue_vaccinations"], row["due_soon_vaccinations"]) == (3, 1, 0, 1, 7)


def test_health_alert_kinds(spark):
    records = spark.createDataFrame(
        [(1, "1", "Bella", "Mastitis", "Critical"), (2, "1", "", "", "recovering"), (3, "9", "x", "y", "Sick"), (4, None, "", "", "Under Treatment"), (5, "1", "", "", "Healthy")],
        "id int, livestock_id string, animal_name string, disease_type string, recovery_status string").withColumns({"user_id": F.lit("u"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    found = alerts.health_alerts(records, herd(spark)).collect()
    assert sorted((r["alert_id"], r["priority"]) for r in found) == [
        ("follow-up-2", "Low"), ("follow-up-4", "Medium"), ("health-1", "High"), ("health-2", "Low"), ("health-4", "Medium"), ("urgent-1", "High")]
    sections = {r["kind"]: r["section"] for r in alerts.alert_sections([alerts.health_alerts(records, herd(spark))]).collect()}
    assert sections == {"health_alert": "recent", "health_urgent": "urgent", "health_follow_up": "upcoming"}


def test_latest_ties_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), ("b", 3, None, "z")], "k string, id int, t int, v string")
    found = {r["k"]: r["v"] for r in latest.latest_per_key(rows, ["k"], F.coalesce("t", F.lit(0)), "id").collect()}
    assert found == {"a": "x", "b": "z"}
    current = spark.createDataFrame([("1", "me", 1, "old"), ("2", "you", 1, "keep")], "id string, owner string, t int, v string")
    incoming = spark.createDataFrame([("1", "me", 5, "new", 1), ("1", "me", 4, "mid", 2), ("2", "me", 9, "theft", 3), ("3", "me", 1, "add", 4)],
                                     "id string, owner string, t int, v string, s int")
    result = {r["id"]: r["v"] for r in latest.owned_upsert(current, incoming, "id", "owner", F.col("t"), "s").collect()}
    assert result == {"1": "new", "2": "keep", "3": "add"}


def test_activity_feed(spark):
    found = {r["kind"]: r for r in latest.activity_feed(herd(spark), flocks(spark)).collect()}
    assert found["Livestock added"]["detail"] == "ID: T-1 • Dairy Cattle" and found["Batch created"]["detail"] == "Dairy Cattle • 12.0 recorded"


def test_split_is_exact_and_repeatable(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 100, "rare").otherwise("common").alias("s"))
    first = splits.split_assignments(rows, "s", "k", checked=True)
    counts = {(r["s"], r["split"]): r["count"] for r in first.groupBy("s", "split").count().collect()}
    assert counts == {("rare", "train"): 70, ("rare", "validation"): 15, ("rare", "test"): 15, ("common", "train"): 630, ("common", "validation"): 135, ("common", "test"): 135}
    again = splits.split_assignments(rows.repartition(7), "s", "k")
    assert first.select("k", "split").exceptAll(again.select("k", "split")).count() == 0
    other = splits.split_assignments(rows, "s", "k", seed=7)
    assert first.select("k", "split").exceptAll(other.select("k", "split")).count() > 0
    folds = splits.training_folds(first, "s", "k")
    sizes = {r["training_fold"]: r["count"] for r in folds.groupBy("training_fold").count().collect()}
    assert sizes == {i: 140 for i in range(1, 6)}
    check = splits.split_checks(first, "k").first()
    assert (check["rows"], check["duplicate_keys"], check["unassigned_rows"]) == (1000, 0, 0)


@pytest.mark.parametrize("rows, problem", [([], "empty"), ([(1, None)], "missing"), ([(1, "a"), (2, "a"), (3, "a")], "fewer than 4")])
def test_split_refusals(spark, rows, problem):
    df = spark.createDataFrame(rows, "k int, s string")
    with pytest.raises(splits.SplitError, match=problem):
        splits.split_assignments(df, "s", "k", checked=True)


def test_groups_never_cross(spark):
    sizes = [40, 1, 1, 1, 7, 7, 7, 3, 3, 3, 2, 2, 2, 2, 5, 5, 5, 5, 5, 5]
    rows = spark.createDataFrame([(f"g{g}", i) for g, n in enumerate(sizes) for i in range(n)], "g string, i int")
    assigned = splits.group_assignments(rows, "g")
    tagged = splits.apply_groups(rows, assigned, "g")
    assert all(r["passed"] for r in splits.group_checks(tagged, "g").collect())
    assert assigned.filter("partition = 'holdout'").count() == 4 and tagged.count() == sum(sizes)
    broken = tagged.withColumn("partition", F.when((F.col("g") == "g0") & (F.col("i") == 0), "holdout").otherwise("development"))
    assert not all(r["passed"] for r in splits.group_checks(broken, "g").collect())


def test_subset_and_sample_sizes(spark):
    rows = spark.range(103).select(F.col("id").alias("k"), F.when(F.col("id") < 10, "a").when(F.col("id") < 40, "b").otherwise("c").alias("s"))
    assert splits.stratified_subset(rows, "s", "k", 31).count() == 31
    assert splits.fixed_sample(rows, "k", 17).count() == 17 and splits.fixed_sample(rows, "k", 500).count() == 103


def test_manifest_findings(spark):
    manifest = spark.createDataFrame([(1, "g", "train", 1), (2, "g", "test", None), (3, "h", "train", None), (3, "h", "train", 9), (None, "i", None, None)],
                                     "k int, g string, split string, fold int")
    found = {r["check"]: r["observed"] for r in requests.manifest_integrity(manifest, "k", "split", "g", "fold", 2).collect()}
    assert found == {"DUPLICATE_KEYS": 1, "NULL_KEYS": 1, "UNASSIGNED_ROWS": 1, "GROUPS_IN_SEVERAL_SPLITS": 1, "TRAINING_ROWS_WITHOUT_FOLD": 1,
                     "OTHER_ROWS_WITH_FOLD": 0, "FOLD_OUT_OF_RANGE": 1, "EMPTY_FOLDS": 0}


def test_regression_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 5.0, -1.0), ("c", 7.0, 8.0)], "g string, y double, p double")
    found = {r["g"]: r for r in metrics.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert found["a"]["r2"] == 1.0 and found["b"]["r2"] == 0.0 and found["b"]["residual_standard_deviation"] is None
    assert found["c"]["mae"] == 3.5 and found["c"]["median_absolute_error"] == 3.5 and found["c"]["negative_prediction_count"] == 1


def test_gates(spark):
    fields = "task string, configuration_id string, is_baseline boolean, mae double, rmse double, r2 double, median_absolute_error double, mean_residual double, negative_prediction_count int, fold_mae_cv double, all_fold_r2_positive boolean"
    rows = [("t", "base", True, 1.0, 1.0, 0.0, 1.0, 0.0, 0, None, None), ("t", "good", False, 0.9, 0.9, 0.5, 1.0, 0.0, 0, 0.35, True),
            ("t", "slight", False, 0.97, 0.97, 0.5, 1.0, 0.0, 0, 0.1, True), ("t", "shaky", False, 0.9, 0.9, 0.5, 1.0, 0.0, 0, 0.36, True),
            ("t", "worse", False, 1.1, 1.1, 0.5, 1.0, 0.0, 0, 0.1, True), ("t", "wild", False, 1.1, 0.9, 0.5, 1.0, 0.0, 0, 0.9, True),
            ("t", "negative", False, 0.1, 0.1, 0.9, 1.0, 0.0, 1, 0.1, True)]
    df = spark.createDataFrame(rows, fields)
    found = {r["configuration_id"]: r["status"] for r in metrics.grouped_gate(df, ["task"]).collect()}
    assert found == {"good": "BEATS_BASELINE", "slight": "MARGINALLY_BEATS_BASELINE", "shaky": "MARGINALLY_BEATS_BASELINE",
                     "worse": "DOES_NOT_BEAT_BASELINE", "wild": "UNSTABLE", "negative": "FAILED"}
    status = metrics.retest_status(spark.createDataFrame(
        [(True, True, 1.0, 1.1, 0.06), (True, True, 1.0, 1.1, 0.04), (True, True, 1.0, 1.3, 0.5), (False, True, 1.0, 1.0, 0.5)],
        "validation_beats boolean, test_beats boolean, validation_mae double, test_mae double, gain double"))
    assert [r["status"] for r in status.collect()] == ["BEATS_BASELINE", "MARGINALLY_BEATS_BASELINE", "UNSTABLE", "DOES_NOT_BEAT_BASELINE"]
    chosen = metrics.selected(df.filter("not is_baseline"), ["task"], [F.col("rmse")], F.col("mae") < 0.05, "configuration_id").first()
    assert (chosen["selected"], chosen["best_research_configuration"], chosen["selection_status"]) == (None, "negative", "NO_CONFIGURATION_PASSED")


def test_keys_meet_in_canonical_form(spark):
    left = spark.createDataFrame([("7.0", "T0 (≤75)", "1")], "a string, t string, r string")
    right = spark.createDataFrame([("7", "t0", " 1")], "a string, t string, r string")
    key = {"k": text.composite_key(F.col("a"), F.col("t"), F.col("r"))}
    assert joins.composite_join_audit(left, right, key, key).first()["matches"] == 1


def test_guards_hold_without_reading_the_column(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    some = spark.createDataFrame([(1, 3, "x")], "k int, fold int, p string")
    for guarded in (joins.attach_fold(rows, some, "k"), mapping.attach_prediction(rows, some, "k", "p")):
        with pytest.raises(Exception, match="no fold for|row without"):
            guarded.count()
    assert joins.attach_fold(rows.filter("k = 1"), some, "k").count() == 1


def test_positions(spark):
    rows = [(i % 3, i * 7 % 50, i) for i in range(200)] + [(None, None, 900), (1, None, 901)]
    df = spark.createDataFrame(rows, "g int, t int, id int")
    found = {r["id"]: r["position"] for r in latest.numbered(df, [F.col("t").desc(), F.col("id")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert found == {r[2]: i + 1 for i, r in enumerate(want)}
    grouped = {r["id"]: r["position"] for r in latest.numbered_per_group(df, ["g"], [F.col("t").desc(), F.col("id")]).collect()}
    for g in (0, 1, 2, None):
        assert [grouped[r[2]] for r in want if r[0] == g] == list(range(1, 1 + sum(r[0] == g for r in rows)))
    assert latest.numbered(df.limit(0), [F.col("t")]).count() == 0


def test_upsert_keeps_keys_unique(spark):
    schema = "id int, owner string, t int, v string"
    current = spark.createDataFrame([(1, "a", 1, "old"), (2, "b", 1, "old")], schema)
    incoming = spark.createDataFrame([(1, "a", 2, "new"), (2, "x", 9, "stolen"), (3, "a", 5, "first"), (3, "b", 6, "later")], schema)
    found = sorted(tuple(r) for r in latest.owned_upsert(current, incoming, "id", "owner", F.col("t"), "v").collect())
    assert found == [(1, "a", 2, "new"), (2, "b", 1, "old"), (3, "b", 6, "later")]

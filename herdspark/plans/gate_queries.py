"""Acceptance gates over metric tables made from orders, and blank lines of a written file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from herdspark.operators import metrics
from herdspark.plans.registry import query, table
from herdspark.session import checkpoint_root
from herdspark.sources import tables

# Per clerk-sized group of customers one task; orders by status stand for its configurations.
METRICS_SQL = """m AS (SELECT o_custkey % 400 AS task, o_orderstatus AS configuration, round(avg(o_totalprice) / 400000, 6) AS macro_f1, round(avg(o_orderkey % 97) / 97, 6) AS balanced_accuracy,
  round(avg(o_orderkey % 89) / 89, 6) AS accuracy, count(DISTINCT o_orderpriority) AS predicted_class_count FROM orders GROUP BY 1, 2)"""


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 400).alias("task"), F.col("o_orderstatus").alias("configuration")).agg(
        F.round(F.avg("o_totalprice") / 400000, 6).alias("macro_f1"), F.round(F.avg(F.col("o_orderkey") % 97) / 97, 6).alias("balanced_accuracy"),
        F.round(F.avg(F.col("o_orderkey") % 89) / 89, 6).alias("accuracy"), F.countDistinct("o_orderpriority").alias("predicted_class_count"),
    )


@query(
    "classification_gate",
    f"""WITH {METRICS_SQL} SELECT c.task, c.configuration, coalesce(c.macro_f1 >= s.macro_f1 + 0.01::DOUBLE AND c.balanced_accuracy > s.balanced_accuracy AND c.accuracy > f.accuracy AND c.predicted_class_count > 1, false) AS beats_baseline
        FROM m c JOIN m s ON s.task = c.task AND s.configuration = 'F' JOIN m f ON f.task = c.task AND f.configuration = 'O' WHERE c.configuration = 'P'""",
)
def classification_gate(spark, sf_dir):
    kind = F.when(F.col("configuration") == "F", "stratified").when(F.col("configuration") == "O", "most_frequent")
    rows = _metrics(spark, sf_dir).withColumn("baseline", kind)
    return metrics.classification_gate(rows, ["task"]).select("task", "configuration", "beats_baseline")


@query(
    "design_gain",
    f"""WITH {METRICS_SQL} SELECT a.task, coalesce((a.macro_f1 - b.macro_f1) / nullif(a.macro_f1, 0) >= 0.01::DOUBLE AND (a.accuracy - b.accuracy) / nullif(a.accuracy, 0) >= 0.01::DOUBLE AND b.balanced_accuracy - a.balanced_accuracy >= 0.01::DOUBLE, false) AS meaningful
        FROM m a JOIN m b USING (task) WHERE a.configuration = 'F' AND b.configuration = 'O'""",
)
def design_gain(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    design = F.struct(F.col("macro_f1").alias("mae"), F.col("accuracy").alias("rmse"), F.col("balanced_accuracy").alias("r2"))
    one = rows.filter("configuration = 'F'").select("task", design.alias("a"))
    other = rows.filter("configuration = 'O'").select("task", design.alias("b"))
    return one.join(other, "task").select("task", metrics.design_gain(F.col("a"), F.col("b")).alias("meaningful"))


RETEST_SQL = """r AS (SELECT o_orderkey, o_totalprice AS vm, o_totalprice * (0.7::DOUBLE + (o_orderkey % 61) / 100.0::DOUBLE) AS tm, o_orderkey % 3 <> 0 AS vb, o_orderkey % 5 <> 0 AS tb, (o_orderkey % 11) / 100.0::DOUBLE AS gain,
  (o_orderkey % 7) / 10.0::DOUBLE AS vf, (o_orderkey % 7) / 10.0::DOUBLE + (o_orderkey % 4) / 80.0::DOUBLE AS tf FROM orders)"""


@query(
    "retest_status",
    f"""WITH {RETEST_SQL} SELECT o_orderkey, CASE WHEN NOT (vb AND tb) THEN 'DOES_NOT_BEAT_BASELINE' WHEN NOT abs(tm - vm) / greatest(vm, 1e-12::DOUBLE) <= 0.2::DOUBLE THEN 'UNSTABLE' WHEN gain < 0.05::DOUBLE THEN 'MARGINALLY_BEATS_BASELINE' ELSE 'BEATS_BASELINE' END AS amount_status,
          CASE WHEN NOT (vb AND tb) THEN 'DOES_NOT_BEAT_BASELINE' WHEN NOT abs(vf - tf) <= 0.02::DOUBLE THEN 'UNSTABLE' WHEN gain < 0.02::DOUBLE THEN 'MARGINALLY_BEATS_BASELINE' ELSE 'BEATS_BASELINE' END AS label_status FROM r""",
)
def retest_status(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", price.alias("validation_mae"), (price * (0.7 + (key % 61) / 100.0)).alias("test_mae"),
        (key % 3 != 0).alias("validation_beats"), (key % 5 != 0).alias("test_beats"), ((key % 11) / 100.0).alias("gain"),
        ((key % 7) / 10.0).alias("validation_macro_f1"), ((key % 7) / 10.0 + (key % 4) / 80.0).alias("test_macro_f1"),
    )
    amounts = metrics.retest_status(rows).withColumnRenamed("status", "amount_status")
    return metrics.retest_status(amounts, is_classification=True).select("o_orderkey", "amount_status", F.col("status").alias("label_status"))


@query("blank_lines", "SELECT count(*) AS blank_lines FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 10 <> 0 OR o_orderkey % 10 = 1")
def blank_lines(spark, sf_dir):
    """Orders written as text lines, some of them blank; the first line of each file is its header and never blank."""
    key = F.col("o_orderkey")
    blank = ((F.col("o_orderstatus") == "P") & (key % 10 != 0)) | (key % 10 == 1)
    lines = table(spark, sf_dir, "orders").select(F.when(blank, F.when(key % 2 == 0, " \t").otherwise("")).otherwise(key.cast("string")).alias("value"))
    path = f"{checkpoint_root(spark).rstrip('/')}/run-{uuid.uuid4()}/lines"
    # Each file starts with a line of its own, which counts as its header.
    headed = lines.select(F.monotonically_increasing_id().alias("at"), "value").withColumn(
        "value", F.when(F.col("at") % (1 << 33) == 0, F.concat(F.lit("header\n"), F.col("value"))).otherwise(F.col("value"))
    )
    headed.select("value").write.text(path)
    return tables.blank_lines(spark, path)

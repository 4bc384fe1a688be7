"""Record, request and dirty-value tables that Spark derives from the given ones.

Each table has a twin in SQL, used by the check texts. All rows are kept; the
variety comes from dates, statuses and amounts the data already has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdspark.plans.registry import table

AS_OF = "1998-06-15"


def as_of():
    return F.lit(AS_OF).cast("date")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with blank, padded, unknown and missing categories and odd numbers."""
    o = table(spark, sf_dir, "orders")
    day = F.dayofmonth("o_orderdate")
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice").cast("string")
    return o.select(
        "o_orderkey",
        "o_custkey",
        F.when(day == 1, "")
        .when(day == 2, F.concat(F.lit("  "), F.lower(priority), F.lit(" ")))
        .when(day == 3, "RUSH")
        .when(day == 4, F.lit(None))
        .when(day == 9, F.concat(F.lit(" "), priority))
        .otherwise(priority)
        .alias("priority"),
        F.when(day == 5, "abc")
        .when(day == 6, "inf")
        .when(day == 7, F.lit(None))
        .when(day == 8, F.concat(F.lit("-"), price))
        .when(day == 10, "0.0")
        .otherwise(price)
        .alias("price"),
        F.when(day == 11, F.lit(None)).when(day == 12, F.lit(150.0)).otherwise(F.lit(1.0) * day).alias("humidity"),
    )


DIRTY_ORDERS = """dirty AS (
  SELECT o_orderkey, o_custkey,
    CASE day(o_orderdate) WHEN 1 THEN '' WHEN 2 THEN '  ' || lower(o_orderpriority) || ' ' WHEN 3 THEN 'RUSH'
      WHEN 4 THEN NULL WHEN 9 THEN ' ' || o_orderpriority ELSE o_orderpriority END AS priority,
    CASE day(o_orderdate) WHEN 5 THEN 'abc' WHEN 6 THEN 'inf' WHEN 7 THEN NULL
      WHEN 8 THEN '-' || o_totalprice::VARCHAR WHEN 10 THEN '0.0' ELSE o_totalprice::VARCHAR END AS price,
    CASE day(o_orderdate) WHEN 11 THEN NULL WHEN 12 THEN 150.0 ELSE day(o_orderdate)::DOUBLE END AS humidity
  FROM orders)"""


def animals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.lit("T-"), F.col("c_custkey").cast("string")).alias("animal_id"),
        F.when(F.col("c_acctbal") < -900, "").otherwise(F.col("c_name")).alias("animal_name"),
        F.when(segment == "AUTOMOBILE", "cow").when(segment == "BUILDING", " Dairy  Cow ")
        .when(segment == "FURNITURE", "Cattle (Beef)").when(segment == "HOUSEHOLD", "Sheep/Goats")
        .otherwise("").alias("species"),
        segment.alias("breed"),
        F.when(F.col("c_acctbal") > 9500, "old").otherwise(F.col("c_nationkey").cast("string")).alias("age"),
        F.col("c_acctbal").cast("string").alias("weight"),
        F.date_add(F.lit("1996-01-01").cast("date"), F.col("c_nationkey") * 30).cast("timestamp").alias("created_at"),
        F.concat(F.lit("owner-"), F.col("c_nationkey").cast("string")).alias("user_id"),
    )


ANIMALS = """animals AS (
  SELECT c_custkey::VARCHAR AS id, 'T-' || c_custkey::VARCHAR AS animal_id,
    CASE WHEN c_acctbal < -900 THEN '' ELSE c_name END AS animal_name,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cow' WHEN 'BUILDING' THEN ' Dairy  Cow ' WHEN 'FURNITURE' THEN 'Cattle (Beef)'
      WHEN 'HOUSEHOLD' THEN 'Sheep/Goats' ELSE '' END AS species,
    c_mktsegment AS breed, CASE WHEN c_acctbal > 9500 THEN 'old' ELSE c_nationkey::VARCHAR END AS age,
    c_acctbal::VARCHAR AS weight, (DATE '1996-01-01' + c_nationkey * 30)::TIMESTAMP AS created_at,
    'owner-' || c_nationkey::VARCHAR AS user_id
  FROM customer)"""

DISPLAY_SPECIES_SQL = """CASE WHEN regexp_replace(lower(trim({s})), '\\s+', ' ', 'g') IN ('dairy cow', 'cow', 'cattle (dairy)')
  THEN 'Dairy Cattle' WHEN trim({s}) = '' THEN 'Unknown' ELSE trim({s}) END"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_name").alias("batch_name"),
        F.lit("cow").alias("species"),
        F.when(F.col("n_regionkey") == 2, F.lit("NaN").cast("double")).otherwise(F.col("n_nationkey") * 1.0).alias("head_count"),
        F.date_add(F.lit("1996-06-01").cast("date"), F.col("n_nationkey") * 11).cast("timestamp").alias("created_at"),
        F.concat(F.lit("owner-"), F.col("n_regionkey").cast("string")).alias("user_id"),
    )


BATCHES = """batches AS (
  SELECT 'b' || n_nationkey::VARCHAR AS id, n_name AS batch_name, 'cow' AS species,
    CASE WHEN n_regionkey = 2 THEN NULL ELSE n_nationkey::DOUBLE END AS head_count,
    (DATE '1996-06-01' + n_nationkey * 11)::TIMESTAMP AS created_at, 'owner-' || n_regionkey::VARCHAR AS user_id
  FROM nation)"""


def vaccinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    customer = F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("vaccine_name"),
        F.when(urgent, F.lit(None)).when(F.col("o_totalprice") > 450000, F.concat(F.lit("gone-"), customer))
        .otherwise(customer).alias("livestock_id"),
        F.when(urgent & (F.col("o_totalprice") > 400000), "b99")
        .when(urgent, F.concat(F.lit("b"), F.dayofmonth("o_orderdate").cast("string"))).alias("batch_id"),
        F.when(urgent, "Batch").otherwise("Individual").alias("target_type"),
        F.when(F.col("o_totalprice") < 2000, F.lit(None)).otherwise(F.to_date("o_orderdate")).alias("next_due_date"),
        F.concat(F.lit("owner-"), F.floor(F.col("o_custkey") / 100).cast("string")).alias("user_id"),
    )


VACCINATIONS = """vaccinations AS (
  SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS vaccine_name,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_totalprice > 450000 THEN 'gone-' || o_custkey::VARCHAR
      ELSE o_custkey::VARCHAR END AS livestock_id,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'b99'
      WHEN o_orderpriority = '1-URGENT' THEN 'b' || day(o_orderdate)::VARCHAR END AS batch_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Batch' ELSE 'Individual' END AS target_type,
    CASE WHEN o_totalprice < 2000 THEN NULL ELSE o_orderdate::DATE END AS next_due_date,
    'owner-' || floor(o_custkey / 100)::BIGINT::VARCHAR AS user_id
  FROM orders)"""

LINKED = """linked AS (
  SELECT v.*, a.id AS animal__id, a.animal_id AS animal__animal_id, a.animal_name AS animal__animal_name,
    b.id AS batch__id, b.batch_name AS batch__batch_name
  FROM vaccinations v LEFT JOIN animals a ON v.livestock_id = a.id LEFT JOIN batches b ON v.batch_id = b.id
  WHERE (v.livestock_id IS NULL OR a.id IS NOT NULL) AND (v.batch_id IS NULL OR b.id IS NOT NULL))"""


def health_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("value") > 150, F.lit(None)).when(F.col("value") > 120, "nobody")
        .otherwise(F.col("user_id").cast("string")).alias("livestock_id"),
        F.when(F.col("value") < 5, F.concat(F.lit("T-"), F.col("user_id").cast("string"))).alias("animal_ref"),
        F.lit("").alias("animal_name"),
        F.when(kind == "click", "Mastitis").otherwise("").alias("disease_type"),
        F.when(kind == "error", "Critical").when(kind == "click", " sick ").when(kind == "view", "recovering")
        .when(kind == "signup", "").otherwise("In Treatment").alias("recovery_status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("owner-"), F.floor(F.col("user_id") / 10).cast("string")).alias("user_id"),
    )


HEALTH = """health AS (
  SELECT event_id AS id, CASE WHEN value > 150 THEN NULL WHEN value > 120 THEN 'nobody' ELSE user_id::VARCHAR END AS livestock_id,
    CASE WHEN value < 5 THEN 'T-' || user_id::VARCHAR END AS animal_ref, '' AS animal_name,
    CASE WHEN event_type = 'click' THEN 'Mastitis' ELSE '' END AS disease_type,
    CASE event_type WHEN 'error' THEN 'Critical' WHEN 'click' THEN ' sick ' WHEN 'view' THEN 'recovering'
      WHEN 'signup' THEN '' ELSE 'In Treatment' END AS recovery_status,
    ts AS created_at, 'owner-' || floor(user_id / 10)::BIGINT::VARCHAR AS user_id
  FROM events)"""

HEALTH_FOLD_SQL = """CASE lower(trim({s})) WHEN 'critical' THEN 'Critical' WHEN 'sick' THEN 'Sick' WHEN 'in treatment' THEN 'Under Treatment'
  WHEN 'under treatment' THEN 'Under Treatment' WHEN 'quarantined' THEN 'Under Treatment' WHEN 'recovering' THEN 'Recovering'
  WHEN 'recovered' THEN 'Healthy' WHEN 'healthy' THEN 'Healthy' ELSE 'Healthy' END"""


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(size == 7, " ").otherwise(F.col("p_name")).alias("feed_name"),
        F.when(size == 1, F.lit(0.0)).when(size == 50, F.lit("NaN").cast("double")).otherwise(size * 1.0).alias("quantity"),
        F.when(F.col("p_type") == "ECONOMY", "bags").when(F.col("p_type") == "SMALL", "").otherwise("kg").alias("unit"),
        F.when(size == 2, F.lit(None)).otherwise(F.length("p_name") * 1.0).alias("low_stock_threshold"),
        F.when(F.col("p_type") == "SMALL", "Calves").otherwise("").alias("target_animal"),
        F.concat(F.lit("owner-"), F.regexp_extract("p_brand", r"(\d+)$", 1)).alias("user_id"),
    )


FEED = """feed AS (
  SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size = 7 THEN ' ' ELSE p_name END AS feed_name,
    CASE WHEN p_size = 1 THEN 0.0 WHEN p_size = 50 THEN NULL ELSE p_size::DOUBLE END AS quantity,
    CASE p_type WHEN 'ECONOMY' THEN 'bags' WHEN 'SMALL' THEN '' ELSE 'kg' END AS unit,
    CASE WHEN p_size = 2 THEN NULL ELSE length(p_name)::DOUBLE END AS low_stock_threshold,
    CASE WHEN p_type = 'SMALL' THEN 'Calves' ELSE '' END AS target_animal,
    'owner-' || regexp_extract(p_brand, '(\\d+)$', 1) AS user_id
  FROM part)"""


def climate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as animals: temperature, humidity, weight, yield and stage."""
    li = table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_tax") == 0.08, F.lit(None)).otherwise(F.col("l_quantity")).alias("temperature"),
        F.when(F.col("l_tax") == 0.07, F.lit(None)).when(F.col("l_tax") == 0.06, F.lit(100.5))
        .otherwise(F.round(F.col("l_discount") * 1000, 0)).alias("humidity"),
        F.when(flag == "A", "Early-Lactation").when(flag == "N", "mid_lactation  ").otherwise(
            F.when(status == "O", "Late Lactation").otherwise("Dry")).alias("stage"),
        F.when(F.col("l_linenumber") == 1, "Local").when(F.col("l_linenumber") == 2, "HF50")
        .when(F.col("l_linenumber") == 3, "HF62.5").when(F.col("l_linenumber") == 4, " ")
        .when(F.col("l_linenumber") == 5, "HF99").otherwise("HF75").alias("genetic_group"),
        F.when(F.col("l_tax") == 0.05, F.lit(None)).otherwise(F.col("l_extendedprice") / 100).alias("weight"),
        F.when(F.col("l_tax") == 0.04, F.lit(-1.0)).otherwise(F.col("l_quantity")).alias("milk"),
        F.when(F.col("l_discount") == 0.0, F.lit(0.0)).otherwise(F.col("l_discount") * 200).alias("prediction"),
        F.when(flag == "A", "Under_Treatment").when(flag == "N", "Healthy").otherwise("").alias("health"),
    )


CLIMATE = """climate AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_tax = 0.08 THEN NULL ELSE l_quantity END AS temperature,
    CASE WHEN l_tax = 0.07 THEN NULL WHEN l_tax = 0.06 THEN 100.5 ELSE round(l_discount * 1000, 0) END AS humidity,
    CASE WHEN l_returnflag = 'A' THEN 'Early-Lactation' WHEN l_returnflag = 'N' THEN 'mid_lactation  '
      WHEN l_linestatus = 'O' THEN 'Late Lactation' ELSE 'Dry' END AS stage,
    CASE l_linenumber WHEN 1 THEN 'Local' WHEN 2 THEN 'HF50' WHEN 3 THEN 'HF62.5' WHEN 4 THEN ' ' WHEN 5 THEN 'HF99' ELSE 'HF75' END AS genetic_group,
    CASE WHEN l_tax = 0.05 THEN NULL ELSE l_extendedprice / 100 END AS weight,
    CASE WHEN l_tax = 0.04 THEN -1.0 ELSE l_quantity END AS milk,
    CASE WHEN l_discount = 0.0 THEN 0.0 ELSE l_discount * 200 END AS prediction,
    CASE l_returnflag WHEN 'A' THEN 'Under_Treatment' WHEN 'N' THEN 'Healthy' ELSE '' END AS health
  FROM lineitem)"""


def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with stored results, some of them rounded, wrong or missing."""
    li = table(spark, sf_dir, "lineitem")
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    net = price * (F.lit(1.0) - discount)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("daysinmilk"),
        price.alias("price"),
        F.when(tax == 0.01, F.lit(None)).otherwise(discount).alias("discount"),
        tax.alias("tax"),
        F.when(F.col("l_linenumber") == 7, net + 5).when(F.col("l_linenumber") == 6, F.lit(None))
        .when(F.col("l_linenumber") == 5, net + 0.004).otherwise(net).alias("disc price"),
        F.when(F.col("l_quantity") <= 10, "Peak").when(F.col("l_quantity") <= 30, " mid ").otherwise("Late").alias("period"),
        F.try_divide(price, discount).alias("ratio"),
        (discount * 100 - 4).alias("left.over"),
        (price + 4 - discount * 100).alias("stored_capacity"),
    )


FORMULAS = """formulas AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS daysinmilk, l_extendedprice AS price,
    CASE WHEN l_tax = 0.01 THEN NULL ELSE l_discount END AS discount, l_tax AS tax,
    CASE l_linenumber WHEN 7 THEN l_extendedprice * (1.0::DOUBLE - l_discount) + 5 WHEN 6 THEN NULL
      WHEN 5 THEN l_extendedprice * (1.0::DOUBLE - l_discount) + 0.004::DOUBLE ELSE l_extendedprice * (1.0::DOUBLE - l_discount) END AS disc_price,
    CASE WHEN l_quantity <= 10 THEN 'Peak' WHEN l_quantity <= 30 THEN ' mid ' ELSE 'Late' END AS period,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS ratio,
    l_discount * 100 - 4 AS left_over, l_extendedprice + 4 - l_discount * 100 AS stored_capacity
  FROM lineitem)"""

"""Heat index, eligibility, ration, stock, request, formula and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdspark.functions import values
from herdspark.operators import catalogue, formulas, mapping, profile, requests, rules
from herdspark.plans import derived as d
from herdspark.plans.registry import query, table
from herdspark.plans.summary_queries import rounded

HEAT = f"""{d.CLIMATE}, h0 AS (SELECT *, (1.8::DOUBLE * temperature + 32) - ((0.55::DOUBLE - 0.0055::DOUBLE * humidity) * (1.8::DOUBLE * temperature - 26)) AS raw,
    CASE WHEN temperature IS NULL THEN 'TEMPERATURE_MISSING' WHEN humidity IS NULL THEN 'HUMIDITY_MISSING' WHEN humidity < 0 OR humidity > 100 THEN 'HUMIDITY_OUT_OF_RANGE' END AS error FROM climate),
  heat AS (SELECT *, CASE WHEN error LIKE '%MISSING' THEN 'MISSING_REQUIRED_INPUT' WHEN error IS NOT NULL THEN 'INVALID_ENVIRONMENT_INPUT' ELSE 'ELIGIBLE' END AS heat_status,
    CASE WHEN error IS NULL THEN CASE WHEN raw <= 75 THEN 'T0' WHEN raw < 80 THEN 'T1' ELSE 'T2' END END AS category, CASE WHEN error IS NULL THEN raw END AS calculated FROM h0)"""


def _heat(spark, sf_dir):
    return rules.with_heat(d.climate_lines(spark, sf_dir), F.col("temperature"), F.col("humidity"))


@query(
    "heat_index",
    f"""WITH {HEAT} SELECT l_orderkey, l_linenumber, heat_status AS status, round(calculated, 4) AS calculated, category, error FROM heat""",
)
def heat_index(spark, sf_dir):
    return _heat(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.col("heat_status").alias("status"), F.round("heat_index", 4).alias("calculated"),
        F.col("heat_class").alias("category"), F.col("heat_error").alias("error"),
    )


@query(
    "heat_classes",
    """SELECT l_quantity AS value, CASE WHEN l_quantity + 40 <= 75 THEN 'T0' WHEN l_quantity + 40 < 80 THEN 'T1' ELSE 'T2' END AS class, count(*) AS rows FROM lineitem GROUP BY 1, 2""",
)
def heat_classes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_quantity").alias("value"), rules.interval_class(F.col("l_quantity") + 40).alias("class")
    ).agg(F.count(F.lit(1)).alias("rows"))


STAGE = "trim(regexp_replace(regexp_replace(lower(stage), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
GATE = f"""{HEAT}, gate AS (SELECT *, CASE WHEN {STAGE} NOT IN ('early lactation', 'mid lactation', 'late lactation') THEN 1 WHEN trim(genetic_group) = '' THEN 2
    WHEN heat_status <> 'ELIGIBLE' THEN 3 WHEN genetic_group NOT IN ('Local', 'HF50', 'HF62.5', 'HF75', 'HF87.5') THEN 4 WHEN genetic_group = 'Local' THEN 5 ELSE 6 END AS g FROM heat),
  eligible AS (SELECT *, CASE g WHEN 1 THEN 'OUT_OF_SCOPE_POPULATION' WHEN 2 THEN 'MISSING_REQUIRED_INPUT' WHEN 3 THEN heat_status WHEN 4 THEN 'UNKNOWN_GENETIC_GROUP' ELSE 'ELIGIBLE' END AS status,
    CASE g WHEN 1 THEN 'OUT_OF_SCOPE' WHEN 4 THEN 'OUT_OF_SCOPE' WHEN 5 THEN 'LIMITED_SUPPORT' WHEN 6 THEN 'IN_SCOPE' ELSE 'UNRESOLVED' END AS scope,
    CASE WHEN g = 1 THEN 'POPULATION_OUT_OF_SCOPE' WHEN g = 2 THEN 'GENETIC_GROUP_MISSING' WHEN g = 3 AND heat_status = 'MISSING_REQUIRED_INPUT' THEN 'ENVIRONMENT_MISSING' WHEN g = 3 THEN 'ENVIRONMENT_INVALID' WHEN g = 4 THEN 'GENETIC_GROUP_UNKNOWN' END AS reason,
    CASE g WHEN 1 THEN 'POPULATION_SCOPE' WHEN 2 THEN 'BREED_NOT_USED' WHEN 4 THEN 'BREED_NOT_USED' WHEN 5 THEN 'LOCAL_LIMITED' ELSE '' END AS warnings FROM gate)"""


def gated(spark, sf_dir):
    return rules.with_eligibility(_heat(spark, sf_dir), F.col("stage"), F.col("genetic_group"))


@query("eligibility_gate", f"WITH {GATE} SELECT l_orderkey, l_linenumber, status, scope, reason, warnings FROM eligible")
def eligibility_gate(spark, sf_dir):
    return gated(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.col("eligibility").alias("status"), "scope", F.col("fallback_reason").alias("reason"),
        F.array_join("eligibility_warnings", ",").alias("warnings"),
    )


PLAN = f"""{d.CLIMATE}, p0 AS (SELECT l_orderkey, l_linenumber, coalesce(weight <= 0, true) AS wbad, coalesce(milk < 0, true) AS mbad, coalesce(prediction <= 0, true) AS pbad,
    CASE WHEN coalesce(weight <= 0, true) THEN 400.0::DOUBLE ELSE weight END AS w, CASE WHEN coalesce(milk < 0, true) THEN 0.0::DOUBLE ELSE milk END AS m, prediction AS p, health, stage FROM climate),
  p1 AS (SELECT * EXCLUDE (p), CASE WHEN pbad THEN w * 0.025::DOUBLE ELSE p END AS p, w * 0.015::DOUBLE AS lo, w * 0.04::DOUBLE AS hi, CASE WHEN m < 5 THEN 0.25::DOUBLE WHEN m <= 15 THEN 0.35::DOUBLE WHEN m <= 25 THEN 0.40::DOUBLE ELSE 0.45::DOUBLE END AS cs,
    health = 'Under_Treatment' AS review, health = '' AS unknown FROM p0),
  p2 AS (SELECT *, greatest(least(p, hi), lo) AS total FROM p1),
  plan AS (SELECT l_orderkey, l_linenumber, total AS total_feed_kg, total * (1 - cs) + CASE WHEN review THEN total * cs * 0.1::DOUBLE ELSE 0 END AS roughage_kg,
    total * cs - CASE WHEN review THEN total * cs * 0.1::DOUBLE ELSE 0 END AS concentrate_kg, CASE WHEN w < 350 THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END AS mineral_mix_kg, CASE WHEN m > 25 THEN 3 ELSE 2 END AS feedings_per_day,
    CASE WHEN wbad OR mbad OR pbad OR unknown OR review OR p < lo OR p > hi THEN 'Low' ELSE 'Moderate' END AS confidence_level,
    array_to_string(list_filter([CASE WHEN wbad THEN 'WEIGHT_DEFAULTED' END, CASE WHEN mbad THEN 'MILK_TREATED_AS_ZERO' END, CASE WHEN pbad THEN 'PREDICTION_REPLACED_BY_WEIGHT_RULE' END,
      CASE WHEN p < lo THEN 'RAISED_TO_MINIMUM' WHEN p > hi THEN 'REDUCED_TO_MAXIMUM' END, CASE WHEN review THEN 'HEALTH_REVIEW_SHIFT' WHEN unknown THEN 'HEALTH_UNKNOWN' END], lambda x: x IS NOT NULL), ',') AS plan_warnings FROM p2)"""


def _planned(spark, sf_dir, digits=2):
    rows = d.climate_lines(spark, sf_dir)
    return rules.with_feed_plan(
        rows, F.col("prediction"), F.col("weight"), F.col("milk"), F.col("health"), F.col("stage"), digits
    )


@query(
    "ration_plan",
    f"""WITH {PLAN} SELECT confidence_level, plan_warnings, mineral_mix_kg, feedings_per_day, count(*) AS rows, round(sum(total_feed_kg), 4) AS total_feed_kg,
        round(sum(roughage_kg), 4) AS roughage_kg, round(sum(concentrate_kg), 4) AS concentrate_kg FROM plan GROUP BY 1, 2, 3, 4""",
)
def ration_plan(spark, sf_dir):
    rows = _planned(spark, sf_dir, None).withColumn("plan_warnings", F.array_join("plan_warnings", ","))
    return rows.groupBy("confidence_level", "plan_warnings", "mineral_mix_kg", "feedings_per_day").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.round(F.sum(c), 4).alias(c) for c in ("total_feed_kg", "roughage_kg", "concentrate_kg")],
    )


@query("ration_explanations")
def ration_explanations(spark, sf_dir):
    return _planned(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode("explanation").alias("line"))


@query(
    "base_ration",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / 100 * 0.025 + l_quantity * 0.3, 3) AS base_feed_kg FROM lineitem""",
)
def base_ration(spark, sf_dir):
    feed = rules.base_ration(F.col("l_extendedprice") / 100, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(feed, 3).alias("base_feed_kg"))


@query(
    "stock_levels",
    f"""WITH {d.FEED}, s AS (SELECT *, coalesce(quantity, 0) AS q, coalesce(low_stock_threshold, 0) AS t FROM feed)
        SELECT id, CASE WHEN q <= 0 THEN 'Out of Stock' WHEN q <= t THEN 'Low' WHEN q <= t * 2 THEN 'Medium' ELSE 'High' END AS stock_level FROM s""",
)
def stock_levels(spark, sf_dir):
    return d.feed_items(spark, sf_dir).select(
        "id", rules.stock_level(F.col("quantity"), F.col("low_stock_threshold")).alias("stock_level")
    )


ADJUST = f"""{d.FEED}, a AS (SELECT id, quantity, CASE WHEN trim(unit) = 'bags' THEN 1.0 ELSE 100.0 END AS k,
  CASE target_animal WHEN 'Calves' THEN 'restock' ELSE CASE WHEN quantity > 25 THEN 'increase' WHEN quantity = 25 THEN 'discard' ELSE 'decrease' END END AS op,
  CASE WHEN quantity = 10 THEN 999999.0 WHEN quantity = 11 THEN 0.0 ELSE low_stock_threshold END AS amount FROM feed),
  n AS (SELECT *, CASE op WHEN 'restock' THEN quantity + amount WHEN 'increase' THEN quantity * (1 + 0.1::DOUBLE) ELSE quantity * (1 - 0.1::DOUBLE) END AS raw FROM a),
  r AS (SELECT *, floor((raw + 2.220446049250313e-16) * k + 0.5) / k AS new FROM n)"""


@query(
    "stock_adjustments",
    f"""WITH {ADJUST}, e AS (SELECT *, CASE WHEN op = 'discard' THEN 'UNKNOWN_OPERATION' WHEN quantity IS NULL OR quantity < 0 THEN 'STOCK_INVALID'
          WHEN op = 'restock' AND (amount IS NULL OR amount <= 0) THEN 'AMOUNT_INVALID' WHEN new > 1000000 THEN 'ABOVE_MAXIMUM' END AS error FROM r)
        SELECT id, op, CASE WHEN error IS NULL THEN new END AS new_quantity, error FROM e""",
)
def stock_adjustments(spark, sf_dir):
    q = F.col("quantity")
    op = F.when(F.col("target_animal") == "Calves", "restock").when(q.isNull() | F.isnan(q), "decrease").when(
        q > 25, "increase").when(q == 25, "discard").otherwise("decrease")
    amount = F.when(q == 10, 999999.0).when(q == 11, 0.0).otherwise(F.col("low_stock_threshold"))
    rows = d.feed_items(spark, sf_dir).select("id", "unit", "quantity", op.alias("op"), amount.alias("amount"))
    new = rules.adjusted_stock(F.col("quantity"), F.col("op"), F.col("amount"), F.col("unit"))
    return rows.withColumn("n", new).select("id", "op", F.col("n.quantity").alias("new_quantity"), "n.error")


@query(
    "rounded_quantities",
    """SELECT l_orderkey, l_linenumber, floor((l_extendedprice / 7 + 2.220446049250313e-16) * k + 0.5) / k AS quantity FROM
       (SELECT *, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 100.0 END AS k FROM lineitem)""",
)
def rounded_quantities(spark, sf_dir):
    unit = F.when(F.col("l_returnflag") == "A", " Bags ").otherwise("kg")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", values.round_quantity(F.col("l_extendedprice") / 7, unit, rules.WHOLE_UNITS).alias("quantity")
    )


@query(
    "interval_bands",
    """SELECT CASE WHEN l_extendedprice <= 20000 THEN 'low' WHEN l_extendedprice <= 60000 THEN 'middle' WHEN l_extendedprice <= 100000 THEN 'high' END AS band, count(*) AS rows FROM lineitem GROUP BY 1""",
)
def interval_bands(spark, sf_dir):
    band = values.interval_label(F.col("l_extendedprice"), (float("-inf"), 20000, 60000, 100000), ("low", "middle", "high"))
    return table(spark, sf_dir, "lineitem").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "guarded_predictions",
    """SELECT l_orderkey, l_linenumber, CASE WHEN e IS NULL THEN v END AS value, e AS error FROM (SELECT *, CASE WHEN v IS NULL OR isinf(v) THEN 'NOT_FINITE' WHEN v < 0 THEN 'NEGATIVE' WHEN v NOT BETWEEN 3 AND 25 THEN 'OUT_OF_RANGE' END AS e FROM
       (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE l_quantity - 10 END AS v FROM lineitem))""",
)
def guarded_predictions(spark, sf_dir):
    value = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity") - 10)
    rows = table(spark, sf_dir, "lineitem").withColumn("g", rules.guarded_prediction(value, 3.0, 25.0))
    return rows.select("l_orderkey", "l_linenumber", "g.value", "g.error")


SCORED = f"""{GATE}, s AS (SELECT *, CASE WHEN status = 'ELIGIBLE' AND milk BETWEEN 5 AND 40 THEN milk END AS milk_value, CASE WHEN status = 'ELIGIBLE' AND weight BETWEEN 100 AND 900 THEN weight * 0.02 END AS intake FROM eligible),
  st AS (SELECT *, CASE WHEN milk_value IS NOT NULL AND intake IS NOT NULL THEN 'ELIGIBLE' WHEN milk_value IS NOT NULL OR intake IS NOT NULL THEN 'PARTIAL' ELSE 'FALLBACK_REQUIRED' END AS prediction_status,
    CASE WHEN reason IS NOT NULL THEN reason WHEN milk_value IS NULL OR intake IS NULL THEN 'MODEL_ERROR' END AS why FROM s)"""


def _scored(spark, sf_dir):
    rows = gated(spark, sf_dir)
    ok = F.col("eligibility") == "ELIGIBLE"
    rows = rows.withColumns(
        {
            "milk_value": F.when(ok, rules.guarded_prediction(F.col("milk"), 5, 40)["value"]),
            "intake": F.when(ok, rules.guarded_prediction(F.col("weight"), 100, 900)["value"] * 0.02),
        }
    )
    failed = F.when(ok & (F.col("milk_value").isNull() | F.col("intake").isNull()), "MODEL_ERROR")
    rows = rows.withColumn("reasons", values.present([F.col("fallback_reason"), failed]))
    return rows.withColumn("prediction_status", rules.scoring_status([F.col("milk_value"), F.col("intake")]))


@query(
    "scoring_status",
    f"""WITH {SCORED} SELECT prediction_status, coalesce(why, '') AS reasons, CASE WHEN prediction_status = 'ELIGIBLE' THEN 'AVAILABLE' WHEN prediction_status = 'PARTIAL' THEN 'PARTLY_AVAILABLE'
          WHEN why IN ('GENETIC_GROUP_MISSING', 'GENETIC_GROUP_UNKNOWN') THEN 'NEEDS_GENETIC_GROUP' WHEN why IN ('ENVIRONMENT_MISSING', 'ENVIRONMENT_INVALID', 'THI_CATEGORY_UNKNOWN') THEN 'NEEDS_ENVIRONMENT'
          WHEN why = 'POPULATION_OUT_OF_SCOPE' THEN 'OUT_OF_SCOPE' ELSE 'MODEL_UNAVAILABLE' END AS message, count(*) AS rows FROM st GROUP BY 1, 2, 3""",
)
def scoring_status(spark, sf_dir):
    message = rules.status_message(F.col("prediction_status"), F.col("reasons"))
    return _scored(spark, sf_dir).groupBy(
        "prediction_status", F.array_join("reasons", ",").alias("reasons"), message.alias("message")
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "advisory_warnings",
    f"""WITH {SCORED}, w AS (SELECT CASE WHEN intake IS NULL AND milk_value IS NULL THEN '' ELSE
          CASE WHEN genetic_group = 'Local' THEN 'BD_LOCAL_LIMITED,' ELSE '' END || CASE WHEN intake IS NOT NULL THEN 'BD_DMI_DRY_MATTER,' ELSE '' END
          || 'BD_RESEARCH_SCOPE,BD_CANDIDATE_ONLY,BD_EXTERNAL_VALIDATION_MISSING,ADVISORY_ONLY,BD_TWO_FEATURE_MODEL,BD_RULE_OWNERSHIP,BD_NO_RATION_LABELS' || CASE WHEN milk_value IS NOT NULL THEN ',BD_MILK_DAILY' ELSE '' END END
          || CASE WHEN intake IS NULL AND milk_value IS NULL AND scope = 'LIMITED_SUPPORT' THEN 'BD_LOCAL_LIMITED' ELSE '' END AS codes FROM st) SELECT codes, count(*) AS rows FROM w GROUP BY 1""",
)
def advisory_warnings(spark, sf_dir):
    codes = rules.catalogue_warnings(F.col("intake"), F.col("milk_value"), F.array(F.col("scope")))
    return _scored(spark, sf_dir).groupBy(F.array_join(codes, ",").alias("codes")).agg(F.count(F.lit(1)).alias("rows"))


RAW_INPUTS = """raw AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN ' ' ELSE l_returnflag END AS breed, CASE WHEN l_tax = 0.01 THEN 'old' ELSE l_quantity::BIGINT::VARCHAR END AS age,
  CASE WHEN l_tax = 0.02 THEN '' ELSE l_extendedprice::VARCHAR END AS weight, l_linestatus AS stage, CASE WHEN l_tax = 0.03 THEN NULL ELSE l_discount END AS humidity FROM lineitem)"""


@query(
    "model_input_fill",
    f"""WITH {RAW_INPUTS}, e AS (SELECT *, array_to_string(list_filter([CASE WHEN trim(breed) = '' THEN 'breed' END, CASE WHEN weight = '' THEN 'weightKg' END], lambda x: x IS NOT NULL), ', ') AS missing FROM raw)
        SELECT l_orderkey, l_linenumber, nullif(trim(breed), '') AS "Breed", TRY_CAST(age AS DOUBLE) AS "Age_Months", TRY_CAST(nullif(weight, '') AS DOUBLE) AS "Weight_kg", stage AS "Lactation_Stage", 0.0::DOUBLE AS "Days_in_Milk",
          28.0::DOUBLE AS "Ambient_Temperature_C", coalesce(humidity, 70.0::DOUBLE) AS "Humidity_percent", 0.0::DOUBLE AS "Previous_Week_Avg_Yield", 3.0::DOUBLE AS "Body_Condition_Score",
          CASE WHEN missing <> '' THEN 'MISSING: ' || missing WHEN age = 'old' THEN 'NOT_NUMERIC: ageMonths' END AS input_error FROM e""",
)
def model_input_fill(spark, sf_dir):
    tax = F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, " ").otherwise(F.col("l_returnflag")).alias("breed"),
        F.when(tax == 0.01, "old").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("ageMonths"),
        F.when(tax == 0.02, "").otherwise(F.col("l_extendedprice").cast("string")).alias("weightKg"),
        F.col("l_linestatus").alias("lactationStage"),
        F.when(tax == 0.03, F.lit(None)).otherwise(F.col("l_discount")).alias("humidityPercent"),
    )
    return rules.model_inputs(rows, ["l_orderkey", "l_linenumber"])


REQUEST_JSON = """req AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_tax, l_discount, l_quantity, CASE WHEN l_tax = 0.08 THEN '{"breed": ' ELSE
  '{' || CASE WHEN l_tax = 0.07 THEN '' ELSE '"breed": ' || CASE WHEN l_tax = 0.06 THEN '7' WHEN l_tax = 0.05 THEN '"  "' ELSE '"Gir"' END || ', ' END
  || '"age_months": ' || CASE l_linenumber WHEN 1 THEN '12.5' WHEN 2 THEN '0' ELSE l_quantity::BIGINT::VARCHAR END || ', "weight_kg": ' || CASE l_returnflag WHEN 'A' THEN 'true' ELSE '410.5' END
  || ', "lactation_stage": "Early", "body_condition_score": ' || CASE WHEN l_discount = 0.1 THEN '5.5' WHEN l_discount = 0 THEN 'null' ELSE '3' END
  || CASE WHEN l_linestatus = 'O' THEN ', "extra": 1' ELSE '' END || '}' END AS body FROM lineitem)"""


@query(
    "request_validation",
    f"""WITH {REQUEST_JSON}, m AS (SELECT l_orderkey, l_linenumber, l_tax = 0.08 AS broken, list_filter([
          CASE WHEN l_linestatus = 'O' THEN 'extra=Unexpected field.' END, CASE WHEN l_tax = 0.07 THEN 'breed=Required field is missing.' WHEN l_tax = 0.06 THEN 'breed=Must be a string.' WHEN l_tax = 0.05 THEN 'breed=Must not be empty.' END,
          CASE l_linenumber WHEN 1 THEN 'age_months=Must be an integer.' WHEN 2 THEN 'age_months=Must be greater than zero.' END, CASE WHEN l_returnflag = 'A' THEN 'weight_kg=Must be a finite number.' END,
          CASE WHEN l_discount = 0.1 THEN 'body_condition_score=Must be from 1 through 5.' END], lambda x: x IS NOT NULL) AS e FROM req),
        c AS (SELECT *, array_to_string(list_sort(e), ';') AS t FROM m)
        SELECT l_orderkey, l_linenumber, CASE WHEN broken THEN NULL ELSE t END AS errors, CASE WHEN broken THEN 'INVALID_JSON' WHEN t = '' THEN NULL WHEN t LIKE '%Required field%' THEN 'MISSING_REQUIRED_FIELD'
          WHEN t LIKE '%string%' OR t LIKE '%integer%' OR t LIKE '%finite%' OR t LIKE '%Unexpected%' THEN 'INVALID_FIELD_TYPE' ELSE 'INVALID_FIELD_RANGE' END AS error_code, NOT broken AND t = '' AS valid FROM c""",
)
def request_validation(spark, sf_dir):
    tax, line = F.col("l_tax"), F.col("l_linenumber")
    breed = F.when(tax == 0.06, "7").when(tax == 0.05, '"  "').otherwise('"Gir"')
    body = F.concat(
        F.lit("{"), F.when(tax == 0.07, "").otherwise(F.concat(F.lit('"breed": '), breed, F.lit(", "))),
        F.lit('"age_months": '), F.when(line == 1, "12.5").when(line == 2, "0").otherwise(F.col("l_quantity").cast("bigint").cast("string")),
        F.lit(', "weight_kg": '), F.when(F.col("l_returnflag") == "A", "true").otherwise("410.5"),
        F.lit(', "lactation_stage": "Early", "body_condition_score": '),
        F.when(F.col("l_discount") == 0.1, "5.5").when(F.col("l_discount") == 0, "null").otherwise("3"),
        F.when(F.col("l_linestatus") == "O", ', "extra": 1').otherwise(""), F.lit("}"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(tax == 0.08, '{"breed": ').otherwise(body).alias("body"))
    checked = requests.validate_requests(rows, "body", ["l_orderkey", "l_linenumber"])
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return checked.withColumn("errors", shown)


@query(
    "missing_prediction_fields",
    """SELECT CASE WHEN l_tax = 0.01 THEN 'total_feed_kg,' ELSE '' END || CASE WHEN l_discount = 0 THEN 'roughage_kg,' ELSE '' END || 'crude_protein_requirement,energy_requirement' AS missing, count(*) AS rows FROM lineitem GROUP BY 1""",
)
def missing_prediction_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_tax") != 0.01, F.col("l_quantity")).alias("total_feed_kg"), F.col("l_quantity").alias("dry_matter_intake_kg"),
        F.col("l_tax").alias("concentrate_kg"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("roughage_kg"),
    )
    return rows.groupBy(F.array_join(requests.missing_fields(rows), ",").alias("missing")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "restock_quantities",
    """WITH t AS (SELECT p_partkey, p_type, CASE WHEN p_size = 1 THEN ' ' WHEN p_size = 2 THEN '12kg' WHEN p_size = 3 THEN '-4' WHEN p_size = 4 THEN '1000000.5' WHEN p_size = 5 THEN '1.234' WHEN p_size = 6 THEN '+7.' ELSE p_size::VARCHAR || '.5' END AS q FROM part),
       e AS (SELECT *, CASE WHEN trim(q) = '' THEN 'QUANTITY_MISSING' WHEN q = '12kg' THEN 'NOT_NUMERIC' WHEN q::DOUBLE <= 0 THEN 'NOT_POSITIVE' WHEN q::DOUBLE > 1000000 THEN 'ABOVE_MAXIMUM'
         WHEN p_type = 'ECONOMY' AND (length(split_part(q, '.', 2)) > 0) THEN 'WHOLE_NUMBER_NEEDED' WHEN p_type <> 'ECONOMY' AND length(split_part(q, '.', 2)) > 2 THEN 'TOO_MANY_DECIMALS' END AS error FROM t)
       SELECT p_partkey, CASE WHEN error IS NULL THEN round(q::DOUBLE, 2) END AS value, error FROM e""",
)
def restock_quantities(spark, sf_dir):
    size = F.col("p_size")
    raw = (
        F.when(size == 1, " ").when(size == 2, "12kg").when(size == 3, "-4").when(size == 4, "1000000.5").when(size == 5, "1.234")
        .when(size == 6, "+7.").otherwise(F.concat(size.cast("string"), F.lit(".5")))
    )
    unit = F.when(F.col("p_type") == "ECONOMY", "Bales").otherwise("kg")
    rows = table(spark, sf_dir, "part").withColumn("r", requests.restock_quantity(raw, unit))
    return rows.select("p_partkey", "r.value", "r.error")


@query(
    "livestock_edits",
    f"""WITH {d.ANIMALS}, t AS (SELECT *, CASE WHEN breed = 'MACHINERY' THEN strftime(created_at, '%Y-%m-%d') WHEN breed = 'HOUSEHOLD' THEN 'soon' ELSE ' ' END AS born FROM animals),
        a AS (SELECT *, CASE WHEN trim(born) = '' THEN TRY_CAST(age AS DOUBLE) WHEN born = 'soon' THEN NULL ELSE greatest(0, (1998 - year(created_at)) * 12 + 6 - month(created_at) - CASE WHEN 15 < day(created_at) THEN 1 ELSE 0 END) END AS months FROM t),
        e AS (SELECT *, CASE WHEN trim(animal_id) = '' OR trim(animal_name) = '' OR trim(species) = '' OR trim(breed) = '' THEN 'REQUIRED_TEXT_MISSING' WHEN months IS NULL OR months < 0 THEN 'AGE_INVALID' WHEN weight::DOUBLE <= 0 THEN 'WEIGHT_INVALID' END AS error FROM a)
        SELECT id, CASE WHEN error IS NULL THEN months::DOUBLE END AS age, CASE WHEN error IS NULL THEN weight::DOUBLE END AS weight, error FROM e""",
)
def livestock_edits(spark, sf_dir):
    rows = d.animals(spark, sf_dir)
    born = F.when(F.col("breed") == "MACHINERY", F.date_format("created_at", "yyyy-MM-dd")).when(F.col("breed") == "HOUSEHOLD", "soon").otherwise(" ")
    edited = requests.livestock_edits(rows.withColumn("birth_date", born), d.as_of())
    return edited.select(
        "id", F.col("edit_age").alias("age"), F.col("edit_weight").alias("weight"), F.col("edit_error").alias("error")
    )


@query(
    "scoring_admission",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'Unknown' WHEN 2 THEN '' WHEN 3 THEN 'Zebu' ELSE 'HF75' END AS g, CASE WHEN l_tax = 0.01 THEN ' ' WHEN l_tax = 0.02 THEN 'hot' ELSE l_quantity::VARCHAR END AS t,
         CASE WHEN l_tax = 0.03 THEN '' WHEN l_tax = 0.04 THEN '100.1' ELSE '55.5' END AS h, CASE WHEN l_returnflag = 'A' THEN '3.5' WHEN l_returnflag = 'N' THEN '12' ELSE '' END AS dim, CASE WHEN l_linestatus = 'O' THEN '6' ELSE '4.5' END AS score FROM lineitem),
       p AS (SELECT *, CASE WHEN g = 'Zebu' THEN 'GROUP_NOT_VERIFIED' WHEN trim(t) = '' THEN 'TEMPERATURE_REQUIRED' WHEN t = 'hot' THEN 'TEMPERATURE_NOT_NUMERIC' WHEN h = '' THEN 'HUMIDITY_REQUIRED' WHEN h = '100.1' THEN 'HUMIDITY_OUT_OF_RANGE' END AS problem FROM t)
       SELECT l_orderkey, l_linenumber, problem IS NULL AS admitted, CASE WHEN problem LIKE 'GROUP%' THEN 'genetic_group' WHEN problem LIKE 'TEMP%' THEN 'ambient_temperature_c' WHEN problem LIKE 'HUM%' THEN 'humidity_percent' END AS problem_field,
         coalesce(problem, CASE WHEN g IN ('Unknown', '') THEN 'GROUP_NEEDED_FOR_ESTIMATE' END) AS message, CASE WHEN problem IS NULL AND g = 'HF75' THEN g END AS genetic_group_sent,
         CASE WHEN problem IS NULL THEN t::DOUBLE END AS ambient_temperature_sent, CASE WHEN problem IS NULL THEN h::DOUBLE END AS humidity_sent, CASE WHEN problem IS NULL AND dim = '12' THEN 12::BIGINT END AS days_in_milk_sent,
         CASE WHEN problem IS NULL THEN 0.0::DOUBLE END AS previous_yield_sent, CASE WHEN problem IS NULL AND score = '4.5' THEN 4.5::DOUBLE END AS condition_score_sent FROM p""",
)
def scoring_admission(spark, sf_dir):
    line, tax = F.col("l_linenumber"), F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(line == 1, "Unknown").when(line == 2, "").when(line == 3, "Zebu").otherwise("HF75").alias("genetic_group"),
        F.when(tax == 0.01, " ").when(tax == 0.02, "hot").otherwise(F.col("l_quantity").cast("string")).alias("ambient_temperature_c"),
        F.when(tax == 0.03, "").when(tax == 0.04, "100.1").otherwise("55.5").alias("humidity_percent"),
        F.when(F.col("l_returnflag") == "A", "3.5").when(F.col("l_returnflag") == "N", "12").otherwise("").alias("days_in_milk"),
        F.lit("0").alias("previous_week_avg_yield_l"), F.when(F.col("l_linestatus") == "O", "6").otherwise("4.5").alias("body_condition_score"),
    )
    out = requests.scoring_admission(rows)
    return out.select("l_orderkey", "l_linenumber", "admitted", "problem_field", "message", *[c for c in out.columns if c.endswith("_sent")])


DEMO_FORMULAS = [
    formulas.Formula("F1", "PRICE", "disc price", ("price", "discount"), lambda p, c: p * (F.lit(1.0) - c)),
    formulas.Formula("F2", "PRICE", "ratio", ("price", "discount"), lambda p, c: F.try_divide(p, c)),
    formulas.Formula("F3", "LABEL", "period", ("daysinmilk",), lambda x: F.when(x <= 10, "Peak").when(x <= 20, "Mid").otherwise("Late"), is_label=True),
    formulas.Formula("F4", "PRICE", "absent", ("price",), lambda p: p),
    formulas.Formula("F5", "PRICE", "price", (), None),
    formulas.sql_formula("F6", "PRICE", "stored_capacity", ("price", "left.over"), "price - `left.over`"),
]


def _formula_sql(fid, domain, target, expected, stored, label=False):
    diff = "NULL::DOUBLE" if label else f"abs({stored} - ({expected}))"
    exact = f"lower(trim({stored})) = lower({expected})" if label else f"{diff} <= 1e-9"
    close = "false" if label else f"{diff} <= 0.01"
    name = target.replace("'", "''")
    return f"""SELECT '{fid}' AS formula_id, '{domain}' AS domain, '{name}' AS target_field, 'DOCUMENTED' AS interpretation, count({stored}) AS stored_value_count, '' AS missing_required_columns, count(*) AS row_count,
      count({expected}) AS calculable_row_count, count(*) FILTER (WHERE {expected} IS NOT NULL AND {stored} IS NOT NULL AND {exact}) AS exact_match_count,
      count(*) FILTER (WHERE {expected} IS NOT NULL AND {stored} IS NOT NULL AND {close} AND NOT {exact}) AS tolerance_match_count,
      count(*) FILTER (WHERE {expected} IS NOT NULL AND {stored} IS NOT NULL AND NOT {exact} AND NOT {close}) AS mismatch_count, count(*) - count({expected}) AS missing_input_row_count,
      count(*) FILTER (WHERE {expected} IS NOT NULL AND {stored} IS NULL) AS stored_missing_with_inputs_count, round(max({diff}), 4) AS maximum_absolute_difference FROM formulas"""


FORMULA_STATUS = """CASE WHEN exact_match_count + tolerance_match_count + mismatch_count = 0 THEN 'NOT_REPRODUCIBLE_MISSING_INPUT' WHEN mismatch_count > 0 AND exact_match_count + tolerance_match_count = 0 THEN 'NOT_REPRODUCIBLE_CONFLICT'
  WHEN mismatch_count > 0 OR missing_input_row_count > 0 OR stored_missing_with_inputs_count > 0 THEN 'PARTIALLY_REPRODUCIBLE' WHEN tolerance_match_count > 0 THEN 'REPRODUCIBLE_WITH_TOLERANCE' ELSE 'FULLY_REPRODUCIBLE' END AS status"""


@query(
    "formula_audit",
    f"""WITH {d.FORMULAS}, a AS ({_formula_sql('F1', 'PRICE', 'disc price', 'price * (1.0::DOUBLE - discount)', 'disc_price')}
        UNION ALL {_formula_sql('F2', 'PRICE', 'ratio', 'CASE WHEN discount = 0 THEN NULL ELSE price / discount END', 'ratio')}
        UNION ALL {_formula_sql('F3', 'LABEL', 'period', "CASE WHEN daysinmilk <= 10 THEN 'Peak' WHEN daysinmilk <= 20 THEN 'Mid' ELSE 'Late' END", 'period', True)}
        UNION ALL {_formula_sql('F6', 'PRICE', 'stored_capacity', 'price - left_over', 'stored_capacity')})
        SELECT *, {FORMULA_STATUS} FROM a
        UNION ALL SELECT 'F4', 'PRICE', 'absent', 'DOCUMENTED', 0, 'absent', count(*), 0, 0, 0, 0, count(*), 0, NULL, 'NOT_REPRODUCIBLE_MISSING_INPUT' FROM formulas
        UNION ALL SELECT 'F5', 'PRICE', 'price', 'DOCUMENTED', count(price), '', count(*), 0, 0, 0, 0, 0, 0, NULL, 'FORMULA_NOT_DOCUMENTED' FROM formulas""",
)
def formula_audit(spark, sf_dir):
    return rounded(formulas.audit_formulas(d.formula_lines(spark, sf_dir), DEMO_FORMULAS))


@query(
    "formula_mismatches",
    f"""WITH {d.FORMULAS}, e AS (SELECT l_orderkey, l_linenumber, 'disc price' AS target, price * (1.0::DOUBLE - discount) AS expected, disc_price AS actual FROM formulas)
        SELECT l_orderkey, l_linenumber, target, round(expected, 4) AS expected, round(actual, 4) AS actual FROM e WHERE abs(actual - expected) > greatest(0.01, 1e-6 * abs(expected))""",
)
def formula_mismatches(spark, sf_dir):
    return rounded(formulas.formula_mismatches(d.formula_lines(spark, sf_dir), DEMO_FORMULAS[:1], ["l_orderkey", "l_linenumber"]))


@query(
    "negative_value_readings",
    f"""WITH {d.FORMULAS}, n AS (SELECT price AS g, left_over AS l, stored_capacity AS k FROM formulas WHERE left_over < 0),
        c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE abs(g - l - k) <= 0.01) AS minus, count(*) FILTER (WHERE abs(g + l - k) <= 0.01) AS plus, count(*) FILTER (WHERE abs(g - k) <= 0.01) AS same,
          count(*) FILTER (WHERE g - l > g) AS above, count(*) FILTER (WHERE g + l < 0) AS below FROM n)
        SELECT rows AS negative_rows, 'A' AS interpretation_id, 'Positive refused-feed convention' AS interpretation, minus AS matches, above AS conflicts FROM c
        UNION ALL SELECT rows, 'B', 'Negative value denotes shortage or extra demand', minus, 0 FROM c UNION ALL SELECT rows, 'C', 'Sign reversed during entry', plus, below FROM c
        UNION ALL SELECT rows, 'D', 'Leftover already included in another derived value', same, 0 FROM c UNION ALL SELECT rows, 'E', 'Nonstandard source convention', NULL, NULL FROM c""",
)
def negative_value_readings(spark, sf_dir):
    return formulas.negative_readings(d.formula_lines(spark, sf_dir), "left.over", "price", "stored_capacity")


@query(
    "contaminated_number_column",
    f"""WITH {d.DIRTY_ORDERS}, t AS (SELECT CASE WHEN price = 'abc' THEN ' ' || lower(o_orderpriority) || ' ' ELSE price END AS p, o_orderpriority AS v FROM dirty JOIN orders USING (o_orderkey)),
        n AS (SELECT *, TRY_CAST(p AS DOUBLE) AS x FROM t)
        SELECT 'p' AS "column", count(*) AS row_count, count(x) AS numeric_count, count(*) FILTER (WHERE p IS NOT NULL AND x IS NULL) AS text_count, count(*) FILTER (WHERE p IS NULL) AS missing_count,
          count(DISTINCT lower(trim(p))) FILTER (WHERE x IS NULL) AS unique_text_count, true AS all_text_in_vocabulary FROM n""",
)
def contaminated_number_column(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows = d.dirty_orders(spark, sf_dir).join(o, "o_orderkey").select(
        F.when(F.col("price") == "abc", F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" "))).otherwise(F.col("price")).alias("p"),
        F.col("o_orderpriority").alias("v"),
    )
    return formulas.contaminated_column(rows, "p", "v")


# Variable names and definitions that reach every unit, period and status: (variable, status, counted per day).
VARIABLES = (
    ("Cow_ID", "IDENTIFIER", False), ("Replication_No", "IDENTIFIER", False), ("Genetic_Group", "OBSERVED", False), ("THI_Range", "TREATMENT_ASSIGNED", False),
    ("Glucose_x", "LABORATORY_MEASURED", False), ("Dry_Matter_Intake", "DIRECTLY_MEASURED", False), ("Milk_Yield", "OBSERVED", False),
    ("Rectal_Temp", "DIRECTLY_MEASURED", False), ("Pulse_Rate", "DIRECTLY_MEASURED", False), ("Water_Per_Day", "UNKNOWN", True), ("Coat", "UNKNOWN", False),
)
DEFINITIONS = (
    ("in mmol/l", "mmol/L"), ("in µg/dl", "µg/dL"), ("in mgdl", "mg/dL"), ("in g/dl", "g/dL"), ("cells/ml", "cells/mL"), ("breaths per minute", "breaths/min"),
    ("bpm", "beats/min"), ("in °f", "°F"), ("liters per cow", "L"), ("daily, in kg", "kg"), ("a percentage", "%"), ("no unit", "UNCLEAR"),
)
DEFINITIONS_SQL = "p_definitions(u, d, unit) AS (VALUES {}), p_variables(v, status, per_day, milk) AS (VALUES {})".format(
    ", ".join(f"({i}, '{d}', '{unit}')" for i, (d, unit) in enumerate(DEFINITIONS)),
    ", ".join(f"({i}, '{status}', {str(day).lower()}, {str(v == 'Milk_Yield').lower()})" for i, (v, status, day) in enumerate(VARIABLES)),
)


@query(
    "definition_details",
    f"""WITH {DEFINITIONS_SQL} SELECT p_partkey, p_definitions.unit, CASE WHEN per_day OR d LIKE '%daily%' OR milk AND d LIKE '%per cow%' THEN 'per cow per day' ELSE 'per observation' END AS period, status AS measurement_status
        FROM part JOIN p_definitions ON u = p_partkey % 12 JOIN p_variables ON v = p_partkey % 11""",
)
def definition_details(spark, sf_dir):
    key = F.col("p_partkey")
    variables = F.array(*[F.lit(v) for v, _, _ in VARIABLES])
    definitions = F.array(*[F.lit(d) for d, _ in DEFINITIONS])
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.get(variables, (key % len(VARIABLES)).cast("int")).alias("variable"), F.get(definitions, (key % len(DEFINITIONS)).cast("int")).alias("definition")
    )
    return catalogue.definition_details(rows).select("p_partkey", "unit", "period", "measurement_status")


@query(
    "target_domains",
    """WITH f(i, variable, domains) AS (VALUES (0, 'Dry_Matter_Intake', ['dmi']), (1, 'Milk_Yield', ['milk_yield']), (2, 'SCC_count', ['milk_composition']), (3, 'Rectal_Temp', ['temperature', 'physiology']),
        (4, 'Humidity', ['humidity']), (5, 'THI_Range', ['thi']), (6, 'Pulse_Rate', ['physiology']), (7, 'Glucose_dmi', ['dmi', 'blood']), (8, 'Coat', []::VARCHAR[]))
       SELECT p_partkey, variable, unnest(domains) AS domain FROM part JOIN f ON i = p_partkey % 9""",
)
def target_domains(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("Dry_Matter_Intake", "Milk_Yield", "SCC_count", "Rectal_Temp", "Humidity", "THI_Range", "Pulse_Rate", "Glucose_dmi", "Coat")])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 9).cast("int")).alias("variable"))
    return catalogue.target_fields(rows)


@query(
    "target_classes",
    f"""WITH v AS (SELECT DISTINCT p_name AS variable, p_type AS definition FROM part), c AS (SELECT CASE WHEN variable LIKE 'hot%' THEN 'gapCP' ELSE variable END AS variable, CASE WHEN definition = 'SMALL' THEN 'a fodder mix' ELSE definition END AS definition FROM v)
        SELECT variable, definition, CASE WHEN variable = 'gapCP' THEN 'protein' WHEN definition LIKE '%fodder%' THEN 'feed_category' ELSE 'other' END AS domain, CASE WHEN variable = 'gapCP' THEN 'CALCULATED_CP_GAP' WHEN definition LIKE '%fodder%' THEN 'INGREDIENT_INFORMATION_ONLY' ELSE 'UNCLEAR' END AS status,
          CASE WHEN variable = 'gapCP' THEN 'RULE_VALIDATION_ONLY' WHEN definition LIKE '%fodder%' THEN 'NOT_RECOMMENDATION_LABEL' ELSE 'UNCLEAR' END AS ml_suitability FROM c""",
)
def target_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("variable"), F.col("p_type").alias("definition")).distinct()
    rows = rows.select(
        F.when(F.col("variable").startswith("hot"), "gapCP").otherwise(F.col("variable")).alias("variable"),
        F.when(F.col("definition") == "SMALL", "a fodder mix").otherwise(F.col("definition")).alias("definition"),
    )
    return catalogue.classify_targets(rows)


@query(
    "label_evidence",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR lower(text) LIKE '%served%' OR lower(text) LIKE '%different fodder ingredients%' THEN 'OBSERVED_DIET_ONLY' WHEN doc_id % 5 = 1 THEN 'VERIFIED_OBSERVED_PRACTICE'
       WHEN doc_id % 5 = 2 THEN 'VERIFIED_EXPERT_RECOMMENDATION_LABEL' ELSE 'UNCLEAR' END AS label_evidence FROM documents""",
)
def label_evidence(spark, sf_dir):
    prefixes = F.array(*[F.lit(p) for p in ("Different fodder ingredients", "A feeding program followed by farmers", "Recommended by an expert", "By an adviser", "A feeding program")])
    definition = F.concat_ws(" ", F.get(prefixes, (F.col("doc_id") % 5).cast("int")), "text")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("label").alias("variable"), definition.alias("definition"))
    return catalogue.feed_label_evidence(rows).select("doc_id", "label_evidence")


LEAK_COLUMNS = ("o_orderkey", "Milk_Yield_L", "Date", "Breed", "Heart_Rate_bpm", "Feed_Type", "milk yield l total", "Farm_ID")


@query(
    "leakage_classes",
    """WITH c AS (SELECT DISTINCT o_orderstatus AS dataset, unnest(['o_orderkey', 'Milk_Yield_L', 'Date', 'Breed', 'Heart_Rate_bpm', 'Feed_Type', 'milk yield l total', 'Farm_ID']) AS "column" FROM orders)
       SELECT dataset, "column", 'Milk_Yield_L' AS target, CASE "column" WHEN 'Milk_Yield_L' THEN 'DEFINITE_LEAKAGE' WHEN 'Breed' THEN 'SAFE' WHEN 'Heart_Rate_bpm' THEN 'AVAILABILITY_MISMATCH' WHEN 'o_orderkey' THEN 'AVAILABILITY_MISMATCH' ELSE 'POSSIBLE_LEAKAGE' END AS classification,
         CASE "column" WHEN 'Milk_Yield_L' THEN 'TARGET' WHEN 'Breed' THEN 'NONE' WHEN 'Heart_Rate_bpm' THEN 'MEASURED_AFTER_OUTCOME' WHEN 'o_orderkey' THEN 'NOT_ON_FORM' WHEN 'Date' THEN 'DATE' WHEN 'Feed_Type' THEN 'SAME_RECORD_OUTCOME' WHEN 'Farm_ID' THEN 'IDENTIFIER' ELSE 'NAME_CONTAINS_TARGET' END AS reason FROM c""",
)
def leakage_classes(spark, sf_dir):
    datasets = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("dataset")).distinct()
    columns = datasets.select("dataset", F.explode(F.array(*[F.lit(c) for c in LEAK_COLUMNS])).alias("column"))
    targets = datasets.select("dataset", F.lit("Milk_Yield_L").alias("target"))
    return catalogue.leakage_classes(columns, targets)


@query(
    "study_leakage",
    """WITH f(i, field, dmi, milk) AS (VALUES (0, 'Blood sugar', 'RESEARCH_ONLY', 'RESEARCH_ONLY'), (1, 'Fat %', 'POSSIBLE_LEAKAGE', 'POSSIBLE_LEAKAGE'), (2, 'Rectal temp', 'UNCLEAR', 'UNCLEAR'),
        (3, 'Milk yield', 'POSSIBLE_LEAKAGE', 'NOT_AVAILABLE_AT_INFERENCE'), (4, 'DMI', 'NOT_AVAILABLE_AT_INFERENCE', 'POSSIBLE_LEAKAGE'), (5, 'THI range', 'UNCLEAR', 'UNCLEAR'), (6, 'Genetic group', 'SAFE', 'SAFE'),
        (7, 'Coat', 'NOT_AVAILABLE_AT_INFERENCE', 'NOT_AVAILABLE_AT_INFERENCE'))
       SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN dmi ELSE milk END AS classification FROM part JOIN f ON i = p_partkey % 8""",
)
def study_leakage(spark, sf_dir):
    fields = F.array(*[F.lit(f) for f in ("Blood sugar", "Fat %", "Rectal temp", "Milk yield", "DMI", "THI range", "Genetic group", "Coat")])
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.get(fields, (F.col("p_partkey") % 8).cast("int")).alias("column"), F.when(F.col("p_size") % 2 == 0, "DMI").otherwise("MILK").alias("target")
    )
    return catalogue.study_leakage(rows).select("p_partkey", "classification")


@query(
    "name_classes",
    f"""WITH u AS (SELECT DISTINCT split_part(url, '/', 3) AS "column" FROM pages), t AS (SELECT "column", list_filter(string_split_regex(lower("column"), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u)
        SELECT "column", array_to_string(w, ' ') AS tokens, list_contains(w, 'id') OR list_contains(w, 'identifier') AS is_identifier, list_contains(w, 'date') OR list_contains(w, 'timestamp') AS is_date FROM t""",
)
def name_classes(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("column")).distinct()
    return mapping.name_classes(hosts).withColumn("tokens", F.array_join("tokens", " "))


@query(
    "alias_mapping",
    """SELECT o_orderkey AS cattle_id, o_orderpriority AS breed, o_totalprice AS weight_kg, o_orderstatus FROM orders""",
)
def alias_mapping(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" TAGID"), F.col("o_orderpriority").alias("BREED"), F.col("o_totalprice").alias("weightKg"), "o_orderstatus"
    )
    return mapping.map_columns(rows).table


@query(
    "candidate_presence",
    """SELECT 'Weight' AS candidate_feature, true AS present, 'o_totalprice' AS source_column, 'PROVIDED' AS availability, 'double' AS data_type, 0.0::DOUBLE AS missing_percentage, count(DISTINCT o_totalprice) AS unique_non_null, 'SAFE_WITH_INPUT_VALIDATION' AS prediction_time_safety FROM orders
       UNION ALL SELECT 'Parity', false, NULL, 'NOT_PROVIDED', NULL, NULL, NULL, 'AVAILABILITY_MISMATCH'""",
)
def candidate_presence(spark, sf_dir):
    found = profile.column_profile(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus"))
    wanted = {"Weight": ("Weight_kg", "O_TOTAL_PRICE"), "Parity": ("Calving_Number",)}
    return mapping.candidate_presence(found, wanted, {"Weight": "PROVIDED"})


@query(
    "target_drop_counts",
    f"""WITH {d.DIRTY_ORDERS} SELECT count(*) AS rows, count(*) FILTER (WHERE price IS NULL) AS missing_target, count(*) FILTER (WHERE price IN ('abc', 'inf')) AS non_numeric_target, count(*) FILTER (WHERE price IS NOT NULL AND price NOT IN ('abc', 'inf')) AS usable_rows FROM dirty""",
)
def target_drop_counts(spark, sf_dir):
    return mapping.target_drop_counts(d.dirty_orders(spark, sf_dir), "price")


@query(
    "task_invariants",
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT 'NO_NULLS' AS "check", true AS passed, 0::BIGINT AS observed UNION ALL SELECT 'POSITIVE_TARGET', count(*) FILTER (WHERE o_totalprice <= 0) = 0, count(*) FILTER (WHERE o_totalprice <= 0) FROM orders
       UNION ALL SELECT 'KNOWN_CATEGORIES', false, count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders UNION ALL SELECT 'ROW_COUNT', false, count(*) FROM orders UNION ALL SELECT 'ROWS_PER_GROUP', min(n) = 10 AND max(n) = 10, max(n) FROM g""",
)
def task_invariants(spark, sf_dir):
    rows = mapping.task_frame(
        table(spark, sf_dir, "orders"),
        {"subject": ("o_custkey", "bigint"), "target": ("o_totalprice", "double"), "category": ("o_orderstatus", "string")},
    )
    return mapping.task_invariants(rows, "subject", "target", "category", ["O", "F"], rows=1, rows_per_group=10)

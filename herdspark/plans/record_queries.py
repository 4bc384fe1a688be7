"""Search, key-audit, latest-row, alert and overview queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdspark.functions import dates, text, values
from herdspark.operators import alerts, joins, latest, records, requests
from herdspark.plans import derived as d
from herdspark.plans.registry import query, table
from herdspark.plans.summary_queries import rounded

OWNER = "owner-3"


@query(
    "search_records",
    f"""WITH {d.ANIMALS} SELECT id, animal_name FROM animals WHERE (lower(animal_name) LIKE '%42%' OR lower(animal_id) LIKE '%42%' OR lower(breed) LIKE '%42%')
        AND {d.DISPLAY_SPECIES_SQL.format(s='species')} = 'Dairy Cattle'""",
)
def search_records(spark, sf_dir):
    rows = d.animals(spark, sf_dir)
    hit = text.contains_any([F.col(c) for c in ("animal_name", "animal_id", "breed")], "42")
    return rows.filter(hit & (text.species_slug(F.col("species")) == "dairy-cattle")).select("id", "animal_name")


TARGET_NAME_SQL = """CASE WHEN v.target_type = 'Batch' OR coalesce(v.batch_id, '') <> '' THEN coalesce('Batch: ' || b.batch_name, 'Unknown Batch')
  ELSE coalesce(a.animal_name || ' (' || a.animal_id || ')', 'Unknown Animal') END"""


@query(
    "display_names",
    f"""WITH {d.ANIMALS}, {d.BATCHES}, {d.VACCINATIONS} SELECT v.id, {TARGET_NAME_SQL} AS target_name
        FROM vaccinations v LEFT JOIN animals a ON v.livestock_id = a.id LEFT JOIN batches b ON v.batch_id = b.id""",
)
def display_names(spark, sf_dir):
    shown = joins.display_target(d.vaccinations(spark, sf_dir), d.animals(spark, sf_dir), d.batches(spark, sf_dir))
    return shown.select("id", "target_name")


@query(
    "search_display_names",
    f"""WITH {d.ANIMALS}, {d.BATCHES}, {d.VACCINATIONS}, s AS (SELECT v.id, v.vaccine_name, {TARGET_NAME_SQL} AS target_name
        FROM vaccinations v LEFT JOIN animals a ON v.livestock_id = a.id LEFT JOIN batches b ON v.batch_id = b.id)
        SELECT * FROM s WHERE lower(vaccine_name) LIKE '%nation_1%' OR lower(target_name) LIKE '%nation\\_1%' ESCAPE '\\'""",
)
def search_display_names(spark, sf_dir):
    shown = joins.display_target(d.vaccinations(spark, sf_dir), d.animals(spark, sf_dir), d.batches(spark, sf_dir))
    return joins.search_display(shown, "NATION_1").select("id", "vaccine_name", "target_name")


@query(
    "species_slugs",
    f"""WITH {d.ANIMALS}, s AS (SELECT *, {d.DISPLAY_SPECIES_SQL.format(s='species')} AS shown FROM animals)
        SELECT species, shown, CASE lower(shown) WHEN 'dairy cattle' THEN 'dairy-cattle' WHEN 'cattle (beef)' THEN 'cattle-beef' WHEN 'sheep/goats' THEN 'sheep-goats'
          ELSE trim(regexp_replace(lower(shown), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
          lower(species) NOT SIMILAR TO '.*(sheep|goat|chicken|duck|poultry|swine|beef).*' AND lower(species) IN ('dairy cattle', 'dairy cow', 'cattle (dairy)', 'cow') AS suitable,
          count(*) AS animals FROM s GROUP BY 1, 2, 3, 4""",
)
def species_slugs(spark, sf_dir):
    s = F.col("species")
    return d.animals(spark, sf_dir).groupBy(
        "species", text.display_species(s).alias("shown"), text.species_slug(s).alias("slug"), text.suitable_species(s).alias("suitable")
    ).agg(F.count(F.lit(1)).alias("animals"))


@query(
    "text_normalisation",
    f"""WITH {d.CLIMATE}, t AS (SELECT stage, genetic_group, CASE l_linenumber WHEN 1 THEN 't1 (75-80)' WHEN 2 THEN ' T2' WHEN 3 THEN 'n/a' ELSE 'Cold' END AS label,
          l_partkey::DOUBLE::VARCHAR AS num FROM climate)
        SELECT regexp_replace(lower(stage), '[^a-z0-9]+', '', 'g') AS compare_key, trim(regexp_replace(regexp_replace(lower(stage), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS status,
          CASE WHEN trim(genetic_group) = '' THEN NULL ELSE upper(replace(replace(replace(trim(genetic_group), '_', ''), ' ', ''), '%', '')) END AS bare,
          CASE WHEN label = 'n/a' THEN NULL WHEN regexp_matches(label, '^\\s*[tT][012]') THEN upper(regexp_extract(label, '^\\s*([tT][012])', 1)) ELSE trim(label) END AS prefix,
          sum(length(regexp_replace(num, '\\.0+$', '')))::BIGINT AS id_length, count(*) AS rows FROM t GROUP BY 1, 2, 3, 4""",
)
def text_normalisation(spark, sf_dir):
    line = F.col("l_linenumber")
    label = F.when(line == 1, "t1 (75-80)").when(line == 2, " T2").when(line == 3, "n/a").otherwise("Cold")
    rows = d.climate_lines(spark, sf_dir).select(
        "stage", "genetic_group", label.alias("label"), F.col("l_partkey").cast("double").cast("string").alias("num")
    )
    return rows.groupBy(
        text.compare_key(F.col("stage")).alias("compare_key"), text.status_text(F.col("stage")).alias("status"),
        text.bare_upper(F.col("genetic_group")).alias("bare"), text.label_prefix(F.col("label")).alias("prefix"),
    ).agg(F.sum(F.length(text.canonical_id(F.col("num")))).alias("id_length"), F.count(F.lit(1)).alias("rows"))


@query(
    "age_in_months",
    f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS b, DATE '{d.AS_OF}' AS a FROM orders)
        SELECT o_orderkey, greatest(0, (year(a) - year(b)) * 12 + month(a) - month(b) - CASE WHEN day(a) < day(b) THEN 1 ELSE 0 END)::INTEGER AS age_months FROM o""",
)
def age_in_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.age_months(F.to_date("o_orderdate"), d.as_of()).cast("int").alias("age_months")
    )


@query(
    "parsed_dates",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderdate::TIMESTAMP END AS parsed FROM orders""",
)
def parsed_dates(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp")
    shown = (
        F.when(F.col("o_orderstatus") == "P", "next week")
        .when(F.col("o_orderpriority") == "1-URGENT", F.unix_millis(when).cast("string"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(when, "yyyy-MM-dd"))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("t"))
    return rows.select("o_orderkey", dates.parsed_time(F.col("t")).cast("timestamp_ntz").alias("parsed"))


AGE_TEXT = """t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE ' ' END AS born,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'about ' || (day(o_orderdate) + 0.5)::VARCHAR || ' months' ELSE NULL END AS months,
  CASE WHEN o_orderpriority = '2-HIGH' THEN (day(o_orderdate) / 4.0)::DOUBLE ELSE NULL END AS years,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN day(o_orderdate)::VARCHAR || ' Years old' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN day(o_orderdate)::VARCHAR ELSE 'unknown' END AS age,
  o_orderdate FROM orders)"""


@query(
    "resolved_ages",
    f"""WITH {AGE_TEXT} SELECT o_orderkey, (CASE WHEN trim(born) <> '' THEN greatest(0, (1998 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) - CASE WHEN 15 < day(o_orderdate) THEN 1 ELSE 0 END)
          WHEN months IS NOT NULL THEN floor(day(o_orderdate) + 1.0) WHEN years IS NOT NULL THEN floor(years * 12 + 0.5)
          WHEN age LIKE '%Year%' THEN day(o_orderdate) * 12 WHEN age = 'unknown' THEN NULL ELSE day(o_orderdate) END)::BIGINT AS age_months FROM t""",
)
def resolved_ages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day, pr = F.dayofmonth("o_orderdate"), F.col("o_orderpriority")
    born = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(" ")
    months = F.when(pr == "1-URGENT", F.concat(F.lit("about "), (day + 0.5).cast("string"), F.lit(" months")))
    years = F.when(pr == "2-HIGH", day / 4.0)
    age = F.when(pr == "3-MEDIUM", F.concat(day.cast("string"), F.lit(" Years old"))).when(
        pr == "4-NOT SPECIFIED", day.cast("string")).otherwise("unknown")
    return o.select("o_orderkey", dates.resolved_age_months(d.as_of(), [born], [months], [years], age).alias("age_months"))


@query(
    "first_filled_fields",
    f"""WITH {d.ANIMALS} SELECT id, coalesce(nullif(trim(species), ''), nullif(trim(breed), '')) AS first_text,
        coalesce(TRY_CAST(nullif(regexp_extract(age, '-?\\d+(\\.\\d+)?', 0), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(weight, '-?\\d+(\\.\\d+)?', 0), '') AS DOUBLE)) AS first_number FROM animals""",
)
def first_filled_fields(spark, sf_dir):
    return d.animals(spark, sf_dir).select(
        "id", text.first_text([F.col("species"), F.col("breed")]).alias("first_text"),
        values.first_number([F.col("age"), F.col("weight")]).alias("first_number"),
    )


@query(
    "normalised_health_records",
    f"""WITH {d.HEALTH} SELECT id, coalesce(trim(livestock_id), '') AS livestock_id, 'Unknown Animal' AS animal_name, coalesce(nullif(trim(disease_type), ''), 'Unspecified Issue') AS disease_type,
        coalesce(nullif(trim(recovery_status), ''), 'In Treatment') AS recovery_status, {d.HEALTH_FOLD_SQL.format(s='recovery_status')} AS folded FROM health""",
)
def normalised_health_records(spark, sf_dir):
    source = d.health_records(spark, sf_dir)
    folded = text.health_status(F.col("recovery_status")).alias("folded")
    shown = records.normalised_health(source)
    return shown.select("id", "livestock_id", "animal_name", "disease_type", "recovery_status").join(source.select("id", folded), "id")


@query(
    "normalised_livestock",
    f"""WITH {d.ANIMALS} SELECT id, animal_id, coalesce(nullif(trim(animal_name), ''), 'Unnamed Animal') AS animal_name, {d.DISPLAY_SPECIES_SQL.format(s='species')} AS species, breed,
        TRY_CAST(age AS BIGINT) AS age_months, weight::DOUBLE AS weight_kg, user_id FROM animals
        WHERE lower(trim(species)) IN ('dairy cattle', 'dairy cow', 'cattle (dairy)', 'cow')""",
)
def normalised_livestock(spark, sf_dir):
    return records.normalised_livestock(d.animals(spark, sf_dir), d.as_of())


@query(
    "owner_visibility",
    f"""WITH {d.ANIMALS}, a AS (SELECT *, CASE WHEN weight::DOUBLE < 0 THEN ' ' ELSE user_id END AS owner FROM animals)
        SELECT 'strict' AS mode, count(*) AS rows FROM a WHERE owner = '{OWNER}'
        UNION ALL SELECT 'lenient', count(*) FROM a WHERE owner = '{OWNER}' OR trim(coalesce(owner, '')) = ''
        UNION ALL SELECT 'owners', count(*) FROM a WHERE owner IN (SELECT 'owner-' || n_nationkey::VARCHAR FROM nation)""",
)
def owner_visibility(spark, sf_dir):
    owner = F.when(F.col("weight").cast("double") < 0, " ").otherwise(F.col("user_id"))
    a = d.animals(spark, sf_dir).withColumn("owner", owner)
    owners = table(spark, sf_dir, "nation").select(F.concat(F.lit("owner-"), F.col("n_nationkey").cast("string")).alias("owner"))
    parts = [
        latest.visible_records(a, "owner", OWNER).agg(F.lit("strict").alias("mode"), F.count(F.lit(1)).alias("rows")),
        latest.visible_records(a, "owner", OWNER, strict=False).agg(F.lit("lenient").alias("mode"), F.count(F.lit(1)).alias("rows")),
        latest.visible_to_owners(a, owners, "owner").agg(F.lit("owners").alias("mode"), F.count(F.lit(1)).alias("rows")),
    ]
    return latest.union_feed(parts)


AUDIT_NAMES = "(SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows"
COMPOSITE = """lk AS (SELECT a, b, count(*) AS l FROM l GROUP BY a, b), rk AS (SELECT a, b, count(*) AS r FROM r GROUP BY a, b),
  j AS (SELECT coalesce(lk.a, rk.a) AS a, coalesce(lk.b, rk.b) AS b, coalesce(l, 0) AS l, coalesce(r, 0) AS r
    FROM lk FULL JOIN rk ON lk.a IS NOT DISTINCT FROM rk.a AND lk.b IS NOT DISTINCT FROM rk.b)"""


@query(
    "composite_key_audit",
    f"""WITH l AS (SELECT o_custkey::VARCHAR AS a, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS b FROM orders),
        r AS (SELECT c_custkey::VARCHAR AS a, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'F' END AS b FROM customer), {COMPOSITE}
        SELECT sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, count(*) FILTER (WHERE l > 0) AS left_unique_keys, count(*) FILTER (WHERE r > 0) AS right_unique_keys,
          coalesce(sum(l) FILTER (WHERE a IS NULL OR b IS NULL), 0)::BIGINT AS left_missing_keys, coalesce(sum(r) FILTER (WHERE a IS NULL OR b IS NULL), 0)::BIGINT AS right_missing_keys,
          coalesce(sum(l) FILTER (WHERE l > 1), 0)::BIGINT AS left_duplicate_key_rows, coalesce(sum(r) FILTER (WHERE r > 1), 0)::BIGINT AS right_duplicate_key_rows,
          count(*) FILTER (WHERE l > 0 AND r > 0) AS matches, count(*) FILTER (WHERE l > 0 AND r = 0) AS left_only_keys, count(*) FILTER (WHERE l = 0 AND r > 0) AS right_only_keys,
          count(*) FILTER (WHERE l > 1 AND r > 1) > 0 AS many_to_many,
          round(count(*) FILTER (WHERE l > 0 AND r > 0) * 100.0 / sum(l), 4) AS left_match_percentage, round(count(*) FILTER (WHERE l > 0 AND r > 0) * 100.0 / sum(r), 4) AS right_match_percentage,
          'ONE_TO_MANY' AS cardinality, 'SAFE_ONE_TO_MANY' AS join_safety FROM j""",
)
def composite_key_audit(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    left = {"a": F.col("o_custkey").cast("string"), "b": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))}
    right = {"a": F.col("c_custkey").cast("string"), "b": F.when(F.col("c_acctbal") >= 0, F.lit("F"))}
    return rounded(joins.composite_join_audit(o, c, left, right))


@query(
    "single_key_audit",
    """WITH l AS (SELECT doc_id::VARCHAR AS k, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT CASE WHEN toxic = 1 THEN NULL ELSE doc_id::VARCHAR END AS k, count(*) AS n FROM labels GROUP BY 1),
       j AS (SELECT coalesce(l.k, r.k) AS k, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM l FULL JOIN r ON l.k = r.k)
       SELECT sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, count(*) FILTER (WHERE k IS NOT NULL AND l > 0) AS left_unique_keys, count(*) FILTER (WHERE k IS NOT NULL AND r > 0) AS right_unique_keys,
         coalesce(sum(l - 1) FILTER (WHERE k IS NOT NULL AND l > 1), 0)::BIGINT AS left_duplicate_surplus, coalesce(sum(r - 1) FILTER (WHERE k IS NOT NULL AND r > 1), 0)::BIGINT AS right_duplicate_surplus,
         coalesce(sum(l) FILTER (WHERE k IS NULL), 0)::BIGINT AS left_missing_keys, coalesce(sum(r) FILTER (WHERE k IS NULL), 0)::BIGINT AS right_missing_keys,
         coalesce(sum(l) FILTER (WHERE r > 0 AND k IS NOT NULL), 0)::BIGINT AS matched_left_rows, count(*) FILTER (WHERE k IS NOT NULL AND l > 0 AND r = 0) AS unmatched_left_keys,
         count(*) FILTER (WHERE k IS NOT NULL AND l = 0 AND r > 0) AS unmatched_right_keys, count(*) FILTER (WHERE k IS NOT NULL AND l > 1 AND r > 1) > 0 AS many_to_many,
         round(coalesce(sum(l) FILTER (WHERE r > 0 AND k IS NOT NULL), 0) * 100.0 / sum(l), 4) AS left_match_percentage, 'SAFE_ONE_TO_ONE' AS join_safety FROM j""",
)
def single_key_audit(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") != 1, F.col("doc_id")).alias("doc_id"))
    return rounded(joins.single_join_audit(table(spark, sf_dir, "documents"), labels, "doc_id", "doc_id"))


@query(
    "table_identity_check",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'),
       k AS (SELECT count(*) AS l, (SELECT count(*) FROM r) AS r FROM orders),
       m AS (SELECT count(*) FILTER (WHERE a.o_totalprice IS DISTINCT FROM r.o_totalprice) AS p, count(*) FILTER (WHERE a.o_orderstatus IS DISTINCT FROM r.o_orderstatus) AS s, count(*) AS n FROM orders a JOIN r USING (o_orderkey))
       SELECT l AS left_keys, r AS right_keys, n AS shared_keys, 0::BIGINT AS left_duplicates, 0::BIGINT AS right_duplicates, n AS aligned_rows, 'o_orderstatus' AS "column", s AS mismatches FROM k, m
       UNION ALL SELECT l, r, n, 0, 0, n, 'o_totalprice', p FROM k, m""",
)
def table_identity_check(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    right = left.filter(F.col("o_orderstatus") != "P").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_totalprice")).alias("o_totalprice")
    )
    return joins.identity_check(left.drop("o_orderpriority"), right, ["o_orderkey"])


@query(
    "validated_one_to_one_join",
    "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def validated_one_to_one_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.one_to_one_join(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "identifier_coverage",
    """SELECT 'left_only' AS side, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
       UNION ALL SELECT DISTINCT 'right_only', user_id::VARCHAR FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""",
)
def identifier_coverage(spark, sf_dir):
    return joins.id_coverage(
        table(spark, sf_dir, "customer"), table(spark, sf_dir, "events"),
        text.canonical_id(F.col("c_custkey")), text.canonical_id(F.col("user_id")),
    )


@query("linked_vaccinations", f"WITH {d.ANIMALS}, {d.BATCHES}, {d.VACCINATIONS}, {d.LINKED} SELECT id, livestock_id, batch_id, animal__animal_name, batch__batch_name FROM linked")
def linked_vaccinations(spark, sf_dir):
    return _linked(spark, sf_dir).select("id", "livestock_id", "batch_id", "animal__animal_name", "batch__batch_name")


def _linked(spark, sf_dir):
    return alerts.linked_vaccinations(d.vaccinations(spark, sf_dir), d.animals(spark, sf_dir), d.batches(spark, sf_dir))


@query(
    "status_by_any_key",
    f"""WITH {d.ANIMALS}, {d.HEALTH}, k AS (SELECT id, recovery_status, created_at, unnest([livestock_id, animal_ref]) AS key FROM health WHERE trim(recovery_status) <> ''),
        ak AS (SELECT id, unnest([id, animal_id]) AS key FROM animals),
        m AS (SELECT ak.id, trim(k.recovery_status) AS s, row_number() OVER (PARTITION BY ak.id ORDER BY created_at DESC, k.id DESC) AS rn FROM ak JOIN k USING (key))
        SELECT a.id, coalesce(m.s, 'Healthy') AS latest_status FROM animals a LEFT JOIN m ON a.id = m.id AND rn = 1""",
)
def status_by_any_key(spark, sf_dir):
    found = joins.status_by_any_key(
        d.animals(spark, sf_dir), d.health_records(spark, sf_dir), ["id", "animal_id"], ["livestock_id", "animal_ref"],
        "id", values.stripped(F.col("recovery_status")), F.col("created_at"), "id",
    )
    return found.select("id", "latest_status")


@query(
    "cascade_removal",
    f"""WITH {d.ANIMALS}, {d.HEALTH}, {d.VACCINATIONS}, g AS (SELECT id FROM animals WHERE user_id = '{OWNER}')
        SELECT 'animals' AS "table", count(*) AS rows FROM animals WHERE id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'health', count(*) FROM health WHERE livestock_id IS NULL OR livestock_id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'vaccinations', count(*) FROM vaccinations WHERE livestock_id IS NULL OR livestock_id NOT IN (SELECT id FROM g)""",
)
def cascade_removal(spark, sf_dir):
    a = d.animals(spark, sf_dir)
    kept = joins.without_removed(
        {"animals": (a, "id"), "health": (d.health_records(spark, sf_dir), "livestock_id"), "vaccinations": (d.vaccinations(spark, sf_dir), "livestock_id")},
        a.filter(F.col("user_id") == OWNER), "id",
    )
    return latest.union_feed([t.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n, t in kept.items()])


@query(
    "key_set_difference",
    """WITH a AS (SELECT DISTINCT user_id AS k FROM events), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000)
       SELECT 'shared' AS part, count(*) AS keys FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
       UNION ALL SELECT 'right_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def key_set_difference(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    b = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    parts = joins.key_set_difference(a, b)
    return latest.union_feed([t.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("keys")) for n, t in parts.items()])


@query(
    "derived_health_status",
    f"""WITH {d.ANIMALS}, {d.HEALTH}, r AS (SELECT livestock_id, {d.HEALTH_FOLD_SQL.format(s='recovery_status')} AS s FROM health
          QUALIFY row_number() OVER (PARTITION BY livestock_id ORDER BY created_at DESC, id) = 1)
        SELECT a.id, coalesce(r.s, 'Healthy') AS health_status FROM animals a LEFT JOIN r ON a.id = r.livestock_id""",
)
def derived_health_status(spark, sf_dir):
    return _with_status(spark, sf_dir).select("id", "health_status")


def _with_status(spark, sf_dir):
    return latest.derived_health(
        d.animals(spark, sf_dir), d.health_records(spark, sf_dir), "id", "livestock_id", "recovery_status", F.col("created_at"), "id"
    )


@query(
    "latest_filled_status",
    f"""WITH {d.HEALTH} SELECT livestock_id, recovery_status, id FROM health WHERE trim(recovery_status) <> ''
        QUALIFY row_number() OVER (PARTITION BY livestock_id ORDER BY created_at DESC, id) = 1""",
)
def latest_filled_status(spark, sf_dir):
    rows = latest.latest_filled(d.health_records(spark, sf_dir), ["livestock_id"], "recovery_status", F.col("created_at"), "id")
    return rows.select("livestock_id", "recovery_status", "id")


@query(
    "vaccination_due_status",
    f"""WITH {d.ANIMALS}, {d.VACCINATIONS}, f AS (SELECT livestock_id, bool_or(coalesce(next_due_date < DATE '{d.AS_OF}', false)) AS o,
          bool_or(coalesce(next_due_date BETWEEN DATE '{d.AS_OF}' AND DATE '{d.AS_OF}' + 7, false)) AS s FROM vaccinations GROUP BY 1)
        SELECT id, CASE WHEN o IS NULL THEN 'No records' WHEN o THEN 'Overdue' WHEN s THEN 'Due Soon' ELSE 'Up to date' END AS vaccination_status
        FROM animals LEFT JOIN f ON id = livestock_id""",
)
def vaccination_due_status(spark, sf_dir):
    rows = latest.due_status(
        d.animals(spark, sf_dir), d.vaccinations(spark, sf_dir), "id", "livestock_id", F.col("next_due_date"), d.as_of()
    )
    return rows.select("id", "vaccination_status")


@query(
    "newest_records",
    f"""WITH {d.HEALTH} SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id) AS position FROM health""",
)
def newest_records(spark, sf_dir):
    rows = latest.newest_first(d.health_records(spark, sf_dir).select("id", "created_at"), F.col("created_at"), "id")
    return rows.select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "position")


@query(
    "newest_per_animal",
    f"""WITH {d.HEALTH} SELECT livestock_id, id, row_number() OVER (PARTITION BY livestock_id ORDER BY created_at DESC, id) AS position FROM health""",
)
def newest_per_animal(spark, sf_dir):
    rows = d.health_records(spark, sf_dir).select("livestock_id", "id", "created_at")
    return latest.newest_first_per(rows, ["livestock_id"], F.col("created_at"), "id").select("livestock_id", "id", "position")


@query(
    "recent_records",
    f"""WITH {d.HEALTH} SELECT livestock_id, id, rank FROM (SELECT livestock_id, id, row_number() OVER (PARTITION BY livestock_id ORDER BY created_at DESC, id) AS rank FROM health) WHERE rank <= 6""",
)
def recent_records(spark, sf_dir):
    rows = latest.top_per_group(d.health_records(spark, sf_dir), ["livestock_id"], [F.col("created_at").desc(), F.col("id")], 6)
    return rows.select("livestock_id", "id", "rank")


@query(
    "earliest_due_dates",
    f"""WITH {d.VACCINATIONS} SELECT id, next_due_date, row_number() OVER (ORDER BY next_due_date ASC NULLS LAST, id) AS position FROM vaccinations""",
)
def earliest_due_dates(spark, sf_dir):
    rows = d.vaccinations(spark, sf_dir).select("id", "next_due_date")
    return latest.due_first(rows, F.col("next_due_date"), "id").select("id", "next_due_date", "position")


@query(
    "species_order",
    f"""WITH {d.ANIMALS}, s AS (SELECT id, animal_name, {d.DISPLAY_SPECIES_SQL.format(s='species')} AS shown FROM animals)
        SELECT id, shown, row_number() OVER (ORDER BY CASE lower(shown) WHEN 'dairy cattle' THEN 0 ELSE 3 END, animal_name NULLS FIRST, id) AS position FROM s""",
)
def species_order(spark, sf_dir):
    rows = d.animals(spark, sf_dir).withColumn("shown", text.display_species(F.col("species")))
    rows = rows.select("id", "shown", "animal_name")
    return latest.by_species(rows, F.col("shown"), F.col("animal_name"), "id").select("id", "shown", "position")


@query(
    "largest_groups",
    """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, o_custkey LIMIT 10)
       SELECT o_custkey, count(*) AS rows, round(avg(o_totalprice), 4) AS mean_price FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c) GROUP BY 1""",
)
def largest_groups(spark, sf_dir):
    rows = latest.largest_groups(table(spark, sf_dir, "orders"), "o_custkey", 10, 5)
    return rounded(rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows"), F.avg("o_totalprice").alias("mean_price")))


@query(
    "first_of_code",
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)
       SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, event_id)::INTEGER AS position FROM f""",
)
def first_of_code(spark, sf_dir):
    return latest.first_of_code(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ["error", "purchase"])


FEED_SQL = f"""{d.ANIMALS}, {d.BATCHES}, feed_all AS (
  SELECT user_id, 'livestock-' || id AS activity_id, 'Livestock added' AS kind, coalesce(nullif(animal_name, ''), 'Livestock record') AS title,
    'ID: ' || coalesce(nullif(animal_id, ''), 'Unavailable') || ' • ' || {d.DISPLAY_SPECIES_SQL.format(s='species')} AS detail, created_at AS occurred_at FROM animals
  UNION ALL SELECT user_id, 'batch-' || id, 'Batch created', coalesce(nullif(batch_name, ''), 'Batch record'),
    'Dairy Cattle • ' || coalesce(head_count::VARCHAR, 'NaN') || ' recorded', created_at FROM batches)"""


@query("activity_feed", f"WITH {FEED_SQL} SELECT * FROM feed_all")
def activity_feed(spark, sf_dir):
    rows = latest.activity_feed(d.animals(spark, sf_dir), d.batches(spark, sf_dir))
    return rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


@query(
    "recent_activity",
    f"""WITH {FEED_SQL} SELECT user_id, activity_id, rank FROM (SELECT user_id, activity_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, activity_id)::INTEGER AS rank FROM feed_all) WHERE rank <= 6""",
)
def recent_activity(spark, sf_dir):
    rows = latest.activity_feed(d.animals(spark, sf_dir), d.batches(spark, sf_dir))
    top = latest.top_per_group(rows, ["user_id"], [F.col("occurred_at").desc(), F.col("activity_id")], 6)
    return top.select("user_id", "activity_id", "rank")


UPSERT = """cur AS (SELECT user_id AS id, 'o' || floor(user_id / 10)::BIGINT::VARCHAR AS owner, max(ts) AS t, 'old' AS note FROM events WHERE event_type = 'view' GROUP BY 1, 2),
  inc AS (SELECT user_id AS id, CASE WHEN event_type = 'error' THEN 'thief' ELSE 'o' || floor(user_id / 10)::BIGINT::VARCHAR END AS owner, ts AS t, props AS note, event_id FROM events WHERE event_type <> 'view' AND value > 100),
  new AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY id, owner ORDER BY t DESC, event_id) = 1),
  ok AS (SELECT new.* FROM new LEFT JOIN cur USING (id) WHERE cur.id IS NULL OR cur.owner = new.owner)"""


@query(
    "owned_upsert",
    f"""WITH {UPSERT} SELECT id, owner, t, note FROM ok UNION ALL SELECT id, owner, t, note FROM cur WHERE id NOT IN (SELECT id FROM ok)""",
)
def owned_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    home = F.concat(F.lit("o"), F.floor(F.col("user_id") / 10).cast("string"))
    current = (
        e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("id"), home.alias("owner"))
        .agg(F.max("ts").alias("t")).withColumn("note", F.lit("old"))
    )
    incoming = e.filter("event_type <> 'view' and value > 100").select(
        F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "thief").otherwise(home).alias("owner"),
        F.col("ts").alias("t"), F.col("props").alias("note"), "event_id",
    )
    rows = latest.owned_upsert(current, incoming, "id", "owner", F.col("t"), "event_id")
    return rows.withColumn("t", F.col("t").cast("timestamp_ntz"))


LINKS = f"{d.ANIMALS}, {d.BATCHES}, {d.VACCINATIONS}, {d.LINKED}"
VACCINE_ALERTS = f"""va AS (SELECT *, date_diff('day', DATE '{d.AS_OF}', next_due_date) AS days,
    coalesce(nullif(trim(vaccine_name), ''), 'Vaccination') AS vaccine,
    coalesce(nullif(trim(animal__animal_name), ''), nullif(trim(batch__batch_name), ''), CASE WHEN target_type = 'Batch' OR batch_id IS NOT NULL THEN 'Batch record' ELSE 'Livestock record' END) AS related
    FROM linked),
  vaccine_alerts AS (SELECT user_id, CASE WHEN days < 0 THEN 'overdue-' ELSE 'upcoming-' END || id AS alert_id, CASE WHEN days < 0 THEN 'vaccination_overdue' ELSE 'vaccination_upcoming' END AS kind,
    related AS related_name, CASE WHEN days < 0 THEN 'High' WHEN days <= 3 THEN 'Medium' ELSE 'Low' END AS priority,
    CASE WHEN days < 0 THEN vaccine || ' was due on ' || next_due_date::VARCHAR WHEN days = 0 THEN vaccine || ' is due today' ELSE vaccine || ' is due in ' || days::VARCHAR || ' day' || CASE WHEN days = 1 THEN '' ELSE 's' END END
      || ' for ' || related || CASE WHEN animal__animal_id IS NOT NULL THEN ' (' || animal__animal_id || ')' ELSE '' END || '.' AS message, next_due_date AS sort_date FROM va WHERE days <= 7)"""


@query("vaccination_alerts", f"WITH {LINKS}, {VACCINE_ALERTS} SELECT * FROM vaccine_alerts")
def vaccination_alerts(spark, sf_dir):
    return alerts.vaccination_alerts(_linked(spark, sf_dir), d.as_of())


STOCK_ALERTS = """stock_alerts AS (SELECT user_id, 'feed-' || id AS alert_id, 'low_feed' AS kind, coalesce(nullif(trim(target_animal), ''), nullif(trim(feed_name), ''), 'Feed item') AS related_name,
  CASE WHEN quantity = 0 THEN 'High' ELSE 'Medium' END AS priority, coalesce(nullif(trim(feed_name), ''), 'Feed item') || ' is running low' AS message, NULL::DATE AS sort_date FROM feed WHERE quantity <= low_stock_threshold)"""


@query("low_stock_alerts", f"WITH {d.FEED}, {STOCK_ALERTS} SELECT * FROM stock_alerts")
def low_stock_alerts(spark, sf_dir):
    return alerts.stock_alerts(d.feed_items(spark, sf_dir))


HEALTH_ALERTS = """ha AS (SELECT h.*, coalesce(nullif(trim(recovery_status), ''), 'Needs review') AS status, lower(coalesce(nullif(trim(recovery_status), ''), 'Needs review')) AS k
    FROM health h WHERE livestock_id IS NULL OR livestock_id IN (SELECT id FROM animals)),
  hk AS (SELECT *, unnest(['health_alert', 'health_urgent', 'health_follow_up']) AS kind FROM ha WHERE k IN ('in treatment', 'sick', 'critical', 'under treatment', 'recovering')),
  health_alerts AS (SELECT user_id, CASE kind WHEN 'health_alert' THEN 'health-' WHEN 'health_urgent' THEN 'urgent-' ELSE 'follow-up-' END || id::VARCHAR AS alert_id, kind, 'Health record' AS related_name,
    CASE WHEN k IN ('critical', 'sick') THEN 'High' WHEN k = 'recovering' THEN 'Low' ELSE 'Medium' END AS priority, coalesce(nullif(disease_type, ''), 'Health issue') || ' - ' || status AS message, created_at::DATE AS sort_date
    FROM hk WHERE kind = 'health_alert' OR (kind = 'health_urgent' AND k IN ('critical', 'sick')) OR (kind = 'health_follow_up' AND k IN ('in treatment', 'under treatment', 'recovering')))"""


@query("health_alerts", f"WITH {d.ANIMALS}, {d.HEALTH}, {HEALTH_ALERTS} SELECT * FROM health_alerts")
def health_alerts(spark, sf_dir):
    return alerts.health_alerts(d.health_records(spark, sf_dir), d.animals(spark, sf_dir))


ALL_ALERTS = f"""{LINKS}, {d.FEED}, {d.HEALTH}, {VACCINE_ALERTS}, {STOCK_ALERTS}, {HEALTH_ALERTS},
  alerts AS (SELECT * FROM vaccine_alerts UNION ALL SELECT * FROM stock_alerts UNION ALL SELECT * FROM health_alerts),
  sections AS (SELECT *, CASE WHEN kind IN ('health_urgent', 'vaccination_overdue', 'low_feed') THEN 'urgent' WHEN kind IN ('vaccination_upcoming', 'health_follow_up') THEN 'upcoming' ELSE 'recent' END AS section FROM alerts)"""


def _sections(spark, sf_dir):
    return alerts.alert_sections([vaccination_alerts(spark, sf_dir), low_stock_alerts(spark, sf_dir), health_alerts(spark, sf_dir)])


@query(
    "alert_sections",
    f"WITH {ALL_ALERTS} SELECT user_id, section, kind, priority, count(*) AS alerts, min(sort_date) AS first_date FROM sections GROUP BY 1, 2, 3, 4",
)
def alert_sections(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("user_id", "section", "kind", "priority").agg(
        F.count(F.lit(1)).alias("alerts"), F.min("sort_date").alias("first_date")
    )


@query(
    "urgent_alerts_by_priority",
    f"""WITH {ALL_ALERTS} SELECT alert_id, priority, sort_date, row_number() OVER (
          ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, coalesce(sort_date, DATE '1970-01-01') DESC, alert_id) AS position FROM sections WHERE section = 'urgent'""",
)
def urgent_alerts_by_priority(spark, sf_dir):
    urgent = _sections(spark, sf_dir).filter("section = 'urgent'").select("alert_id", "priority", "sort_date")
    rows = latest.by_priority(urgent, F.col("priority"), F.col("sort_date").cast("timestamp"), "alert_id")
    return rows.select("alert_id", "priority", "sort_date", "position")


@query(
    "attention_counts",
    f"""WITH {LINKS}, {d.HEALTH}, {d.FEED}, st AS (SELECT livestock_id, {d.HEALTH_FOLD_SQL.format(s='recovery_status')} AS s FROM health QUALIFY row_number() OVER (PARTITION BY livestock_id ORDER BY created_at DESC, id) = 1),
        c AS (SELECT user_id, sum((next_due_date < DATE '{d.AS_OF}')::INT) AS a, sum((next_due_date BETWEEN DATE '{d.AS_OF}' AND DATE '{d.AS_OF}' + 30)::INT) AS b, 0 AS e, 0 AS f, 0 AS g FROM linked GROUP BY 1
          UNION ALL SELECT user_id, 0, 0, sum((coalesce(s, 'Healthy') <> 'Healthy')::INT), sum((trim(animal_name) = '' OR trim(animal_id) = '' OR trim(species) = '' OR trim(breed) = '' OR TRY_CAST(age AS DOUBLE) IS NULL OR TRY_CAST(weight AS DOUBLE) IS NULL)::INT), 0
            FROM animals LEFT JOIN st ON id = livestock_id GROUP BY 1
          UNION ALL SELECT user_id, 0, 0, 0, 0, sum((coalesce(quantity, 0) <= coalesce(low_stock_threshold, 0))::INT) FROM feed GROUP BY 1)
        SELECT user_id, coalesce(sum(a), 0)::BIGINT AS overdue_vaccinations, coalesce(sum(b), 0)::BIGINT AS due_soon_vaccinations, sum(e)::BIGINT AS health_alerts, sum(f)::BIGINT AS incomplete_profiles, sum(g)::BIGINT AS low_feed_alerts FROM c GROUP BY 1""",
)
def attention_counts(spark, sf_dir):
    return alerts.attention_counts(_with_status(spark, sf_dir), _linked(spark, sf_dir), d.feed_items(spark, sf_dir), d.as_of())


@query(
    "upcoming_vaccinations",
    f"""WITH {LINKS} SELECT user_id, id, next_due_date AS due_date, CASE WHEN next_due_date <= DATE '{d.AS_OF}' + 7 THEN 'Due within 7 days' ELSE 'Due within 30 days' END AS status, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_due_date, id)::INTEGER AS rank FROM linked WHERE next_due_date BETWEEN DATE '{d.AS_OF}' AND DATE '{d.AS_OF}' + 30) WHERE rank <= 6""",
)
def upcoming_vaccinations(spark, sf_dir):
    rows = alerts.upcoming_vaccinations(_linked(spark, sf_dir), d.as_of())
    return latest.top_per_group(rows, ["user_id"], [F.col("due_date"), F.col("id")], 6)


@query("species_overview", f"WITH {d.ANIMALS} SELECT user_id, {d.DISPLAY_SPECIES_SQL.format(s='species')} AS label, count(*) AS count FROM animals GROUP BY 1, 2")
def species_overview(spark, sf_dir):
    return alerts.species_overview(d.animals(spark, sf_dir))


@query("batch_overview", f"WITH {d.BATCHES} SELECT user_id, count(*) AS total_batches, sum(coalesce(head_count, 0))::DOUBLE AS recorded_head_count FROM batches GROUP BY 1")
def batch_overview(spark, sf_dir):
    return alerts.batch_overview(d.batches(spark, sf_dir))


@query(
    "stock_series",
    f"WITH {d.FEED} SELECT user_id, coalesce(nullif(trim(feed_name), ''), 'Feed item') AS name, coalesce(quantity, 0)::DOUBLE AS quantity, coalesce(low_stock_threshold, 0)::DOUBLE AS threshold FROM feed",
)
def stock_series(spark, sf_dir):
    return alerts.stock_series(d.feed_items(spark, sf_dir))


@query(
    "profile_gaps",
    f"""WITH {d.ANIMALS} SELECT user_id, count(*) AS animals, count(*) FILTER (WHERE trim(animal_name) = '' OR trim(species) = '' OR TRY_CAST(age AS DOUBLE) IS NULL) AS gaps FROM animals GROUP BY 1""",
)
def profile_gaps(spark, sf_dir):
    gap = requests.profile_gap([F.col("animal_name"), F.col("species")], [F.col("age")])
    return d.animals(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("animals"), F.count_if(gap).alias("gaps"))

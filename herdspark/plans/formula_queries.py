"""The stated herd formulas, all of them, over line items under the study's column names."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdspark.operators import formulas
from herdspark.plans.registry import query, table
from herdspark.plans.rule_queries import FORMULA_STATUS
from herdspark.plans.summary_queries import rounded

# Given columns: plain name, the study's name, SQL text.
GIVEN = (
    ("days", "daysinmilk", "l_quantity * 5"), ("hand", "hand-milked yield", "l_linenumber * 2"), ("potential", "potentialmilk", "l_quantity + 1"),
    ("body", "Bodyweight", "l_quantity + 300"), ("served", "DM served", "l_linenumber + 10"), ("rest", "leftover", "l_quantity / 10"),
    ("ndf", "NDF feeds", "l_quantity + 20"), ("water", "waterday", "l_quantity * 2"), ("protein", "%Protein", "l_linenumber + 5"),
    ("g24", "G24", "1"), ("mefeeds", "MEfeeds", "l_quantity / 5"),
)
CALF = "CASE WHEN days <= 60 THEN 6 WHEN days <= 90 THEN 4 WHEN days <= 120 THEN 2 WHEN days <= 200 THEN 1 ELSE 0 END"
PERIOD = "CASE WHEN days <= 100 THEN 'Peak' WHEN days <= 200 THEN 'Mid' ELSE 'Late' END"
# Stored results: plain name, the study's name, what they should be.
STORED = (
    ("calf", "Ass.calfmilk", CALF), ("total", "Total milk performance", "calf + hand"), ("gapmilk", "gapmilk", "potential - total"),
    ("pgapmilk", "%gapmilk", "gapmilk * 100 / potential"), ("mw", "MW", "pow(body, 0.75)"), ("dmir", "DMIR kg", "body * 0.035"),
    ("capacity", "DMIcapacity (kgDM)", "served - rest"), ("dindex", "DMIindex", "120 / ndf"), ("dgap", "DMI gap", "dmir - capacity"),
    ("pdgap", "%gapDMI", "dgap * 100 / dmir"), ("wreq", "waterrequi.", "12.3 + dmir * 2.15 + potential * 0.73"), ("wgap", "gapwater", "wreq - water"),
    ("pwgap", "%watergap", "wgap * 100 / wreq"), ("cpkg", "Protein/content/gr/kg", "protein * 10"), ("cpin", "Cpintakeingr", "cpkg * capacity"),
    ("cpmaint", "CPmaint=6.27*MW", "mw * 6.27"), ("cpmilk", "CPmilk", "potential * 82"), ("cpreq", "TotalreqCP", "cpmaint + cpmilk"),
    ("cpgap", "gapCP", "cpreq - cpin"), ("pcpgap", "%CP gap", "cpgap * 100 / cpreq"), ("mein", "MEIntake", "mefeeds * capacity"),
    ("memaint", "MW*0.589=Energyformaintenance", "mw * 0.589"), ("mepeak", "5.023*peakMilk", "potential * 5.023"),
    ("mereq", "MEmaint+peakmilk", "memaint + mepeak"), ("megap", "gapME", "mereq - mein"), ("pmegap", "%MEgap", "megap * 100 / mereq"),
)
# Line 2 is off by a rounding, line 3 is wrong, line 4 has no stored value.
OFF = "CASE l_linenumber WHEN 2 THEN 0.005 WHEN 3 THEN 1.0 WHEN 4 THEN NULL ELSE 0.0 END"
STORED_PERIOD = f"CASE l_linenumber WHEN 3 THEN 'none' WHEN 4 THEN NULL ELSE upper({PERIOD}) END"
# Formula, domain, stored column, expected text; the interpretation where it is not the documented one.
EXPECTED = (
    ("MILK-001", "MILK", "calf", CALF), ("MILK-002", "MILK", "total", "calf + hand"), ("MILK-003", "MILK", "gapmilk", "potential - total"),
    ("MILK-004", "MILK", "pgapmilk", "gapmilk * 100 / potential"), ("ANIMAL-001", "ANIMAL", "mw", "pow(body, 0.75)"),
    ("DMI-001", "DMI", "dmir", "body * 0.035"), ("DMI-002A", "DMI", "capacity", "served - rest", "DOCUMENTED_DMI_INTAKE_EQUATION"),
    ("DMI-002B", "DMI", "capacity", "120 / ndf * body / 100", "DOCUMENTED_CAPACITY_EQUATION"), ("DMI-003", "DMI", "dindex", "120 / ndf"),
    ("DMI-004", "DMI", "dgap", "dmir - capacity"), ("DMI-005", "DMI", "pdgap", "dgap * 100 / dmir"),
    ("WATER-001", "WATER", "wreq", "12.3 + dmir * 2.15 + potential * 0.73"), ("WATER-002", "WATER", "wgap", "wreq - water"),
    ("WATER-003", "WATER", "pwgap", "wgap * 100 / wreq"), ("CP-001", "PROTEIN", "cpkg", "protein * 10"), ("CP-002", "PROTEIN", "cpin", "cpkg * capacity"),
    ("CP-003", "PROTEIN", "cpmaint", "mw * 6.27"), ("CP-004", "PROTEIN", "cpmilk", "potential * 82"), ("CP-005", "PROTEIN", "cpreq", "cpmaint + cpmilk"),
    ("CP-006A", "PROTEIN", "cpgap", "cpreq - cpin", "REPOSITORY_FORMULA"), ("CP-006B", "PROTEIN", "cpgap", "cpreq - cpmaint", "METADATA_FORMULA"),
    ("CP-007", "PROTEIN", "pcpgap", "cpgap * 100 / cpreq"), ("ME-002", "ENERGY", "mein", "mefeeds * capacity"), ("ME-003", "ENERGY", "memaint", "mw * 0.589"),
    ("ME-004", "ENERGY", "mepeak", "potential * 5.023"), ("ME-005", "ENERGY", "mereq", "memaint + mepeak"), ("ME-006", "ENERGY", "megap", "mereq - mein"),
    ("ME-007", "ENERGY", "pmegap", "megap * 100 / mereq"),
)
NAMES = {plain: name for plain, name, _ in (*GIVEN, *STORED)}


def _cell(fid: str, domain: str, stored: str, expected: str, said: str = "DOCUMENTED", label: bool = False) -> str:
    expected = expected if label else f"CAST({expected} AS DOUBLE)"
    diff = "CAST(NULL AS DOUBLE)" if label else f"abs({stored} - {expected})"
    exact = f"lower({stored}) = lower({expected})" if label else f"{diff} <= 1e-9"
    close = "false" if label else f"{diff} <= 0.01"
    both = f"{expected} IS NOT NULL AND {stored} IS NOT NULL"
    name = "lactationperiod" if label else NAMES[stored]
    return f"""SELECT '{fid}' AS formula_id, '{domain}' AS domain, '{name}' AS target_field, '{said}' AS interpretation, count({stored}) AS stored_value_count, '' AS missing_required_columns,
      count(*) AS row_count, count({expected}) AS calculable_row_count, count(*) FILTER (WHERE {both} AND {exact}) AS exact_match_count,
      count(*) FILTER (WHERE {both} AND {close} AND NOT {exact}) AS tolerance_match_count, count(*) FILTER (WHERE {both} AND NOT {exact} AND NOT {close}) AS mismatch_count,
      count(*) - count({expected}) AS missing_input_row_count, count(*) FILTER (WHERE {expected} IS NOT NULL AND {stored} IS NULL) AS stored_missing_with_inputs_count,
      round(max({diff}), 4) AS maximum_absolute_difference FROM study"""


def _check_sql() -> str:
    given = ", ".join(f"CAST({text} AS DOUBLE) AS {plain}" for plain, _, text in GIVEN)
    study = f"SELECT l_linenumber, {given} FROM lineitem"
    for plain, _, text in STORED:
        study = f"SELECT *, CAST({text} AS DOUBLE) + {OFF} AS {plain} FROM ({study})"
    cells = [_cell(*row) for row in EXPECTED] + [_cell("LACTATION-001", "LACTATION", "period", PERIOD, label=True)]
    return f"""WITH study AS MATERIALIZED (SELECT *, {STORED_PERIOD} AS period FROM ({study})), a AS ({" UNION ALL ".join(cells)})
      SELECT *, {FORMULA_STATUS} FROM a
      UNION ALL SELECT 'MILK-005', 'MILK', 'potentialmilk', 'MODEL_DERIVED_UNDOCUMENTED_ALGORITHM', count(potential), '', count(*), 0, 0, 0, 0, 0, 0, NULL, 'FORMULA_NOT_DOCUMENTED' FROM study
      UNION ALL SELECT 'ME-001', 'ENERGY', 'MEfeeds', 'DOCUMENTED', count(mefeeds), '', count(*), 0, 0, 0, 0, 0, 0, NULL, 'FORMULA_NOT_DOCUMENTED' FROM study"""


@query("herd_formula_audit", _check_sql())
def herd_formula_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", *[F.expr(text).cast("double").alias(plain) for plain, _, text in GIVEN])
    for plain, _, text in STORED:
        rows = rows.withColumn(plain, F.expr(text).cast("double") + F.expr(OFF).cast("double"))
    study = rows.select(
        F.expr(STORED_PERIOD).alias("lactationperiod"), *[F.col(plain).alias(name) for plain, name in NAMES.items()]
    )
    return rounded(formulas.audit_formulas(study, formulas.herd_formulas()))

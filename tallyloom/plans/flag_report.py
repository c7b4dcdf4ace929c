"""Queries of flags as cells of report templates, and of the tables of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import flag_report, return_grid
from tallyloom.operators.rule_packs import loan_flags, threshold_flags
from tallyloom.plans.grid_inputs import TOTALS_SQL, broken_grid
from tallyloom.plans.registry import ORACLES, query
from tallyloom.sources.filings import company_metrics

#: Rules on loans and the row of their label in the template; two rules have none.
LOAN_ROWS = [*[(f"COMP_SEC_188_{i}", 5 + i) for i in range(10) if i != 3], ("COMP_SEC_186_LOANS", 20), ("COMP_SEC_186_SEC", 21), ("COMP_SEC_186_L1", 22), ("COMP_SEC_185_BASE", 25), ("COMP_SEC_185_EXC1", 26), ("COMP_SEC_185_EXC2", 27), ("COMP_SEC_185_EXC3", 28)]


def _flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    metrics = company_metrics(spark, sf_dir)
    label = F.concat(F.lit("Rule: "), F.replace("rule_id", F.lit("_"), F.lit(" ")))
    return tuple(pack(metrics).withColumns({"particulars": label, "reason": F.concat(F.lit("is "), "status")}) for pack in (threshold_flags, loan_flags))


def _template(spark: SparkSession) -> DataFrame:
    rows = [(f"  RULE {r.replace('_', '-').lower()}.", n) for r, n in LOAN_ROWS]
    return spark.createDataFrame([*rows, (rows[0][0], 1), ("", 99)], "particulars string, row_no int")


LOAN_ROWS_SQL = ", ".join(f"('{r}', {n})" for r, n in LOAN_ROWS)


@query(
    "j4_template_cells",
    f"""WITH f AS ({ORACLES["rules_loans"]}), t(rule_id, row_no) AS (VALUES {LOAN_ROWS_SQL}), j AS (SELECT *, rule_id LIKE 'COMP_SEC_185%' OR rule_id LIKE 'COMP_SEC_186%' AS applies FROM f JOIN t USING (rule_id))
    SELECT filing_id, 'loans' AS sheet, CASE WHEN applies THEN 'D' ELSE 'G' END || row_no AS cell, user_value AS value, NULL::DOUBLE AS amount FROM j
    UNION ALL SELECT filing_id, 'loans', 'F' || row_no, NULL, round(actual_value, 2) FROM j WHERE actual_value <> 0
    UNION ALL SELECT filing_id, 'errors', 'C' || row_no, user_value, NULL FROM j UNION ALL SELECT filing_id, 'errors', 'D' || row_no, 'is ' || status, NULL FROM j""",
)
def j4_template_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, template = _flags(spark, sf_dir)[1], _template(spark)
    cells = flag_report.by_label(flags, template, "loans").union(flag_report.by_label(flags, template, "errors"))
    amount = F.col("cell").startswith("F")
    return cells.select("filing_id", "sheet", "cell", F.when(~amount, F.col("value")).alias("value"), F.when(amount, F.round(F.col("value").try_cast("double"), 2)).alias("amount"))


@query("j4_unmatched_flags", f"WITH f AS ({ORACLES['rules_loans']}), t(rule_id, row_no) AS (VALUES {LOAN_ROWS_SQL}) SELECT 'Rule: ' || replace(rule_id, '_', ' ') AS particulars, count(*) AS n FROM f ANTI JOIN t USING (rule_id) GROUP BY 1")
def j4_unmatched_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_report.unmatched(_flags(spark, sf_dir)[1], _template(spark))


@query(
    "j5_rule_rows",
    f"""WITH f AS ({ORACLES["rules_threshold"]}), t(rule_id, n) AS (VALUES {", ".join(f"('{r}', {35 + i})" for i, r in enumerate(flag_report.RULE_ORDER))}), c AS (SELECT unnest(['C', 'D', 'E', 'F', 'G']) AS col)
    SELECT filing_id, 'compliance' AS sheet, col || n AS cell, CASE col WHEN 'C' THEN 'Rule: ' || replace(rule_id, '_', ' ') WHEN 'D' THEN user_value WHEN 'E' THEN 'is ' || status ELSE '' END AS value FROM f JOIN t USING (rule_id), c""",
)
def j5_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_report.by_rule(flag_report.all_flags(*_flags(spark, sf_dir)))


@query(
    "s16_report_tables",
    f"""WITH f AS ({ORACLES["rules_threshold"]}), l AS ({ORACLES["rules_loans"]}), {TOTALS_SQL}
    SELECT 'errors' AS report, filing_id::VARCHAR AS filing_id, rule_id AS what FROM f WHERE status = 'Failed' UNION ALL SELECT 'errors', filing_id::VARCHAR, rule_id FROM l WHERE status = 'Failed'
    UNION ALL SELECT 'consistency', filing_id::VARCHAR, ['equity_capital', 'paid_up_capital', 'nonresident_percent', 'retained_profit', 'net_worth', 'purchases', 'direct_investors', 'overseas_net_worth'][filing_id % 9 + 1] FROM c WHERE filing_id % 9 < 8""",
)
def s16_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = flag_report.all_flags(*_flags(spark, sf_dir)).filter("status = 'Failed'")
    checks = return_grid.checks(broken_grid(spark, sf_dir)).filter("not passed")
    rows = flag_report.report_tables({"errors": errors, "consistency": checks})
    return rows.select("report", "filing_id", F.coalesce(F.get_json_object("row", "$.rule_id"), F.get_json_object("row", "$.check")).alias("what"))


@query("s13_validation_summary", f"WITH {TOTALS_SQL} SELECT filing_id, CASE WHEN filing_id % 9 < 8 THEN '7' ELSE '8' END || ' / 8 checks passed' AS summary FROM c")
def s13_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_report.validation_summary(return_grid.checks(broken_grid(spark, sf_dir)))

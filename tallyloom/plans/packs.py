"""Queries of the rule packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.rule_packs import loan_flags, threshold_flags
from tallyloom.plans.registry import query
from tallyloom.sources.filings import METRICS_SQL, company_metrics


@query(
    "rules_threshold",
    f"""WITH {METRICS_SQL},
    z AS (SELECT *, coalesce(turnover, 0) AS t, coalesce(puc, 0) AS p, coalesce(reserves, 0) AS r, coalesce(borrowings, 0) AS b, coalesce(pbt, 0) AS f,
      CASE WHEN coalesce(net_worth, 0) = 0 THEN coalesce(puc, 0) + coalesce(reserves, 0) ELSE net_worth END AS w,
      company_type LIKE 'Private%' AS pvt, company_type LIKE 'Public%' AS pub FROM metrics),
    y AS (SELECT *, coalesce(mca_small, t < 1e9 AND p < 1e8 AND NOT group_company) AS small,
      coalesce(sale_goods, 0) + coalesce(purchase_goods, 0) + coalesce(remun, 0) > 0 AS related FROM z),
    x AS (SELECT filing_id, small, corporate, unnest([
      {{'i': 'COMP_CARO', 'a': CASE WHEN pvt AND NOT small THEN p + r > 1e7 OR b > 1e7 OR t > 1e8 ELSE NOT small AND NOT company_type LIKE 'One Person%' END}},
      {{'i': 'COMP_CSR', 'a': w >= 5e9 OR t >= 1e10 OR f >= 5e7}},
      {{'i': 'COMP_ROTATION', 'a': listed OR pub OR (pvt AND p >= 5e8)}},
      {{'i': 'COMP_XBRL', 'a': listed OR ind_as OR p >= 5e7 OR t >= 1e9}},
      {{'i': 'COMP_VIGIL', 'a': b > 5e8}},
      {{'i': 'COMP_IFC', 'a': NOT pvt OR t >= 5e8 OR b >= 2.5e8}},
      {{'i': 'COMP_INT_AUDIT', 'a': t >= 2e9 OR b >= 1e9}},
      {{'i': 'COMP_IND_AS', 'a': ind_as OR listed OR w >= 2.5e9}},
      {{'i': 'COMP_MGT_8', 'a': listed OR p >= 1e8 OR t >= 5e8}},
      {{'i': 'COMP_MGT_7_CERT', 'a': NOT small}},
      {{'i': 'COMP_SEC_AUDIT', 'a': listed OR b >= 1e9 OR (pub AND (p >= 5e8 OR t >= 2.5e9))}},
      {{'i': 'COMP_KMP', 'a': listed OR p >= 1e8}},
      {{'i': 'COMP_LOAN_186', 'a': loans_text OR coalesce(loans_given, 0) > 0 OR coalesce(loans_total, 0) > 0}},
      {{'i': 'COMP_LOAN_DIRECTOR', 'a': coalesce(to_directors, 0) > 0}},
      {{'i': 'COMP_COST_AUDIT', 'a': false}},
      {{'i': 'COMP_CHARGE_FORM', 'a': coalesce(secured, 0) > 0}},
      {{'i': 'COMP_AOC_1', 'a': holding}},
      {{'i': 'COMP_AOC_2', 'a': related}},
      {{'i': 'COMP_RPT_OMNIBUS', 'a': related}},
      {{'i': 'COMP_CSR_COMMITTEE', 'a': f * 3 * 0.02 > 5e6}},
      {{'i': 'COMP_DEPOSIT_DEC', 'a': coalesce(from_directors, 0) > 0}},
      {{'i': 'COMP_DPT_3', 'a': b + coalesce(advances, 0) > 0}},
      {{'i': 'COMP_MSME', 'a': coalesce(msme, 0) > 0}}]) AS u FROM y)
    SELECT filing_id, u.i AS rule_id, CASE WHEN u.a THEN 'Failed' ELSE 'Passed' END AS status, CASE WHEN u.a THEN 'Applicable' ELSE 'Not Applicable' END AS user_value FROM x
    UNION ALL SELECT filing_id, 'COMP_SMALL_CO', CASE WHEN small THEN 'Passed' ELSE 'Failed' END, CASE WHEN small THEN 'Yes' ELSE 'No' END FROM y
    UNION ALL SELECT filing_id, 'COMP_BEN_2', CASE WHEN corporate IS NULL THEN 'Manual' WHEN corporate THEN 'Failed' ELSE 'Passed' END,
      CASE WHEN corporate IS NULL THEN 'Missing Data' WHEN corporate THEN 'Applicable' ELSE 'Not Applicable' END FROM y""",
)
def rules_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_flags(company_metrics(spark, sf_dir)).select("filing_id", "rule_id", "status", "user_value")


@query(
    "rules_loans",
    f"""WITH {METRICS_SQL},
    x AS (SELECT filing_id, unnest([
      {{'i': 'COMP_SEC_188_0', 'a': coalesce(sale_goods, 0), 'l': prev_turnover * 0.10}},
      {{'i': 'COMP_SEC_188_1', 'a': coalesce(purchase_goods, 0), 'l': prev_turnover * 0.10}},
      {{'i': 'COMP_SEC_188_2', 'a': coalesce(sale_property, 0), 'l': prev_net_worth * 0.10}},
      {{'i': 'COMP_SEC_188_3', 'a': 0, 'l': prev_net_worth * 0.10}},
      {{'i': 'COMP_SEC_188_4', 'a': 0, 'l': prev_net_worth * 0.10}},
      {{'i': 'COMP_SEC_188_5', 'a': 0, 'l': prev_turnover * 0.10}},
      {{'i': 'COMP_SEC_188_6', 'a': 0, 'l': prev_turnover * 0.10}},
      {{'i': 'COMP_SEC_188_7', 'a': coalesce(lease, 0), 'l': prev_turnover * 0.10}},
      {{'i': 'COMP_SEC_188_8', 'a': coalesce(remun, 0), 'l': 250000}},
      {{'i': 'COMP_SEC_188_9', 'a': 0, 'l': prev_net_worth * 0.01}}]) AS u FROM metrics)
    SELECT filing_id, u.i AS rule_id, CASE WHEN u.l IS NULL OR u.l = 0 THEN 'Manual' WHEN u.a >= u.l THEN 'Failed' ELSE 'Passed' END AS status,
      CASE WHEN u.l IS NULL OR u.l = 0 THEN 'Missing Data' WHEN u.a >= u.l THEN 'Yes' ELSE 'No' END AS user_value, round(u.a, 2) AS actual_value FROM x
    UNION ALL SELECT filing_id, 'COMP_SEC_186_LOANS', 'Passed', CASE WHEN coalesce(loans_total, 0) > 0 THEN 'Yes' ELSE 'No' END, round(coalesce(loans_total, 0), 2) FROM metrics
    UNION ALL SELECT filing_id, 'COMP_SEC_186_SEC', 'Passed', 'No', 0 FROM metrics
    UNION ALL SELECT filing_id, 'COMP_SEC_186_L1', 'Passed', 'Applicable', round(0.6 * (puc + coalesce(reserves, 0)), 2) FROM metrics
    UNION ALL SELECT filing_id, 'COMP_SEC_186_L2', 'Passed', 'Applicable', round(coalesce(reserves, 0), 2) FROM metrics
    UNION ALL SELECT filing_id, 'COMP_SEC_185_BASE', CASE WHEN director_loans THEN 'Failed' ELSE 'Passed' END, CASE WHEN director_loans THEN 'Yes' ELSE 'No' END, NULL FROM metrics
    UNION ALL SELECT filing_id, 'COMP_SEC_185_EXC1', 'Passed', CASE WHEN body_corporate THEN 'No' ELSE 'Yes' END, NULL FROM metrics
    UNION ALL SELECT filing_id, 'COMP_SEC_185_EXC2', 'Passed', CASE WHEN puc <> 0 AND borrowings < least(2 * puc, 5e8) THEN 'Yes' ELSE 'No' END, round(coalesce(borrowings, 0), 2) FROM metrics
    UNION ALL SELECT filing_id, 'COMP_SEC_185_EXC3', 'Passed', CASE WHEN defaulted THEN 'No' ELSE 'Yes' END, NULL FROM metrics""",
)
def rules_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loan_flags(company_metrics(spark, sf_dir)).select("filing_id", "rule_id", "status", "user_value", F.round("actual_value", 2).alias("actual_value"))

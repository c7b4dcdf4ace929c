"""Queries of what goes into a return grid, of supplied cells and of grids that break each check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import grid_inputs, register, reports, return_grid
from tallyloom.plans.registry import query, table
from tallyloom.plans.returns import HOLDERS_SQL, grid, holders

CHECKS = ("equity_capital", "paid_up_capital", "nonresident_percent", "retained_profit", "net_worth", "purchases", "direct_investors", "overseas_net_worth")
#: Cells of the class totals that the grid's figures are made of.
TOTALS_SQL = f"""{HOLDERS_SQL},
    c AS (SELECT filing_id, coalesce(sum(amount) FILTER (WHERE share_class = 'equity'), 0)::DOUBLE / 100000 AS ea, coalesce(sum(amount) FILTER (WHERE share_class = 'part_pref'), 0)::DOUBLE / 100000 AS pa,
      coalesce(sum(amount) FILTER (WHERE share_class = 'non_part_pref'), 0)::DOUBLE / 100000 AS na FROM h0 GROUP BY 1)"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read from a filing's texts, of every filing, with a register or without."""
    f = F.col("filing_id")
    sums = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 32).alias("filing_id")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.select(
        f, F.when(f % 3 == 0, F.concat(F.lit("L"), f.cast("string"))).when(f % 3 == 1, F.concat(F.lit(" u"), f.cast("string"))).otherwise("").alias("cin_number"), F.when(f % 4 == 0, "Yes").alias("listed_status"),
        F.when(f % 5 == 1, "Thousands").when(f % 5 == 2, "Lakhs").alias("financials_scale"), F.col("total").alias("export_sales_fy"), F.when(f % 2 == 0, 2024).alias("filing_year"), F.when(f % 7 == 0, "30/06/2023").alias("closing_date"),
        (F.col("n") * 10.0).alias("equity_shares_count_fy"), F.lit(2.0).alias("equity_face_value_fy"), F.when(f % 2 == 1, "given").alias("segment"),
    )


@query(
    "g1_grid_inputs",
    f"""WITH {HOLDERS_SQL},
    r AS (SELECT filing_id, sum(securities) FILTER (WHERE share_class = 'equity') AS e, sum(amount) FILTER (WHERE share_class = 'equity')::DOUBLE / 100000 AS ea, count(DISTINCT l_linestatus) FILTER (WHERE share_class = 'equity') AS ec,
      count(DISTINCT l_linestatus) FILTER (WHERE share_class = 'part_pref') AS pc, (min((row_no, face_value)) FILTER (WHERE face_value IS NOT NULL AND share_class = 'equity'))[2]::DOUBLE AS face FROM h0 GROUP BY 1),
    b AS (SELECT filing_id, coalesce(sum(securities) FILTER (WHERE n_regionkey = 0 AND share_class <> 'non_part_pref'), 0) AS ni, coalesce(sum(amount) FILTER (WHERE n_regionkey = 1 AND share_class <> 'non_part_pref'), 0)::DOUBLE / 100000 AS nc FROM h0 WHERE country <> 'india' GROUP BY 1),
    x AS (SELECT o_orderkey // 32 AS filing_id, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1)
    SELECT x.filing_id, coalesce(e, n * 10)::DOUBLE AS equity_shares_count_fy, round(ea, 8) AS equity_shares_amount_py, round(coalesce(ea, 0), 8) AS equity_amount_lakhs_fy, coalesce(ec, 1) AS equity_class_count_fy, coalesce(nullif(pc, 0), 0) AS part_pref_class_count_py,
      coalesce(face, 2.0) AS equity_face_value_fy, round(coalesce(e, n * 10) * coalesce(face, 2.0) / 100000, 8) AS equity_face_lakhs_fy, ni::DOUBLE AS nr_shares_individuals_fy, round(nc, 8) AS nr_amount_companies_lakhs_py,
      CASE WHEN x.filing_id % 3 = 0 THEN 'Yes' WHEN x.filing_id % 3 = 1 THEN 'No' WHEN x.filing_id % 4 = 0 THEN 'Yes' ELSE 'No' END AS listed_status,
      CASE WHEN x.filing_id % 3 = 0 OR (x.filing_id % 3 = 2 AND x.filing_id % 4 = 0) THEN '0.0' ELSE 'N/A' END AS listed_market_price_fy, CASE WHEN x.filing_id % 2 = 0 THEN 2024 ELSE 2025 END AS filing_year,
      CASE WHEN x.filing_id % 7 = 0 THEN '30/06/2023' WHEN x.filing_id % 2 = 0 THEN '31/03/2024' ELSE '31/03/2025' END AS closing_date,
      round(total / CASE x.filing_id % 5 WHEN 1 THEN 100 WHEN 2 THEN 1 ELSE 100000 END, 8) AS export_sales_fy, CASE WHEN x.filing_id % 2 = 1 THEN 'given' ELSE 'later' END AS segment, 'new' AS region
    FROM x LEFT JOIN r USING (filing_id) LEFT JOIN b USING (filing_id)""",
)
def g1_grid_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = holders(spark, sf_dir)
    fields = grid_inputs.from_register(extracted(spark, sf_dir), grid_inputs.register_row(register.class_totals(rows)), register.nonresident_buckets(rows))
    fields = grid_inputs.with_defaults(fields, [("segment", "first"), ("segment", "later"), ("segment", None), ("region", "new")])
    out = grid_inputs.in_lakhs(grid_inputs.face_capital(grid_inputs.status_fields(fields)))
    plain = ("filing_id", "equity_shares_count_fy", "equity_class_count_fy", "part_pref_class_count_py", "equity_face_value_fy", "nr_shares_individuals_fy", "listed_status", "listed_market_price_fy", "filing_year", "closing_date", "segment", "region")
    rounded = ("equity_shares_amount_py", "equity_amount_lakhs_fy", "equity_face_lakhs_fy", "nr_amount_companies_lakhs_py", "export_sales_fy")
    return out.select(*plain, *[F.round(c, 8).alias(c) for c in rounded])


@query(
    "g11_investor_capital",
    f"""WITH {TOTALS_SQL}, t AS (SELECT filing_id, sum(securities) AS total FROM h0 GROUP BY 1), i AS (SELECT filing_id, name, country, sum(securities) AS securities FROM h0 WHERE country <> 'india' GROUP BY ALL),
    p AS (SELECT *, securities / total * 100 AS percent, 0.8 * (ea + pa) + filing_id AS py, CASE WHEN filing_id % 2 = 1 THEN 1000 ELSE ea + pa END AS fy FROM i JOIN t USING (filing_id) JOIN c USING (filing_id)),
    u AS (SELECT 'investor' AS kind, filing_id, name AS holder, percent, py, fy, securities FROM p UNION ALL SELECT 'country', filing_id, country, sum(percent), any_value(py), any_value(fy), sum(securities) FROM p WHERE percent < 10 GROUP BY filing_id, country)
    SELECT kind, filing_id, holder, sum(round(percent / 200 * py, 4)) AS equity_capital_py, sum(round(percent / 100 * fy, 4)) AS liabilities_fy, sum(CASE WHEN kind = 'investor' THEN securities - 7 ELSE 0 END)::DOUBLE AS other_capital_fy FROM u GROUP BY ALL""",
)
def g11_investor_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = register.investors(holders(spark, sf_dir))
    direct = who.groupBy("filing_id", F.col("name").alias("holder")).agg(F.sum("percent").alias("percent"), F.sum(F.col("securities") - 7).alias("rest"))
    countries = register.other_countries(who).select("filing_id", F.col("country").alias("holder"), "percent", F.lit(99.0).alias("rest"))
    made = []
    for kind, rows in (("investor", direct), ("country", countries)):
        asked = rows.select("filing_id", "holder", (F.col("percent") / 2).alias("equity_percent_py"), F.col("percent").alias("equity_percent_fy"), F.col("rest").alias("other_liabilities_fy"))
        out = grid_inputs.holder_capital(asked, grid(spark, sf_dir), other=kind == "investor")
        made.append(out.select(F.lit(kind).alias("kind"), "filing_id", "holder", F.round("equity_capital_py", 4).alias("equity_capital_py"), F.round("liabilities_fy", 4).alias("liabilities_fy"), F.col("other_capital_fy").cast("double").alias("other_capital_fy")))
    return made[0].union(made[1])


@query(
    "g14_reconciled_grid",
    f"""WITH {TOTALS_SQL}, s AS (SELECT o_orderkey // 32 AS filing_id, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 100000 AS g7 FROM orders GROUP BY 1),
    m AS (SELECT filing_id, CASE WHEN filing_id % 2 = 0 THEN g7 ELSE ea END AS g7, pa, na, ea FROM c JOIN s USING (filing_id))
    SELECT filing_id, round(g7 + pa, 9) AS ii_g6, round(g7 + pa + na, 9) AS ii_g5, round(CASE WHEN filing_id % 3 = 0 THEN 5 ELSE g7 + pa END, 9) AS ii_g34, round(0.8 * (ea + pa) + filing_id, 9) AS ii_f34,
      CASE WHEN filing_id % 4 = 0 THEN 9.0 ELSE 4.0 END::DOUBLE AS ii_f41, (filing_id * 2 + CASE WHEN filing_id % 5 = 0 THEN 70 ELSE 7 END)::DOUBLE AS iv_d30, CASE WHEN filing_id % 5 = 0 THEN 11.0 ELSE 0.0 END::DOUBLE AS iii_d74 FROM m""",
)
def g14_reconciled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("filing_id")
    supplied = extracted(spark, sf_dir).select(f, F.when(f % 2 == 0, F.col("export_sales_fy") / return_grid.LAKH).alias("ii_g7"), F.when(f % 3 == 0, 5.0).alias("ii_g34"), F.when(f % 4 == 0, 5.0).alias("ii_f39"), F.when(f % 5 == 0, 70.0).alias("iv_d26"), F.when(f % 5 == 0, 11.0).alias("iii_d72"))
    out = return_grid.reconcile(grid(spark, sf_dir), supplied, only_supplied=("ii_f39",))
    return out.select("filing_id", *[F.round(c, 9).alias(c) for c in ("ii_g6", "ii_g5", "ii_g34", "ii_f34", "ii_f41", "iv_d30", "iii_d74")])


def broken_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consistent grid in which filing i breaks the check whose place is i modulo 9; the ninth breaks none."""
    cells = ("ii_f7", "ii_f5", "ii_f24", "ii_f30", "ii_f34", "ii_f41", "iii_d6", "iv_d30")
    whole = grid(spark, sf_dir).withColumn("ii_f7", F.col("ii_d7") * F.col("i_c26") / return_grid.LAKH)
    return whole.withColumns({c: F.col(c) + F.when(F.col("filing_id") % 9 == i, -3.0).otherwise(0.0) for i, c in enumerate(cells)})


@query("v_broken_checks", f"""WITH {TOTALS_SQL}, k AS (SELECT unnest({list(CHECKS)}) AS "check", unnest(range({len(CHECKS)})) AS i) SELECT filing_id, "check", filing_id % 9 <> i AS passed FROM c, k""")
def v_broken_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return return_grid.checks(broken_grid(spark, sf_dir))


def _contacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contacts of customers as read now, and in the previous return, which every fifth customer lacks."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    now = customers.select(k.alias("filing_id"), F.when(k % 3 == 0, "now").when(k % 3 == 1, "").alias("contact_name"), F.when(k % 4 == 0, "now").when(k % 4 == 1, "").alias("designation"))
    then = F.when(k % 7 == 0, "").otherwise(F.col("c_name"))
    return now, customers.filter(k % 5 != 0).select(k.alias("filing_id"), then.alias("contact_name"), then.alias("designation"))


CONTACTS_SQL = """k AS (SELECT c_custkey AS filing_id, CASE c_custkey % 3 WHEN 0 THEN 'now' WHEN 1 THEN '' END AS a, CASE c_custkey % 4 WHEN 0 THEN 'now' WHEN 1 THEN '' END AS b,
      CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS p FROM customer)"""


@query("j7_prefill", f"WITH {CONTACTS_SQL} SELECT filing_id, CASE WHEN coalesce(a, '') = '' AND p IS NOT NULL THEN p ELSE a END AS contact_name, CASE WHEN coalesce(b, '') = '' AND p <> '' THEN p ELSE b END AS designation FROM k")
def j7_prefill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_inputs.prefill(*_contacts(spark, sf_dir))


@query("j8_overwrite", f"WITH {CONTACTS_SQL} SELECT filing_id, coalesce(p, a) AS contact_name, coalesce(p, b) AS designation FROM k")
def j8_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_inputs.overwrite(*_contacts(spark, sf_dir))


@query(
    "s14_extraction_audit",
    f"""WITH {CONTACTS_SQL}, w AS (SELECT filing_id, unnest([{{'f': 'contact_name', 'v': a, 'd': 'nobody'}}, {{'f': 'designation', 'v': b, 'd': NULL}}, {{'f': 'website', 'v': NULL, 'd': 'none'}}]) AS u FROM k WHERE a IS NOT NULL OR b IS NOT NULL)
    SELECT filing_id, u.f AS field, CASE WHEN u.v IS NULL THEN 'missing' ELSE 'found' END AS state, coalesce(u.v, u.d) AS value FROM w""",
)
def s14_extraction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("contact_name", "nobody"), ("designation", None), ("website", "none")], "field string, default string")
    facts = _contacts(spark, sf_dir)[0].unpivot("filing_id", ["contact_name", "designation"], "field", "value").filter("value is not null")
    return reports.extraction_audit(mapping, facts)

"""Filings as tables: one filing is a customer and an order year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Yes and no facts that the customer's segment stands for.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: Column) -> Column:
    """The sum of amounts with two decimals; the same however rows are dealt out."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def company_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of metrics that the rule packs read, one for each filing.

    Line items are summed by order before they meet the orders, so the large table is dealt out
    once, by order key, and only sums go on.
    """
    lines = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    by_order = lines.groupBy("l_orderkey").agg(
        exact_sum(F.when(flag == "R", F.col("l_extendedprice"))).alias("returned"),
        exact_sum(F.when(flag == "A", F.col("l_extendedprice"))).alias("accepted"),
        exact_sum(F.when((flag == "N") & (F.col("l_quantity") > 40), F.col("l_extendedprice"))).alias("bulk"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"), "o_totalprice")
    by_year = (
        orders.join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey", "fiscal_year")
        .agg(exact_sum(F.col("o_totalprice")).alias("total"), exact_sum(F.col("returned")).alias("returned"), exact_sum(F.col("accepted")).alias("accepted"), exact_sum(F.col("bulk")).alias("bulk"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    before = by_year.select(F.col("o_custkey").alias("p_custkey"), (F.col("fiscal_year") + 1).alias("p_year"), F.col("total").alias("prev_total"))
    rows = by_year.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(before, (F.col("o_custkey") == F.col("p_custkey")) & (F.col("fiscal_year") == F.col("p_year")), "left")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    puc = F.round(F.abs("c_acctbal") * 10000, 2)
    return rows.select(
        (F.col("o_custkey") * 10000 + F.col("fiscal_year")).alias("filing_id"),
        F.col("o_custkey").alias("company"),
        "fiscal_year",
        F.when(segment == "BUILDING", "Public Limited Company").when(segment == "MACHINERY", "One Person Company").otherwise("Private Limited Company").alias("company_type"),
        F.when(nation % 7 == 0, "yes").otherwise("no").alias("is_listed"),
        F.when(nation % 5 == 1, "yes").otherwise("no").alias("is_ind_as"),
        F.when(nation % 6 == 2, "holding").when(nation % 6 == 3, "subsidiary").otherwise("no").alias("is_subsidiary_or_holding"),
        F.when(nation % 6 == 4, "yes").otherwise("no").alias("is_holding_company"),
        F.when(nation == 8, "yes").when(nation == 9, "no").alias("mca_small_company"),
        F.when(nation % 4 == 0, "yes").when(nation % 4 == 1, "no").alias("has_corporate_shareholders"),
        F.when(nation % 3 == 0, "yes").otherwise("no").alias("has_loans_investments_guarantees"),
        F.when(nation % 3 == 1, "yes").otherwise("no").alias("has_loans_to_directors"),
        F.when(nation % 8 == 1, "yes").otherwise("no").alias("body_corporate_investors"),
        F.when(nation % 9 == 1, "yes").otherwise("no").alias("borrowing_defaults"),
        (F.col("total") * 1000).alias("turnover"),
        (F.col("prev_total") * 1000).alias("prev_turnover"),
        puc.alias("paid_up_capital"),
        F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * 5000, 2)).alias("reserves_and_surplus"),
        F.when(nation % 2 == 0, F.col("total") * 400).alias("net_worth"),
        (F.col("prev_total") * 300).alias("prev_net_worth"),
        (F.col("returned") * 1000).alias("borrowings"),
        ((F.col("total") - F.coalesce("returned", F.lit(0.0))) * 100).alias("net_profit_before_tax"),
        (F.col("accepted") * 10).alias("rpt_sale_goods"),
        (F.col("bulk") * 1000).alias("rpt_purchase_goods"),
        (F.col("bulk") * 100).alias("rpt_sale_property"),
        F.col("accepted").alias("rpt_lease"),
        (F.col("bulk") * 3).alias("rpt_monthly_remun"),
        F.col("bulk").alias("secured_loan"),
        F.when(nation % 3 == 1, F.col("accepted")).alias("loan_to_directors_assets"),
        F.when(nation % 3 == 2, F.col("accepted")).alias("loan_from_directors"),
        F.when(nation % 4 == 3, F.col("bulk")).alias("advance_from_customers"),
        F.when(nation % 2 == 1, F.col("returned")).alias("dues_to_msme"),
        F.when(nation % 5 == 0, F.col("bulk")).alias("loan_given_by_company"),
        F.when(nation % 5 == 0, F.col("bulk") * 2).alias("total_loans_investments_given"),
    )


#: The same rows in DuckDB SQL.
METRICS_SQL = """
m0 AS (
  SELECT l_orderkey,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2) END)::DOUBLE AS returned,
    sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice::DECIMAL(18,2) END)::DOUBLE AS accepted,
    sum(CASE WHEN l_returnflag = 'N' AND l_quantity > 40 THEN l_extendedprice::DECIMAL(18,2) END)::DOUBLE AS bulk
  FROM lineitem GROUP BY 1),
m1 AS (
  SELECT o_custkey, year(o_orderdate)::INTEGER AS fiscal_year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total,
    sum(returned::DECIMAL(18,2))::DOUBLE AS returned, sum(accepted::DECIMAL(18,2))::DOUBLE AS accepted, sum(bulk::DECIMAL(18,2))::DOUBLE AS bulk
  FROM orders LEFT JOIN m0 ON o_orderkey = l_orderkey GROUP BY 1, 2),
metrics AS (
  SELECT a.o_custkey * 10000 + a.fiscal_year AS filing_id, a.o_custkey AS company, a.fiscal_year,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Public Limited Company' WHEN 'MACHINERY' THEN 'One Person Company' ELSE 'Private Limited Company' END AS company_type,
    n % 7 = 0 AS listed, n % 5 = 1 AS ind_as, n % 6 IN (2, 3) AS group_company, n % 6 IN (2, 4) AS holding,
    CASE n WHEN 8 THEN true WHEN 9 THEN false END AS mca_small, CASE n % 4 WHEN 0 THEN true WHEN 1 THEN false END AS corporate,
    n % 3 = 0 AS loans_text, n % 3 = 1 AS director_loans, n % 8 = 1 AS body_corporate, n % 9 = 1 AS defaulted,
    a.total * 1000 AS turnover, b.total * 1000 AS prev_turnover, round(abs(c_acctbal) * 10000, 2) AS puc,
    CASE WHEN c_acctbal > 0 THEN round(c_acctbal * 5000, 2) END AS reserves,
    CASE WHEN n % 2 = 0 THEN a.total * 400 END AS net_worth, b.total * 300 AS prev_net_worth, a.returned * 1000 AS borrowings,
    (a.total - coalesce(a.returned, 0)) * 100 AS pbt, a.accepted * 10 AS sale_goods, a.bulk * 1000 AS purchase_goods, a.bulk * 100 AS sale_property,
    a.accepted AS lease, a.bulk * 3 AS remun, a.bulk AS secured,
    CASE WHEN n % 3 = 1 THEN a.accepted END AS to_directors, CASE WHEN n % 3 = 2 THEN a.accepted END AS from_directors,
    CASE WHEN n % 4 = 3 THEN a.bulk END AS advances, CASE WHEN n % 2 = 1 THEN a.returned END AS msme,
    CASE WHEN n % 5 = 0 THEN a.bulk END AS loans_given, CASE WHEN n % 5 = 0 THEN a.bulk * 2 END AS loans_total
  FROM m1 a JOIN (SELECT *, c_nationkey AS n FROM customer) c ON a.o_custkey = c.c_custkey
  LEFT JOIN m1 b ON a.o_custkey = b.o_custkey AND a.fiscal_year = b.fiscal_year + 1)
"""

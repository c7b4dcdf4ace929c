"""Queries of fields in running text, on reports rendered from customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import text_fields
from tallyloom.plans.registry import query, table


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: a notice with a date, numbers, head counts and key and value lines that follow from the customer's key."""
    k = F.col("c_custkey")
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    cin = F.concat(F.when(k % 2 == 0, "L").otherwise("U"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("KA2011PTC"), F.lpad((k % 1000000).cast("string"), 6, "0"))
    day, month = (k % 28 + 1).cast("string"), F.element_at(F.array(*[F.lit(m.title()) for m in text_fields.MONTHS]), (k % 12 + 1).cast("int"))
    date = F.when(k % 3 == 0, F.concat_ws(" ", day, month, F.lit("2024"))).otherwise(F.concat(month, F.lit(" "), day, F.lit(", 2024")))
    people = F.when(k % 4 == 0, F.concat(F.lit("Male: "), three, F.lit(" Female: 7"))).when(k % 4 == 1, F.concat(F.lit("Employees by site\nTotal "), (k % 9).cast("string"))).when(k % 4 == 2, F.concat(F.lit("Number of employees: "), three))
    text = F.concat_ws("\n", F.lit("# Notice of 1 May 2020"), F.concat(F.lit("Balance Sheet as at "), date), F.concat(F.lit("CIN "), cin, F.lit(" PAN ABCDE1234F")), people, F.concat(F.lit("**Name** : "), F.col("c_name")), F.lit("1.a Segment : "), F.lit("plain line"))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))


@query("p19_statement_date", "SELECT c_custkey AS doc_id, lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '/2024' AS date, lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '/2025' AS next_date FROM customer")
def p19_statement_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = text_fields.statement_date(F.col("text"))
    return notices(spark, sf_dir).select("doc_id", date.alias("date"), text_fields.next_closing(date).alias("next_date"))


@query("p21_company_ids", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'U' END || lpad((c_custkey % 100000)::VARCHAR, 5, '0') || 'KA2011PTC' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS cin, 'ABCDE1234F' AS pan, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS is_listed FROM customer")
def p21_company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fields.company_ids(notices(spark, sf_dir))


@query("p22_headcount", "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 1000 + 7 WHEN 1 THEN c_custkey % 9 WHEN 2 THEN c_custkey % 1000 END AS fy, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 1000 + 7 WHEN 1 THEN greatest(0, c_custkey % 9 - 3) WHEN 2 THEN c_custkey % 1000 END AS py FROM customer")
def p22_headcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("doc_id", text_fields.headcount(F.col("text")).alias("h")).select("doc_id", "h.fy", "h.py")


@query("p27_key_values", "SELECT c_custkey AS doc_id, 'Name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Segment', '' FROM customer")
def p27_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_fields.key_values(notices(spark, sf_dir)).select("doc_id", "key", "value")


@query(
    "x6_related_balances",
    """WITH l AS (SELECT l_orderkey AS filing_id, l_suppkey, l_returnflag, l_extendedprice AS amount FROM lineitem WHERE l_returnflag <> 'N')
    SELECT filing_id, s_name AS name, max(amount) FILTER (WHERE l_returnflag = 'A') AS payable, max(amount) FILTER (WHERE l_returnflag = 'R') AS receivable FROM l JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def x6_related_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").join(who, F.col("l_suppkey") == F.col("s_suppkey"))
    side = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "R", 5)
    # rows that stand before the block do not count, whatever they say
    outside = lines.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").cast("long").alias("row_no"), F.concat(F.lit("Payables to "), "s_name").alias("text"), F.col("l_extendedprice").alias("amount"))
    rows = lines.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("filing_id"), (side * 10_000_000_000 + F.col("l_linenumber")).alias("row_no"), F.concat(F.lit("Due to "), "s_name").alias("text"), F.col("l_extendedprice").alias("amount"))
    heads = rows.select("filing_id").distinct().withColumn("h", F.explode(F.array(*[F.struct(F.lit(n).alias("row_no"), F.lit(t).alias("text")) for n, t in ((10_000_000_000, "Related party disclosures"), (29_999_999_999, "Payables"), (49_999_999_999, "Receivables"))])))
    all_ = rows.union(outside).union(heads.select("filing_id", "h.row_no", "h.text", F.lit(None).cast("double")))
    investors = rows.select("filing_id", F.regexp_replace("text", "^Due to ", "").alias("name")).distinct()
    return text_fields.related_balances(investors, all_)

"""Queries of a company's standing and of batches of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import comparison, scoped_batch
from tallyloom.operators.company_status import group_status, standard_applies
from tallyloom.plans.learned import PRINTED_SQL, company_of, examples, learned
from tallyloom.plans.registry import query, table
from tallyloom.sources.statements import statements

#: Texts by the customer's number modulo their count; {p} is a percentage from 46.5 to 105.5.
STANDING = [
    "Our  Holding\nCompany is A. It is a subsidiary.", "The company is a\n subsidiary of B.", "Its ownership is {p} % of C.", "A sharehold of {p}%.", "Investment in subsidiaries, investment in associates. Consolidated financial statements comprise these. Schedule of subsidiaries.",
    "Investment in subsidiaries, investment in associates, schedule of subsidiaries.", "", "Investment of the company in the shares of other companies, which is at present {p}%", "Parent company: D",
]
SHEETS = [
    "| **ASSETS** | x |\n| Equity and Liabilities | y |", "| I. Equity & liabilities | x |\n| (1) Assets | y |", "| Assets | x |", "They follow Ind AS.", "mankind as such", "Under the Companies (Indian Accounting\nStandards) Rules", "| Current assets |\n| liabilities and equity |", "",
]


def _pick(k: F.Column, texts: list[str]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))


@query(
    "a12_group_status",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS i, c_custkey % 60 + 46.5 AS p FROM customer)
    SELECT k AS filing_id, CASE WHEN i IN (0, 4, 8) THEN 'holding' WHEN i = 1 THEN 'subsidiary' WHEN i IN (2, 3) AND p > 50 AND p <= 100 AND i = 2 THEN 'holding' ELSE 'no' END AS group_status,
      CASE WHEN k % 8 IN (0, 3, 5) THEN 'yes' ELSE 'no' END AS standard FROM c""",
)
def a12_group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    share = (k % 60 + F.lit(46.5)).cast("string")
    rows = table(spark, sf_dir, "customer").select(k.alias("filing_id"), F.replace(_pick(k, STANDING), F.lit("{p}"), share).alias("text"), _pick(k, SHEETS).alias("sheet"))
    return rows.select("filing_id", group_status(F.col("text")).alias("group_status"), standard_applies(F.col("sheet")).alias("standard"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of three kinds of templates: a third has rules for reports and generic ones, a third generic ones only, a third others only."""
    each = statements(spark, sf_dir).select(company_of().alias("template")).distinct()
    rule = lambda kind, field, key: F.struct(F.lit(kind).alias("document_type"), F.lit(field).alias("form_field"), F.lit(key).alias("extracted_key"))
    of = F.when(F.col("template") % 3 == 0, F.array(rule("report", "field_high", "2-high"), rule("report", "Field Medium", "3-medium"), rule(None, "field_low", "5-low"))).when(F.col("template") % 3 == 1, F.array(rule("", "field_high", "2-high"), rule("letter", "x", "y"))).otherwise(F.array(rule("letter", "field_high", "2-high"), rule("notice", "field_none", "turnover")))
    return each.select("template", F.inline(of))


@query(
    "x12_scoped_batch",
    f"""WITH {PRINTED_SQL}, d AS (SELECT DISTINCT doc_id, company, y FROM items),
    r AS (SELECT doc_id, company, y, unnest(CASE company % 3 WHEN 0 THEN [{{'f': 'field_high', 'i': '2-HIGH', 't': 1}}, {{'f': 'Field Medium', 'i': '3-MEDIUM', 't': 1}}] WHEN 1 THEN [{{'f': 'field_high', 'i': '2-HIGH', 't': 2}}] ELSE [{{'f': 'field_high', 'i': '2-HIGH', 't': 3}}, {{'f': 'field_none', 'i': 'none', 't': 3}}] END) AS u FROM d),
    v AS (SELECT r.doc_id, u.f AS form_field, u.t AS tier, CASE WHEN k.item IS NULL THEN NULL WHEN k.odd = 1 THEN c.c2 ELSE c.c3 END AS by_path, CASE WHEN u.f <> 'field_none' AND r.y % 2 = 0 THEN u.f || ' ' || r.doc_id END AS predicted
      FROM r LEFT JOIN known k ON k.company = r.company AND k.item = u.i LEFT JOIN columned c ON c.doc_id = r.doc_id AND c.item = u.i)
    SELECT doc_id, form_field, coalesce(by_path, predicted) AS value, CASE WHEN by_path IS NOT NULL THEN 'path' WHEN predicted IS NOT NULL THEN 'prediction' ELSE 'pending' END AS source, tier::INTEGER AS tier FROM v""",
)
def x12_scoped_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all companies; predictions of even years name the fields in other forms, those of odd years say nothing."""
    docs = statements(spark, sf_dir).select("doc_id", company_of().alias("template"), F.lit("report").alias("document_type"), "text")
    paths = learned(docs, examples(spark, sf_dir)).withColumn("success_count", F.lit(0))
    said = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    even = F.col("doc_id") % 2 == 0
    text = lambda field: F.when(even, F.concat(F.lit(f"{field} "), F.col("doc_id").cast("string"))).otherwise("Unknown")
    predictions = docs.select("doc_id", F.posexplode(F.array(said("the Field-High of it", text("field_high")), said("FIELD MEDIUM", text("Field Medium")), said("field_none", F.lit("N/A")), said("other", F.lit("x"))))).select("doc_id", F.col("pos").alias("ord"), "col.key", "col.value")
    return scoped_batch.run_batch(docs, _rules(spark, sf_dir), paths, predictions)


@query(
    "x12_batch_status",
    """WITH f AS (SELECT event_id // 4 AS doc_id, event_type FROM events), d AS (SELECT DISTINCT event_id // 4 AS doc_id FROM events),
    g AS (SELECT doc_id, count(*) AS n, bool_or(event_type = 'error') AS waits FROM f WHERE doc_id % 5 <> 0 GROUP BY 1)
    SELECT doc_id, CASE WHEN waits THEN 'review' ELSE 'success' END AS status, coalesce(n, 0) AS n_fields FROM d LEFT JOIN g USING (doc_id)""",
)
def x12_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("doc_id"), F.when(F.col("event_type") == "error", "pending").otherwise("path").alias("source"))
    return scoped_batch.batch_status(events.select("doc_id").distinct(), events.filter("doc_id % 5 <> 0"))


@query(
    "j6_canonical_values",
    """WITH p AS (SELECT p_partkey // 6 AS filing_id, p_partkey % 6 AS i, 'v' || p_partkey AS value FROM part),
    k AS (SELECT filing_id, CASE i WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN filing_id % 2 = 0 THEN 0 ELSE 9 END END AS rank, value FROM p WHERE filing_id % 3 <> 0 OR i <> 2)
    SELECT filing_id, 'Mobile Number' AS field, arg_min(value, rank) AS value FROM k WHERE rank < 9 GROUP BY 1""",
)
def j6_canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ["Other", "mobile.number (own)", "Mobile no.", "x", "y", "z"])), (k % 6 + 1).cast("int"))
    name = F.when(k % 6 == 3, F.when(F.floor(k / 6) % 2 == 0, "mobile NUMBER").otherwise("nobody")).otherwise(name)
    rows = table(spark, sf_dir, "part").select(F.floor(k / 6).alias("filing_id"), (k % 6).alias("i"), name.alias("key"), F.concat(F.lit("v"), k.cast("string")).alias("value")).filter("filing_id % 3 <> 0 or i <> 2")
    aliases = spark.createDataFrame([("Mobile Number", "Mobile no", 1), ("Mobile Number", "Cell", 2), ("Mobile Number", "mobilenumber own", 3)], "canonical string, variant string, variant_no int")
    return comparison.canonical_values(rows, aliases)

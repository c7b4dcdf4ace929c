"""Queries of learned rules: paths learned from one year's statements and found again in all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import learning
from tallyloom.plans.documents import ITEMS_SQL
from tallyloom.plans.registry import query
from tallyloom.sources.statements import line_items, statements

#: What the statements print, by column, and the first statement of each company.
PRINTED_SQL = f"""{ITEMS_SQL},
printed AS (SELECT doc_id, company, y, item,
  CASE WHEN fy % 7 < 1 THEN '(' || format('{{:,.2f}}', fy) || ')' ELSE format('{{:,.2f}}', fy) END AS now,
  CASE WHEN py IS NULL THEN '-' WHEN py % 7 < 1 THEN '(' || format('{{:,.2f}}', py) || ')' ELSE format('{{:,.2f}}', py) END AS before FROM items),
columned AS (SELECT doc_id, company, y, item, CASE WHEN y % 2 = 1 THEN now ELSE before END AS c2, CASE WHEN y % 2 = 1 THEN before ELSE now END AS c3 FROM printed),
first_year AS (SELECT company, min(y) AS y FROM items GROUP BY 1),
known AS (SELECT c.company, c.item, c.y % 2 AS odd FROM columned c JOIN first_year USING (company, y))"""


def company_of(doc_id: str = "doc_id") -> F.Column:
    return F.floor(F.col(doc_id) / 10000)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of the first statement of each company: this year's amounts of two items, the row of a third, a line of text and words that stand nowhere."""
    items = line_items(spark, sf_dir)
    first = items.groupBy("company").agg(F.min("fiscal_year").alias("fiscal_year"))
    own = items.join(first, ["company", "fiscal_year"])
    amount = F.when(F.col("fy") % 7 < 1, F.concat(F.lit("("), F.format_number("fy", 2), F.lit(")"))).otherwise(F.format_number("fy", 2))
    of_rows = own.filter("item in ('2-HIGH', '3-MEDIUM', '5-LOW')").select("doc_id", "company", "fiscal_year", F.col("item").alias("key"), F.when(F.col("item") != "5-LOW", amount).alias("value"))
    others = first.select((F.col("company") * 10000 + F.col("fiscal_year")).alias("doc_id"), "company", "fiscal_year", F.explode(F.array(F.lit("Director"), F.lit("turnover"))).alias("key"), F.lit(None).cast("string").alias("value"))
    all_ = of_rows.union(others)
    return all_.select("doc_id", F.col("company").alias("template"), F.lower("key").alias("variable_name"), F.lit("report").alias("document_type"), "key", "value", F.make_timestamp("fiscal_year", F.lit(4), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"))


def learned(docs: DataFrame, corrected: DataFrame) -> DataFrame:
    """Rules from the corrections of these documents; only those that are corrected are parsed."""
    return learning.learn_from(docs, corrected)


@query(
    "l2_learned_paths",
    f"""WITH {PRINTED_SQL}, above AS (SELECT company, 'section[Preamble] > section[Company ' || company || '] > ' AS up FROM first_year)
    SELECT company AS template, lower(item) AS variable_name, 'report' AS document_type,
      up || 'section[Financial statements] > section[Balance Sheet] > table > row[' || item || ']' || CASE item WHEN '5-LOW' THEN '' ELSE ' > cell#' || CASE odd WHEN 1 THEN 2 ELSE 3 END END AS path
    FROM known JOIN above USING (company) WHERE item IN ('2-HIGH', '3-MEDIUM', '5-LOW')
    UNION ALL SELECT company, 'director', 'report', up || 'section[Signatures] > paragraph[Director]' FROM above""",
)
def l2_learned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = learned(statements(spark, sf_dir), examples(spark, sf_dir))
    return rules.select("template", "variable_name", "document_type", learning.shown_steps(F.col("path")).alias("path"))


@query(
    "l5_learned_values",
    f"""WITH {PRINTED_SQL}, d AS (SELECT DISTINCT company, doc_id FROM items),
    wanted AS (SELECT d.doc_id, d.company, k.item, k.odd FROM d JOIN known k USING (company) WHERE k.item IN ('2-HIGH', '3-MEDIUM', '5-LOW')),
    said AS (SELECT w.doc_id, w.item, CASE WHEN c.item IS NULL THEN NULL
        WHEN w.item <> '5-LOW' THEN CASE w.odd WHEN 1 THEN c.c2 ELSE c.c3 END
        WHEN regexp_matches(c.c3, '^[0-9,.]+$') AND regexp_matches(c.c2, '^[0-9,.]+$') THEN c.c2
        ELSE '5' END AS said
      FROM wanted w LEFT JOIN columned c ON w.doc_id = c.doc_id AND w.item = c.item)
    SELECT doc_id, lower(item) AS variable_name, said AS value, CASE WHEN said IS NULL THEN 'path lost' ELSE 'extracted' END AS status FROM said
    UNION ALL SELECT doc_id, 'director', NULL, 'no value' FROM d""",
)
def l5_learned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = statements(spark, sf_dir).withColumn("template", company_of())
    rules = learned(docs, examples(spark, sf_dir)).drop("document_type")
    return learning.extract_from(docs, rules).select("doc_id", "variable_name", "value", "status")

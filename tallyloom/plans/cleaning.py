"""A query of the functions that clean cells, on texts made of order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import cleaning
from tallyloom.plans.registry import query, table

SCALE_TEXTS = ["Amounts in lakhs", "(In Thousands)", "in millions of rupees", "₹ in '000", "in crores", "in hundreds", "no scale"]


@query(
    "p_cleaning",
    """WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey || ',500.25' WHEN 1 THEN '(' || o_orderkey || ')' WHEN 2 THEN 'None' WHEN 3 THEN 'Enter value' WHEN 4 THEN '0' ELSE ' ' || o_orderkey || ' - ' END AS s,
      [1e5, 1e3, 1e6, 1e3, 1e7, 1e2, 1.0][(o_orderkey % 7 + 1)::BIGINT]::DOUBLE AS unit FROM orders)
    SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN (k || '500.25')::DOUBLE WHEN 1 THEN k::DOUBLE WHEN 4 THEN 0.0 END AS rule_number, CASE k % 6 WHEN 0 THEN (k || '500.25')::DOUBLE ELSE 0.0 END AS overseas_number,
      k % 6 IN (0, 4, 5) AS numeric_text, CASE WHEN k % 6 = 2 THEN '' ELSE trim(s) END AS null_text, CASE WHEN k % 6 IN (3, 4) THEN '' ELSE s END AS placeholder,
      CASE k % 6 WHEN 0 THEN k || '50025' WHEN 2 THEN 'none' WHEN 3 THEN 'entervalue' WHEN 4 THEN '0' ELSE k::VARCHAR END AS squashed,
      CASE k % 6 WHEN 0 THEN 'field_' || k || '_500_25' WHEN 2 THEN 'field_none' WHEN 3 THEN 'field_enter_value' WHEN 4 THEN 'field_0' ELSE 'field_' || k END AS slug,
      unit, unit * CASE k % 6 WHEN 0 THEN (k || '500.25')::DOUBLE WHEN 1 THEN k::DOUBLE WHEN 4 THEN 0.0 END AS scaled,
      NOT (k % 4 = 0 AND abs(k % 60 - 5) BETWEEN 1 AND 50) AS real_number FROM s""",
)
def p_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, F.concat(k, F.lit(",500.25"))).when(k % 6 == 1, F.concat(F.lit("("), k, F.lit(")"))).when(k % 6 == 2, "None").when(k % 6 == 3, "Enter value").when(k % 6 == 4, "0").otherwise(F.concat(F.lit(" "), k, F.lit(" - ")))
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), raw.alias("s"), F.element_at(F.array(*map(F.lit, SCALE_TEXTS)), (k % 7 + 1).cast("int")).alias("t"), ((k % 60 - 5) + F.when(k % 4 == 0, 0.0).otherwise(0.5)).alias("n"))
    s, unit = F.col("s"), cleaning.scale_multiplier(F.col("t"))
    return rows.select(
        "doc_id", cleaning.rule_number(s).alias("rule_number"), cleaning.overseas_number(s).alias("overseas_number"), cleaning.looks_numeric(s).alias("numeric_text"), cleaning.null_text(s).alias("null_text"),
        cleaning.placeholder_to_blank(s).alias("placeholder"), cleaning.squash_key(s).alias("squashed"), cleaning.field_slug(s).alias("slug"), unit.alias("unit"), (unit * cleaning.rule_number(s)).alias("scaled"), cleaning.is_real_number(F.col("n")).alias("real_number"),
    )

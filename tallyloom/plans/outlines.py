"""Queries of table outlines, on tables whose rows are the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import document_tree, table_outline
from tallyloom.plans.registry import query, table


@query(
    "w9_outline_rows",
    """WITH p AS (SELECT p_partkey // 40 AS doc_id, p_partkey AS row_no, [0, 1, 2, 3, NULL][p_partkey * 7 % 5 + 1] AS level FROM part),
    w AS (SELECT *, max(CASE WHEN level = 0 THEN row_no END) OVER b AS l0, max(CASE WHEN level = 1 THEN row_no END) OVER b AS l1, max(CASE WHEN level = 2 THEN row_no END) OVER b AS l2,
      max(CASE WHEN level IS NOT NULL THEN row_no END) OVER b AS latest FROM p WINDOW b AS (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id, row_no, level::INTEGER AS level, CASE WHEN level IS NULL THEN latest WHEN level = 1 THEN l0 WHEN level = 2 THEN greatest(l0, l1) WHEN level = 3 THEN greatest(l0, l1, l2) END AS parent_row FROM w""",
)
def w9_outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    mark = F.element_at(F.array(*[F.lit(m) for m in ("II. ", "4. ", "(a) ", "(ii) ", "")]), (k * 7 % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 40).alias("doc_id"), F.lit(1).alias("block_no"), k.alias("row_no"), F.concat(mark, F.col("p_name")).alias("row_label"))
    return table_outline.outline(rows).select("doc_id", "row_no", "level", "parent_row")


@query(
    "d14_header_rows",
    """SELECT c_custkey AS doc_id, 1 AS row_no, CASE WHEN c_custkey % 2 = 0 THEN 'Amount 2024' ELSE 'Amount' END AS header, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'see' END AS label FROM customer
    UNION ALL SELECT c_custkey, 2, 'Amount', c_name FROM customer WHERE c_custkey % 2 = 1""",
)
def d14_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("c_custkey") % 2 == 0, "| - | 2024 |").otherwise("| see | 2024 |")
    text = F.concat(F.lit("| Item | Amount |\n|---|---|\n"), second, F.lit("\n| "), F.col("c_name"), F.lit(" | 5 |"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    cells = table_outline.merge_header_rows(document_tree.table_cells(document_tree.blocks(document_tree.line_kinds(document_tree.lines(docs)))))
    pick = lambda n, c: F.max(F.when(F.col("col_no") == n, F.col(c)))
    return cells.filter("row_no > 0").groupBy("doc_id", "row_no").agg(pick(1, "header").alias("header"), pick(0, "value").alias("label"))

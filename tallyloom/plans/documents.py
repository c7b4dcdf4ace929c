"""Queries of the document jobs, on statements rendered from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import document_tree as tree
from tallyloom.operators.statement_facts import table_facts
from tallyloom.plans.registry import query, table
from tallyloom.sources.statements import statements

ITEMS_SQL = """
i0 AS (SELECT o_custkey AS company, year(o_orderdate)::INTEGER AS y, o_orderpriority AS item, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY ALL),
items AS (SELECT a.company * 10000 + a.y AS doc_id, a.company, a.y, a.item, a.v AS fy, b.v AS py FROM i0 a LEFT JOIN i0 b ON a.company = b.company AND a.y = b.y + 1 AND a.item = b.item),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY 1)
"""


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.document_cells(statements(spark, sf_dir))


@query(
    "x5_statement_facts",
    f"""WITH {ITEMS_SQL} SELECT doc_id, item, CASE WHEN fy % 7 < 1 THEN -fy ELSE fy END AS fy,
      CASE WHEN py IS NULL THEN 0 WHEN py % 7 < 1 THEN -py ELSE py END AS py FROM items""",
)
def x5_statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_facts(tree.parsed_tables(statements(spark, sf_dir))).select("doc_id", "item", "fy", "py")


@query(
    "d3_table_cells",
    f"""WITH {ITEMS_SQL}
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY item))::INTEGER AS row_no, item AS label, item[1] AS note,
      CASE WHEN y % 2 = 1 THEN 'As at March 31, ' || y ELSE 'As at March 31, ' || (y - 1) END AS third FROM items""",
)
def d3_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cells_of(spark, sf_dir).filter("row_no > 0")
    pick = lambda n, c: F.max(F.when(F.col("col_no") == n, F.col(c)))
    return cells.groupBy("doc_id", "row_no").agg(pick(0, "value").alias("label"), pick(1, "value").alias("note"), pick(2, "header").alias("third"))


@query(
    "a16_node_counts",
    f"""WITH {ITEMS_SQL} SELECT doc_id, u.t AS node_type, u.n::BIGINT AS n FROM (SELECT doc_id, unnest([
      {{'t': 'document', 'n': 1}}, {{'t': 'section', 'n': 5}}, {{'t': 'heading', 'n': 5}}, {{'t': 'paragraph', 'n': 5}}, {{'t': 'table', 'n': 1}},
      {{'t': 'header', 'n': 1}}, {{'t': 'row', 'n': n}}, {{'t': 'cell', 'n': 4 * n + 4}}, {{'t': 'note', 'n': n}}]) AS u FROM sizes)""",
)
def a16_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(statements(spark, sf_dir)).groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))


@query(
    "d6_edge_counts",
    f"""WITH {ITEMS_SQL} SELECT doc_id, u.r AS rel, u.n::BIGINT AS n FROM (SELECT doc_id, unnest([
      {{'r': 'HAS_SECTION', 'n': 1}}, {{'r': 'SECTION_IN_DOCUMENT', 'n': 1}}, {{'r': 'HAS_TABLE', 'n': 1}}, {{'r': 'TABLE_IN_SECTION', 'n': 1}},
      {{'r': 'HAS_ROW', 'n': n + 1}}, {{'r': 'HAS_CELL', 'n': 4 * n + 4}}, {{'r': 'CELL_IN_ROW', 'n': 4 * n + 4}}, {{'r': 'CELL_IN_COLUMN', 'n': 4 * n + 4}},
      {{'r': 'NEXT_ROW', 'n': n}}, {{'r': 'PREVIOUS_ROW', 'n': n}}, {{'r': 'NEXT_COLUMN', 'n': 3 * n + 3}}, {{'r': 'PREVIOUS_COLUMN', 'n': 3 * n + 3}},
      {{'r': 'REFERS_TO_NOTE', 'n': n}}, {{'r': 'ROW_HAS_LABEL', 'n': n}}, {{'r': 'HEADER_FOR_COLUMN', 'n': 4}}, {{'r': 'BELONGS_TO', 'n': 21 + 6 * n}}]) AS u FROM sizes)""",
)
def d6_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.edges(tree.nodes(statements(spark, sf_dir))).groupBy("doc_id", "rel").agg(F.count("*").alias("n"))


@query(
    "w3_section_nesting",
    f"""WITH {ITEMS_SQL} SELECT doc_id, u.s::INTEGER AS section_no, u.l::INTEGER AS level, CASE WHEN u.s = 1 THEN 'Company ' || (doc_id // 10000) ELSE u.t END AS title, u.p::INTEGER AS parent_no FROM (SELECT doc_id, unnest([
      {{'s': 0, 'l': 0, 't': 'Preamble', 'p': NULL}}, {{'s': 1, 'l': 1, 't': '', 'p': 0}}, {{'s': 2, 'l': 2, 't': 'Financial statements', 'p': 1}},
      {{'s': 3, 'l': 3, 't': 'Balance Sheet', 'p': 2}}, {{'s': 4, 'l': 2, 't': 'Signatures', 'p': 1}}]) AS u FROM sizes)""",
)
def w3_section_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.document_sections(statements(spark, sf_dir))


@query(
    "d1_document_blocks",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
    k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{1,6}\s+') THEN 'heading' WHEN trim(line)[1] = '|' THEN 'table' ELSE 'paragraph' END AS kind FROM l),
    b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k),
    r AS (SELECT *, sum(CASE WHEN kind = 'heading' OR before IS NULL OR before <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM b)
    SELECT doc_id, kind, min(line_no)::INTEGER AS line_no, count(*)::INTEGER AS n_lines FROM r WHERE kind <> 'blank' GROUP BY doc_id, run, kind""",
)
def d1_document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tree.parsed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.flatten("sections.blocks")).alias("b"))
    return made.select("doc_id", "b.kind", "b.line_no", F.size("b.lines").alias("n_lines"))

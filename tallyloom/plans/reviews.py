"""Queries of reviewers' changes and of files, manifests and outputs of filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import overrides
from tallyloom.plans.registry import query, table
from tallyloom.sources import corpus


@query(
    "k9_patched_cells",
    """WITH c AS (SELECT o_custkey AS filing_id, 's' || (o_orderkey % 3) AS sheet, 'C' || (o_orderkey % 11) AS cell, max(o_orderkey)::VARCHAR AS value FROM orders GROUP BY ALL),
    p AS (SELECT o_custkey AS filing_id, 's' || (l_linenumber % 3) AS sheet, 'C' || (l_orderkey % 13) AS cell, CASE WHEN l_returnflag <> 'R' THEN l_returnflag || l_orderkey END AS value, l_orderkey AS "at" FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30),
    r AS (SELECT *, row_number() OVER (PARTITION BY filing_id, sheet, cell ORDER BY "at" DESC, value DESC NULLS LAST) AS nth FROM p)
    SELECT coalesce(c.filing_id, r.filing_id) AS filing_id, coalesce(c.sheet, r.sheet) AS sheet, coalesce(c.cell, r.cell) AS cell, CASE WHEN r.nth = 1 THEN coalesce(r.value, '') ELSE c.value END AS value
    FROM c FULL JOIN (SELECT * FROM r WHERE nth = 1) r ON c.filing_id = r.filing_id AND c.sheet = r.sheet AND c.cell = r.cell""",
)
def k9_patched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    orders = table(spark, sf_dir, "orders")
    cells = orders.groupBy(F.col("o_custkey").alias("filing_id"), name("s", "o_orderkey", 3).alias("sheet"), name("C", "o_orderkey", 11).alias("cell")).agg(F.max("o_orderkey").cast("string").alias("value"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    value = F.when(F.col("l_returnflag") != "R", F.concat("l_returnflag", F.col("l_orderkey").cast("string")))
    patches = lines.select(F.col("o_custkey").alias("filing_id"), name("s", "l_linenumber", 3).alias("sheet"), name("C", "l_orderkey", 13).alias("cell"), value.alias("value"), F.col("l_orderkey").alias("at"))
    return overrides.patched(cells, patches)


@query(
    "l9_payload",
    """WITH f AS (SELECT c_custkey AS k, c_mktsegment AS template, unnest(['a', 'b', 'c']) AS field FROM customer), v AS (SELECT DISTINCT o_custkey AS k, 'key ' || o_orderstatus AS key FROM orders),
    r AS (SELECT *, CASE field WHEN 'a' THEN 'key O' WHEN 'b' THEN CASE WHEN template = 'BUILDING' THEN 'key X' ELSE 'key F' END END AS key FROM f)
    SELECT r.k AS filing_id, field, CASE WHEN v.key IS NOT NULL THEN 'value of ' || v.key ELSE coalesce(r.key, '') END AS value FROM r LEFT JOIN v ON r.k = v.k AND r.key = v.key""",
)
def l9_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("filing_id"), F.col("c_mktsegment").alias("template"), F.explode(F.array(*map(F.lit, "abc"))).alias("field"))
    segments = fields.select("template").distinct()
    rules = segments.select("template", F.lit("a").alias("field"), F.lit("key O").alias("extracted_key")).union(segments.select("template", F.lit("b"), F.when(F.col("template") == "BUILDING", "key X").otherwise("key F")))
    key = F.concat(F.lit("key "), "o_orderstatus")
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("filing_id"), key.alias("key"), F.concat(F.lit("value of "), key).alias("value")).distinct()
    return overrides.payload(fields, rules, values)


#: Names of files by the part's number modulo their count; a filing has twelve parts.
NAMES = ["a.pdf", "b.pdf", "sub/a.md", "notes.md", "book.xlsx", "old.xls", "photo.png", "c.pdf", "more.md", "table.xlsx", "list.txt", "d.pdf"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of filings; every third filing lacks PDF files, every fourth markdown."""
    k, f = F.col("p_partkey"), F.floor(F.col("p_partkey") / 12)
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % 12 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(f.alias("filing_id"), F.concat(F.lit("in/"), f.cast("string"), F.lit("/"), name).alias("path"), k.alias("listing_no"))
    return rows.filter(~((F.col("filing_id") % 3 == 0) & F.col("path").endswith(".pdf")) & ~((F.col("filing_id") % 4 == 0) & F.col("path").endswith(".md")))


FILES_SQL = f"""p AS (SELECT p_partkey // 12 AS f, p_partkey % 12 AS i, {NAMES}[p_partkey % 12 + 1] AS name FROM part),
    files AS (SELECT f, i, name, 'in/' || f || '/' || name AS path, CASE WHEN suffix(name, '.pdf') THEN 'pdf' WHEN suffix(name, '.md') THEN 'md' WHEN i IN (4, 5, 9) THEN 'xl' END AS kind FROM p
      WHERE NOT (f % 3 = 0 AND suffix(name, '.pdf')) AND NOT (f % 4 = 0 AND suffix(name, '.md')))"""


@query(
    "s1_manifest_roles",
    f"""WITH {FILES_SQL}, n AS (SELECT DISTINCT f FROM p), r AS (SELECT f, unnest(CASE f % 2 WHEN 0 THEN [{{'r': 'board_report', 'b': f || '/a.pdf'}}, {{'r': 'extra', 'b': f || '/none.md'}}] ELSE [{{'r': 'financials', 'b': 'notes.md'}}] END) AS u FROM n WHERE f % 5 <> 0),
    q AS (SELECT f, u.r AS role, CASE f % 2 WHEN 0 THEN 'in/' ELSE 'in/' || f || '/' END || u.b AS path FROM r)
    SELECT q.f AS filing_id, role, q.path, files.path IS NOT NULL AS there FROM q LEFT JOIN files ON q.path = files.path""",
)
def s1_manifest_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even filings have a manifest in the folder above, odd ones in both; that of every fifth is no JSON."""
    f = F.col("filing_id")
    ids = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 12).alias("filing_id")).distinct()
    above = F.concat(F.lit('{"board_report": "'), f.cast("string"), F.lit('/a.pdf", "extra": "'), f.cast("string"), F.lit('/none.md"}'))
    raw = lambda own: F.when(f % 5 == 0, "{broken").otherwise(own)
    manifests = ids.select(f, F.lit("in").alias("folder"), raw(above).alias("raw")).union(ids.filter(f % 2 == 1).select(f, F.concat(F.lit("in/"), f.cast("string")), raw(F.lit('{"financials": "notes.md", "gone": null}'))))
    return corpus.manifest_files(manifests, _files(spark, sf_dir))


@query(
    "s4_filled_roles",
    f"""WITH {FILES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY f, kind ORDER BY i) - 1 AS nth FROM files WHERE kind IS NOT NULL),
    given AS (SELECT f, 'board_report' AS role, 'in/' || f || '/given.pdf' AS path FROM (SELECT DISTINCT f FROM p) WHERE f % 7 = 0),
    b AS (SELECT f, 'board_report' AS role, path FROM k WHERE kind = 'pdf' AND nth = 0 AND f % 7 <> 0),
    m AS (SELECT f, arg_min(path, CASE WHEN kind = 'pdf' AND nth = 1 THEN 0 WHEN kind = 'md' AND nth = 0 THEN 1 WHEN kind = 'xl' AND nth = 0 THEN 2 END) AS path FROM k WHERE (kind = 'pdf' AND nth = 1) OR (kind <> 'pdf' AND nth = 0) GROUP BY f),
    a AS (SELECT * FROM given UNION ALL SELECT * FROM b UNION ALL SELECT f, 'financials', path FROM m WHERE path IS NOT NULL)
    SELECT f AS filing_id, role, path FROM a UNION ALL SELECT k.f, 'fallback_' || kind || '_' || nth, path FROM k WHERE kind <> 'pdf' AND path NOT IN (SELECT path FROM a)""",
)
def s4_filled_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    f = F.col("filing_id")
    given = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 12).alias("filing_id")).distinct().filter(f % 7 == 0)
    return corpus.fill_roles(given.select(f, F.lit("board_report").alias("role"), F.concat(F.lit("in/"), f.cast("string"), F.lit("/given.pdf")).alias("path")), files)


@query(
    "s12_ocr_coverage",
    f"""WITH {FILES_SQL}
    SELECT f AS filing_id, path, CASE WHEN kind = 'pdf' AND name = 'a.pdf' AND f % 2 = 0 THEN 'ocr/' || f || '/a/a.md' WHEN kind = 'pdf' AND name IN ('a.pdf', 'c.pdf') THEN 'ocr/' || f || '/' || name[1] || '.md' END AS output,
      CASE WHEN kind IN ('md', 'xl') THEN 'structured' WHEN kind IS NULL THEN 'native' WHEN name IN ('a.pdf', 'c.pdf') THEN 'cached' ELSE 'missing' END AS coverage FROM files""",
)
def s12_ocr_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("filing_id")
    ids = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 12).alias("filing_id")).distinct()
    at = lambda name: F.concat(F.lit("ocr/"), f.cast("string"), F.lit(f"/{name}"))
    outputs = ids.select(f, F.explode(F.array(at("a.md"), at("c.md"), at("b.json"), at("zz/zz.md"))).alias("path")).union(ids.filter(f % 2 == 0).select(f, at("a/a.md")))
    return corpus.ocr_coverage(_files(spark, sf_dir), outputs)

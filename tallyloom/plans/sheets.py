"""Queries of registers in any layout: the holders' tables written as cells, found again and summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import document_tree, header_scan, navigation, register, table_markup
from tallyloom.plans.learned import PRINTED_SQL
from tallyloom.plans.registry import ORACLES, query, table
from tallyloom.plans.returns import HOLDERS_SQL, holders
from tallyloom.sources.statements import line_items, statements

#: Headers of a register's columns and the holder's field below each.
COLUMNS = [
    ("Name of the\nShareholder", "name"), ("NATIONALITY", "country"), ("Number of securities  held", "securities"), ("Total amount of securities held", "amount"), ("Type of\nsecurity", "sec_type"), ("Class of security", "sec_class"),
    ("Nominal value per security", "face_value"), ("Category of shareholder", "category"), ("Trade payables", "owed"), ("Other liabilities", "owed"), ("Claims on holder", "claimed"),
]


def register_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holders' registers as cells: a filing's sheet, the row of its header and the order of its columns follow from its number.

    Before the header stand a title and a row that speaks of one role only; the other sheet has such
    a row too, and a whole header below the rows that are looked at.
    """
    f = F.col("filing_id")
    by = Window.partitionBy("filing_id").orderBy("row_no", F.when(F.col("face_value") > 0, F.col("face_value")).asc_nulls_last(), "name", "securities", "amount")
    rows = holders(spark, sf_dir).withColumn("line", F.row_number().over(by))
    texts = {c: F.col(c).cast("string") for c in ("name", "country", "sec_type", "sec_class", "category", "securities", "amount")}
    texts |= {"face_value": F.when(F.col("face_value") > 0, F.col("face_value").cast("string")).otherwise("n/a"), "owed": F.lit(" 1.5 "), "claimed": F.when(F.col("row_no") % 2 == 0, "none").otherwise("2")}
    place = lambda i: ((F.lit(i * 3) + f) % len(COLUMNS)).cast("int")
    cell = lambda sheet, row, col, value: F.struct(sheet.cast("int").alias("sheet_no"), row.cast("long").alias("row_no"), col.cast("int").alias("col_no"), value.cast("string").alias("value"))
    own, head = f % 2, f % 20
    body = rows.select("filing_id", F.inline(F.array(*[cell(own, F.col("line") + 20, place(i), texts[c]) for i, (_, c) in enumerate(COLUMNS)])))
    line = [cell(own, head, place(i), F.lit(h)) for i, (h, _) in enumerate(COLUMNS)]
    other = [cell(1 - own, F.lit(25), place(i), F.lit(h)) for i, (h, _) in enumerate(COLUMNS)]
    decoys = [cell(1 - own, F.lit(3), F.lit(0), F.lit("Number of shares by year")), cell(1 - own, F.lit(0), F.lit(0), F.lit("Cover"))]
    before = F.when(head > 0, F.array(cell(own, head - 1, F.lit(4), F.lit("Shareholders by name and place")))).otherwise(F.array().cast("array<struct<sheet_no:int,row_no:bigint,col_no:int,value:string>>"))
    # the filing's first row brings the sheets' other rows, so that both parts read the same rows, dealt out once
    heads = rows.filter("line = 1").select("filing_id", F.inline(F.concat(F.array(*line, *other, *decoys), before)))
    return body.unionByName(heads)


def found_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_scan.register_rows(register_cells(spark, sf_dir))


@query(
    "w12_register_headers",
    """WITH f AS (SELECT DISTINCT l_orderkey // 32 AS filing_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey // 32 % 6 <> 5)
    SELECT filing_id, (filing_id % 2)::INTEGER AS sheet_no, filing_id % 20 AS header_row, 3::INTEGER AS matches, (filing_id % 11)::INTEGER AS name, ((filing_id + 6) % 11)::INTEGER AS securities, ((filing_id + 9) % 11)::INTEGER AS amount,
      list_sort([(filing_id + 24) % 11, (filing_id + 27) % 11])::VARCHAR AS payables FROM f""",
)
def w12_register_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = register_cells(spark, sf_dir)
    heads = header_scan.header_rows(cells)
    roles = header_scan.column_roles(cells, heads).select("filing_id", "name", "securities", "amount", F.array_sort("payables").cast("string").alias("payables"))
    return heads.join(roles, "filing_id")


@query("x7_class_totals", ORACLES["a1_class_totals"])
def x7_class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.class_totals(found_holders(spark, sf_dir)).withColumn("amount", F.round("amount", 2))


@query("x7_nonresident_buckets", ORACLES["a2_nonresident_buckets"])
def x7_nonresident_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = register.nonresident_buckets(found_holders(spark, sf_dir))
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c.endswith("_amount")})


@query("x7_investors", ORACLES["a5_investors"])
def x7_investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.ranked(register.investors(found_holders(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


@query("x7_other_countries", ORACLES["a6_other_countries"])
def x7_other_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.other_countries(register.investors(found_holders(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


@query(
    "x7_dues",
    f"""WITH {HOLDERS_SQL} SELECT filing_id, name, count(*) * 3.0::DOUBLE AS payables, sum(CASE WHEN row_no % 2 = 0 THEN 0 ELSE 2 END)::DOUBLE AS receivables FROM h0 WHERE country <> 'india' GROUP BY 1, 2""",
)
def x7_dues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = register.foreign(found_holders(spark, sf_dir))
    return rows.groupBy("filing_id", F.lower("name").alias("name")).agg(F.sum("payables").alias("payables"), F.sum("receivables").alias("receivables"))


def ocr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and raw: the statements' tables as markup in blocks, one to six levels below the document, beside blocks of text."""
    items = line_items(spark, sf_dir)
    odd, year = F.col("fiscal_year") % 2 == 1, F.col("fiscal_year")
    row = F.concat(F.lit("<tr><td> <b>"), F.col("item"), F.lit("</b>\\n</td><TD class='n'>"), F.substring("item", 1, 1), F.lit("</TD><td>&#49;&#x32;&nbsp; &amp;</td></tr><tr></tr>"))
    rows = F.array_join(F.array_sort(F.collect_list(F.struct("item", row.alias("row")))).getField("row"), "")
    docs = items.groupBy("doc_id", "company", "fiscal_year").agg(rows.alias("rows"))
    head = F.concat(F.lit("<table border='1'><thead><tr><th>Particulars</th><th>Note</th><th>As at\\t March 31, "), F.when(odd, year).otherwise(year - 1).cast("string"), F.lit("</th></tr></thead>"))
    block = F.concat(F.lit('{"block_type":"Table","html":"'), head, F.col("rows"), F.lit('</table>"}'))
    nested = F.aggregate(F.sequence(F.lit(1), (F.col("company") % 6 + 1).cast("int")), block, lambda acc, i: F.concat(F.lit('{"block_type":"Page","children":[{"block_type":"Text","html":"<table><tr><td>x</td></tr></table>","children":null},7,'), acc, F.lit("]}")))
    return docs.select("doc_id", nested.alias("raw"))


@query("s8_ocr_tables", ORACLES["d3_table_cells"])
def s8_ocr_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that d3 finds in markdown, from nested blocks."""
    cells = table_markup.ocr_tables(ocr_json(spark, sf_dir))
    heads = cells.filter("row_no = 0 and col_no = 2").select("doc_id", F.col("value").alias("third"))
    pick = lambda n: F.max(F.when(F.col("col_no") == n, F.col("value")))
    rows = cells.filter("row_no > 0").groupBy("doc_id", "row_no").agg(pick(0).alias("label"), pick(1).alias("note"), pick(2).alias("rest")).filter("rest = '12 &'")
    return rows.drop("rest").join(heads, "doc_id")


@query(
    "w5_stricter_tables",
    f"""WITH {PRINTED_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY item))::INTEGER AS nth FROM columned)
    SELECT doc_id, 'strict' AS way, 0::INTEGER AS table_no, nth + 1 AS row_no, item, c3 AS last FROM (SELECT doc_id, nth, '**' || item || '**' AS item, c3 FROM n)
    UNION ALL SELECT doc_id, 'loose', 0, nth - 1, '**' || item || '**', c3 FROM n UNION ALL SELECT DISTINCT doc_id, 'loose', 1, 0, 'c', 'd' FROM n""",
)
def w5_stricter_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body rows by both readings; a table whose second line is no separator and whose lines end without a bar is one for the looser only."""
    docs = statements(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n\n| alone\n|a | b\n| not | kept\n|c | d | e\n\n|one|\nend")))
    strict = table_markup.strict_tables(docs).select("doc_id", F.lit("strict").alias("way"), "table_no", F.posexplode("rows").alias("row_no", "row")).filter("row_no > 1")
    loose = table_markup.loose_tables(docs).select("doc_id", F.lit("loose").alias("way"), "table_no", F.posexplode("rows").alias("row_no", "row"))
    return strict.union(loose).select("doc_id", "way", "table_no", "row_no", F.get("row", F.lit(0)).alias("item"), F.try_element_at("row", F.lit(-1)).alias("last"))


@query(
    "w15_best_rows",
    f"""WITH {PRINTED_SQL},
    v AS (SELECT *, list_filter([item, item[1], c2, c3], lambda x: regexp_matches(x, '[0-9]'))[-2] AS current, list_filter([item, item[1], c2, c3], lambda x: regexp_matches(x, '[0-9]'))[-1] AS previous FROM columned),
    s AS (SELECT *, 10 - CASE WHEN regexp_matches(current, '[^0-9,.-]') OR regexp_matches(previous, '[^0-9,.-]') THEN 100 ELSE 0 END - CASE WHEN contains(current, '.') OR contains(previous, '.') THEN 5 ELSE 0 END AS score FROM v),
    d AS (SELECT DISTINCT doc_id FROM items),
    decoys(variable, nth, current, previous, score) AS (VALUES ('2-high', 1, '2-HIGH of March', '', 0), ('3-medium', 2, '12', '15', 10), ('4-not specified', 3, 'March 31', 'March 30', -132), ('5-low', 4, '7', '8', 18)),
    names(variable, item) AS (VALUES ('2-high', '2-HIGH'), ('3-medium', '3-MEDIUM'), ('4-not specified', '4-NOT SPECIFIED'), ('5-low', '5-LOW')),
    all_ AS (SELECT doc_id, variable, 0 AS real, current, previous, score FROM d, decoys UNION ALL SELECT doc_id, variable, 1, current, previous, score FROM s JOIN names USING (item)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, variable ORDER BY score DESC, real) AS nth FROM all_)
    SELECT doc_id, variable, current, previous, score::INTEGER AS score, 'FOUND' AS status FROM r WHERE nth = 1
    UNION ALL SELECT NULL, 'turnover', NULL, NULL, NULL, 'NOT_FOUND' UNION ALL SELECT doc_id, 'plain', '', '', 0, 'PARTIAL' FROM d""",
)
def w15_best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement has a table of decoys before its own."""
    decoys = "## Notes\n| Item | A | B |\n|---|---|---|\n| 2-HIGH of March | as at March | March |\n| 3-MEDIUM of old | 12 | 15 |\n| Total 4-NOT SPECIFIED | March 31 | March 30 |\n| Total 5-LOW | 7 | 8 |\n| plain words | | - |\n\n"
    docs = statements(spark, sf_dir).withColumn("text", F.concat(F.lit(decoys), "text"))
    best = navigation.best_table_rows(document_tree.parsed_tables(docs), ["2-high", "3-medium", "4-not specified", "5-low", "turnover", "plain"])
    return best.select("doc_id", "variable", "current", "previous", "score", "status")


#: Fields that a merged cell states line by line, and how its particulars name them.
LINE_FIELDS = [("stock", ["inventor", "stock"]), ("cash", ["cash"]), ("dues", ["payable", "dues"]), ("other", ["other"])]


@query(
    "w16_merged_lines",
    """WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, p_partkey % 4 AS k FROM part),
    f AS (SELECT doc_id, n, k, unnest(CASE k WHEN 0 THEN [{'f': 'cash', 'i': 1}, {'f': 'stock', 'i': 2}] WHEN 1 THEN [{'f': 'dues', 'i': 1}, {'f': 'other', 'i': 2}, {'f': 'cash', 'i': 3}] WHEN 2 THEN [{'f': 'stock', 'i': 1}] ELSE [] END) AS u FROM p)
    SELECT doc_id, u.f AS field, CASE k WHEN 0 THEN CASE u.i WHEN 1 THEN n ELSE -n END WHEN 1 THEN CASE u.i WHEN 1 THEN n + 1 ELSE 1000 + n END ELSE n END::DOUBLE AS fy, CASE k WHEN 2 THEN 0 ELSE n * u.i END::DOUBLE AS py FROM f""",
)
def w16_merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey") % 4
    said = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    pick = lambda *forms: F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).otherwise(forms[3])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit(1).alias("row_no"),
        pick(F.lit("Cash at bank<br>Stock"), F.lit("Trade Payables<BR/>Other items\ncash"), F.lit("Inventories of stock"), F.lit("Nothing")).alias("particulars"),
        pick(said(n, "<br>(", n, ")"), said(" <br>", n + 1, "\n1,0", F.lpad(n.cast("string"), 2, "0")), said(n), said(n)).alias("fy_cell"),
        pick(said(n, "<br />", n * 2), said(n, "<br>", n * 2, "<br>", n * 3), F.lit(None).cast("string"), said(n)).alias("py_cell"),
    )
    return table_markup.allocate_lines(rows, LINE_FIELDS, {"fy": "fy_cell", "py": "py_cell"}).select("doc_id", "field", "fy", "py")


@query(
    "j24_merged_targets",
    """WITH c AS (SELECT l_suppkey % 7 AS sheet, l_orderkey % 200 AS row_no, l_partkey % 90 AS col_no, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT p_partkey % 7 AS sheet, p_partkey // 7 % 40 * 5 AS min_row, p_partkey // 7 % 40 * 5 + p_partkey % 5 AS max_row, p_partkey // 280 % 9 * 10 AS min_col, p_partkey // 280 % 9 * 10 + p_partkey % 3 * 3 AS max_col FROM part)
    SELECT sheet, row_no, col_no, n, coalesce(t[1], row_no) AS target_row, coalesce(t[2], col_no) AS target_col FROM (
      SELECT c.*, (SELECT min((min_row, min_col)) FROM r WHERE r.sheet = c.sheet AND c.row_no BETWEEN min_row AND max_row AND c.col_no BETWEEN min_col AND max_col) AS t FROM c)""",
)
def j24_merged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    row, col = F.floor(k / 7) % 40 * 5, F.floor(k / 280) % 9 * 10
    ranges = table(spark, sf_dir, "part").select((k % 7).alias("sheet"), row.alias("min_row"), (row + k % 5).alias("max_row"), col.alias("min_col"), (col + k % 3 * 3).alias("max_col"))
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("sheet"), (F.col("l_orderkey") % 200).alias("row_no"), (F.col("l_partkey") % 90).alias("col_no")).agg(F.count("*").alias("n"))
    return table_markup.merged_targets(cells, ranges)

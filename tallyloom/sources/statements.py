"""Statements of filings as OCR markdown, rendered from the order tables.

They are the round trip of the parsing jobs: what is parsed back must be what the tables hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.filings import exact_sum, table


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, company, fiscal_year, item, fy and py (null if there is none): sums by order priority."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderpriority").alias("item"), "o_totalprice")
    now = orders.groupBy("company", "fiscal_year", "item").agg(exact_sum(F.col("o_totalprice")).alias("fy"))
    before = now.select("company", (F.col("fiscal_year") + 1).alias("fiscal_year"), "item", F.col("fy").alias("py"))
    rows = now.join(before, ["company", "fiscal_year", "item"], "left")
    return rows.select((F.col("company") * 10000 + F.col("fiscal_year")).alias("doc_id"), "company", "fiscal_year", "item", "fy", "py")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: a report of headings, paragraphs, an image and one table, a row for each item.

    Items of odd years are printed with the current year first. Negative and absent amounts follow
    the customs of such statements.
    """
    items = line_items(spark, sf_dir)
    year, odd = F.col("fiscal_year"), F.col("fiscal_year") % 2 == 1
    amount = lambda c: F.when(c.isNull(), "-").when(c % 7 < 1, F.concat(F.lit("("), F.format_number(c, 2), F.lit(")"))).otherwise(F.format_number(c, 2))
    pair = F.when(odd, F.concat_ws(" | ", amount(F.col("fy")), amount(F.col("py")))).otherwise(F.concat_ws(" | ", amount(F.col("py")), amount(F.col("fy"))))
    row = F.concat(F.lit("| **"), F.col("item"), F.lit("** | "), F.substring("item", 1, 1), F.lit(" | "), pair, F.lit(" |"))
    table_rows = F.array_join(F.array_sort(F.collect_list(F.struct("item", row.alias("row")))).getField("row"), "\n")
    docs = items.groupBy("doc_id", "company", "fiscal_year").agg(table_rows.alias("rows"))
    years = lambda y: F.concat(F.lit("As at March 31, "), y.cast("string"))
    columns = F.when(odd, F.concat_ws(" | ", years(year), years(year - 1))).otherwise(F.concat_ws(" | ", years(year - 1), years(year)))
    text = F.concat(
        F.lit("Page 1 of the report\n# Company "), F.col("company").cast("string"), F.lit("\n![logo](x.png)\nWe have audited the statements\nof the company.\n\n## Financial statements\nThe notes are part of them.\n### Balance Sheet\n(Amount in thousands)\n\n| Particulars | Note | "),
        columns, F.lit(" |\n|---|:---:|---|---|\n"), F.col("rows"), F.lit("\n\n## Signatures\nDirector"),
    )
    return docs.select("doc_id", text.alias("text"))

"""Queries of previous returns: what they say by key, and what a template takes over from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import prior_return
from tallyloom.plans.registry import query, table

INVESTORS = "No. of foreign direct investors during the year (10% or more Equity participation)"
#: The template's sheets: row numbers and cells.
TEMPLATE = {
    "Section I": {0: ["", "Field Name", "Particulars", "Source of Information"], 1: ["", "Name of the Indian Company", "", "as filed"], 2: ["", "Mobile Number", "", "Previous FLA unless there is a change"], 3: ["", "Telephone", "", "Current"], 4: ["", "Website (if any)", "", "previous fla"], 5: ["", "", "", "previous fla"]},
    "Section II": {0: ["", "Field name", "Source", "End March PY", "End March PY", "End March FY", "End March FY"], 3: ["", "Debt"], 5: ["", "Paid-up capital"], 6: ["", "Total: all"], 7: ["", "Auto-calculated sum"], 24: ["", "Debt", "prefill"], 26: ["", "Reserves"]},
    "Section III": {0: ["", "Field name"], 10: ["", "Debt"], 12: ["", "", "", "end march py", "end march py", "End March FY", "End March FY"], 13: ["", "Reserves"], 14: ["Debt", ""], 16: ["", "", "", "End March FY", "End March FY", "End March PY", "End March PY"], 17: ["", "Paid-up capital"], 18: ["", "", "Nothing known"]},
    "Section IV": {0: ["", "Field name", "", "End March PY"], 12: ["", "Debt"]},
}


def prior_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id and text of a return for each customer: lines with keys, some repeated, and two tables that share items.

    Amounts have five digits or more, so that none of them reads as a year.
    """
    k = F.col("c_custkey")
    n = k + 10_000
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lines = text(
        "# FLA\n**1. Name of the Indian<br>Company** : ", F.col("c_name"), "\n**Website** : \n**Mobile No** : 1\ntext **Mobile No** : ", k, "<br>\n1.a No. of foreign direct investors : ", k % 7, "\nTelephone no. : 044-", k,
        F.when(k % 2 == 0, "\n**Designation** : Partner").otherwise("\nDesignation : nan"), "\n\n",
    )
    first = text("| Item | End March 2024 | End March 2024 | End March 2023 | End March 2023 |\n|---|---|---|---|---|\n| Paid-up<br>capital | ", n, " | ", n * 2, " | ", n + 1, " | ", n * 3, " |\n| Type of capital | 1 | 2 | 3 | 4 |\n| Reserves | | ", n + 5, " | 4 | |\n\n")
    second = text("| No | A | B |\n|---|---|---|\n| | x | y |\n| Type | FY 2022 | as of 2021 |\n| Paid-up capital | 99 | 98 |\n| Debt | ", F.when(k % 3 != 0, n).cast("string"), " | 7 |\n")
    second = F.when(k % 3 == 0, text("| No | A | B |\n|---|---|---|\n| | x | y |\n| Type | FY 2022 | as of 2021 |\n| Paid-up capital | 99 | 98 |\n| Debt | - | 7 |\n")).otherwise(second)
    return table(spark, sf_dir, "customer").select(k.alias("filing_id"), F.concat(lines, first, second).alias("text"))


FIELDS_SQL = f"""c AS (SELECT c_custkey AS k, c_custkey + 10000 AS n, c_name FROM customer),
    said AS (SELECT k AS filing_id, unnest([{{'key': '1. Name of the Indian Company', 'value': c_name}}, {{'key': 'Website', 'value': ''}}, {{'key': 'Mobile No', 'value': k::VARCHAR}}, {{'key': '1.a No. of foreign direct investors', 'value': (k % 7)::VARCHAR}},
      {{'key': 'Telephone No. (with extension)', 'value': '044-' || k}}, {{'key': 'Mobile Number*', 'value': '1'}}, {{'key': '{INVESTORS}', 'value': (k % 7)::VARCHAR}}, {{'key': CASE WHEN k % 2 = 0 THEN 'Designation' END, 'value': 'Partner'}}, {{'key': CASE WHEN k % 2 = 0 THEN 'Designation*' END, 'value': 'Partner'}},
      {{'key': 'Paid-up capital', 'value': (2 * n)::VARCHAR}}, {{'key': 'Paid-up capital__shares', 'value': n::VARCHAR}}, {{'key': 'Paid-up capital__PY', 'value': (3 * n)::VARCHAR}}, {{'key': 'Paid-up capital__shares__PY', 'value': (n + 1)::VARCHAR}},
      {{'key': 'Reserves', 'value': (n + 5)::VARCHAR}}, {{'key': 'Reserves__shares__PY', 'value': '4'}}, {{'key': 'Debt', 'value': CASE WHEN k % 3 = 0 THEN '-' ELSE n::VARCHAR END}}, {{'key': 'Debt__PY', 'value': '7'}}, {{'key': 'Type', 'value': 'FY 2022'}}, {{'key': 'Type__PY', 'value': 'as of 2021'}},
      {{'key': 'Website (if any)', 'value': ''}}, {{'key': 'Mobile Number', 'value': k::VARCHAR}}]) AS u FROM c),
    prior AS (SELECT filing_id, u.key AS key, u.value AS value FROM said WHERE u.key IS NOT NULL)"""


@query("x9_prior_fields", f"WITH {FIELDS_SQL} SELECT * FROM prior")
def x9_prior_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior_return.prior_fields(prior_texts(spark, sf_dir)).select("filing_id", "key", "value")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This year's cells of each customer. Section I writes to column 4; Section III of every fifth customer ends early."""
    k = F.col("c_custkey")
    n = k + 10_000
    cell = lambda sheet, row, col, value: F.struct(F.lit(sheet).alias("sheet"), F.lit(row).alias("row_no"), F.lit(col).alias("col_no"), (F.lit(value) if isinstance(value, str) else value.cast("string")).alias("value"))
    cells = [
        cell("Section I", 0, 4, "Particulars"), cell("Section I", 2, 4, F.when(k % 4 == 0, "Enter a number").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, "555").otherwise("0")), cell("Section I", 4, 4, F.when(k % 2 == 0, "www.x.org")),
        cell("Section II", 5, 3, "ignored"), cell("Section II", 5, 5, F.when(k % 2 == 0, n.cast("string")).otherwise("0")), cell("Section II", 5, 6, "17"), cell("Section II", 24, 2, F.when(k % 2 == 0, "now")), cell("Section II", 30, 0, "end"),
        cell("Section III", 13, 3, "x"), cell("Section III", 14, 4, F.when(k % 2 == 0, "8")), cell("Section III", F.when(k % 5 == 0, 15).otherwise(40), 0, "end"), cell("Section III", 13, 4, n + 5),
    ]
    return table(spark, sf_dir, "customer").select(k.alias("filing_id"), F.inline(F.array(*[F.struct(c["sheet"], c["row_no"].cast("int").alias("row_no"), c["col_no"], c["value"]) for c in cells])))


@query(
    "k5_against_template",
    """WITH c AS (SELECT c_custkey AS k, c_custkey + 10000 AS n, c_name AS name, c_custkey % 3 <> 0 AS owes FROM customer),
    d AS (SELECT *, CASE WHEN owes THEN n::VARCHAR ELSE '-' END AS debt, CASE k % 4 WHEN 1 THEN k::VARCHAR WHEN 2 THEN '555' ELSE '' END AS mobile, CASE WHEN k % 2 = 0 THEN n::VARCHAR ELSE '' END AS shares, CASE WHEN k % 2 = 0 THEN '8' ELSE '' END AS iii, k % 5 <> 0 AS long FROM c),
    r AS (SELECT k, unnest([
      {'s': 'Section I', 'n': 1, 'f': 'Name of the Indian Company', 'm': 'PREFILL FROM PREVIOUS FLA', 'p': name, 'c': '', 'v': name, 'r': 'Current Value Missing -> Used Previous', 'shown': true},
      {'s': 'Section I', 'n': 2, 'f': 'Mobile Number', 'm': 'PREVIOUS FLA UNLESS THERE IS A CHANGE', 'p': k::VARCHAR, 'c': mobile, 'v': CASE WHEN mobile = '' THEN k::VARCHAR ELSE mobile END,
        'r': CASE WHEN mobile = '' THEN 'Current Value Missing -> Used Previous' WHEN mobile = k::VARCHAR THEN 'Current Value Same -> Used Previous' ELSE 'Current Value Different -> Used Current' END, 'shown': true},
      {'s': 'Section I', 'n': 4, 'f': 'Website (if any)', 'm': 'PREVIOUS FLA', 'p': '', 'c': CASE WHEN k % 2 = 0 THEN 'www.x.org' ELSE '' END, 'v': CASE WHEN k % 2 = 0 THEN 'www.x.org' ELSE '' END, 'r': CASE WHEN k % 2 = 0 THEN 'Current Value Present -> Used Current' ELSE 'Current Value Missing -> Used Previous' END, 'shown': true},
      {'s': 'Section II', 'n': 24, 'f': 'Debt', 'm': 'PREFILL', 'p': debt, 'c': CASE WHEN k % 2 = 0 THEN 'now' ELSE '' END, 'v': CASE WHEN k % 2 = 0 THEN 'now' ELSE debt END, 'r': CASE WHEN k % 2 = 0 THEN 'Current Value Present -> Used Current' ELSE 'Current Value Missing -> Used Previous' END, 'shown': true},
      {'s': 'Section II', 'n': 5, 'f': 'Paid-up capital (PY Shares/Col1)', 'm': 'STRICT PY', 'p': n::VARCHAR, 'c': 'ignored', 'v': n::VARCHAR, 'r': 'PY Column -> STRICTLY Used Previous FLA', 'shown': true},
      {'s': 'Section II', 'n': 5, 'f': 'Paid-up capital (PY Amount/Col2)', 'm': 'STRICT PY', 'p': (2 * n)::VARCHAR, 'c': '', 'v': (2 * n)::VARCHAR, 'r': 'PY Column -> STRICTLY Used Previous FLA', 'shown': true},
      {'s': 'Section II', 'n': 5, 'f': 'Paid-up capital (FY Shares/Col1)', 'm': 'PREVIOUS FLA UNLESS THERE IS A CHANGE', 'p': n::VARCHAR, 'c': shares, 'v': n::VARCHAR, 'r': CASE WHEN shares = '' THEN 'Current Value Missing -> Used Previous' ELSE 'Current Value Same -> Used Previous' END, 'shown': true},
      {'s': 'Section II', 'n': 5, 'f': 'Paid-up capital (FY Amount/Col2)', 'm': 'PREVIOUS FLA UNLESS THERE IS A CHANGE', 'p': (2 * n)::VARCHAR, 'c': '17', 'v': '17', 'r': 'Current Value Different -> Used Current', 'shown': true},
      {'s': 'Section II', 'n': 24, 'f': 'Debt (PY Shares/Col1)', 'm': 'STRICT PY', 'p': debt, 'c': 'Ignored', 'v': debt, 'r': 'PY Column -> STRICTLY Used Previous FLA', 'shown': true},
      {'s': 'Section II', 'n': 24, 'f': 'Debt (PY Amount/Col2)', 'm': 'STRICT PY', 'p': debt, 'c': 'Ignored', 'v': debt, 'r': 'PY Column -> STRICTLY Used Previous FLA', 'shown': true},
      {'s': 'Section II', 'n': 24, 'f': 'Debt (FY Amount/Col2)', 'm': 'STRICT_VALIDATION', 'p': debt, 'c': 'Missing', 'v': '', 'r': 'Missing in Current -> Needs Review', 'shown': true},
      {'s': 'Section II', 'n': 26, 'f': 'Reserves (PY Amount/Col2)', 'm': 'STRICT PY', 'p': (n + 5)::VARCHAR, 'c': 'Ignored', 'v': (n + 5)::VARCHAR, 'r': 'PY Column -> STRICTLY Used Previous FLA', 'shown': true},
      {'s': 'Section III', 'n': 13, 'f': 'Reserves (PY Amount/Col2)', 'm': 'STRICT_VALIDATION', 'p': (n + 5)::VARCHAR, 'c': (n + 5)::VARCHAR, 'v': (n + 5)::VARCHAR, 'r': 'Values Match Perfectly', 'shown': true},
      {'s': 'Section III', 'n': 13, 'f': 'Reserves (FY Amount/Col2)', 'm': 'STRICT_VALIDATION', 'p': (n + 5)::VARCHAR, 'c': 'Missing', 'v': '', 'r': 'Missing in Current -> Needs Review', 'shown': true},
      {'s': 'Section III', 'n': 14, 'f': 'Debt (PY Amount/Col2)', 'm': 'STRICT_VALIDATION', 'p': debt, 'c': CASE WHEN iii = '' THEN 'Missing' ELSE iii END, 'v': iii, 'r': CASE WHEN iii = '' THEN 'Missing in Current -> Needs Review' WHEN iii = debt THEN 'Values Match Perfectly' ELSE 'Mismatch Detected -> Needs Review' END, 'shown': true},
      {'s': 'Section III', 'n': 14, 'f': 'Debt (FY Amount/Col2)', 'm': 'STRICT_VALIDATION', 'p': debt, 'c': 'Missing', 'v': '', 'r': 'Missing in Current -> Needs Review', 'shown': true},
      {'s': 'Section III', 'n': 17, 'f': 'Paid-up capital (PY Amount/Col2)', 'm': 'STRICT_VALIDATION', 'p': (2 * n)::VARCHAR, 'c': 'Missing', 'v': '', 'r': 'Missing in Current -> Needs Review', 'shown': long},
      {'s': 'Section III', 'n': 17, 'f': 'Paid-up capital (FY Amount/Col2)', 'm': 'STRICT_VALIDATION', 'p': (2 * n)::VARCHAR, 'c': 'Missing', 'v': '', 'r': 'Missing in Current -> Needs Review', 'shown': long}]) AS u FROM d)
    SELECT k AS filing_id, u.s AS sheet, u.n::INTEGER AS row_no, u.f AS field, u.m AS mapping, u.p AS previous, u.c AS current, u.v AS final, u.r AS reason FROM r WHERE u.shown""",
)
def k5_against_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.createDataFrame([(s, r, c, v) for s, rows in TEMPLATE.items() for r, line in rows.items() for c, v in enumerate(line)], "sheet string, row_no int, col_no int, value string")
    return prior_return.against_template(cells, prior_return.prior_fields(prior_texts(spark, sf_dir)), grid_cells(spark, sf_dir))

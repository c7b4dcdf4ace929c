"""Flags as the cells of report templates, and the tables of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import squash_key
from tallyloom.sources.shared import saved

#: The row of the compliance sheet that each rule has, counted from the first.
FIRST_ROW = 35
RULE_ORDER = (
    "COMP_SMALL_CO", "COMP_CARO", "COMP_ROTATION", "COMP_IND_AS", "COMP_XBRL", "COMP_VIGIL", "COMP_IFC", "COMP_INT_AUDIT", "COMP_SEC_AUDIT", "COMP_KMP", "COMP_LOAN_186", "COMP_LOAN_DIRECTOR", "COMP_COST_AUDIT",
    "COMP_CHARGE_FORM", "COMP_AOC_1", "COMP_AOC_2", "COMP_RPT_OMNIBUS", "COMP_CSR", "COMP_CSR_COMMITTEE", "COMP_DEPOSIT_DEC", "COMP_DPT_3", "COMP_MSME", "COMP_BEN_2", "COMP_MGT_8", "COMP_MGT_7_CERT",
)
#: Rules whose answer stands in the column of applicability.
APPLICABILITY = "^COMP_SEC_18[56]_"


def all_flags(*families: DataFrame) -> DataFrame:
    """One table of flags of several families; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def _cells(*made: tuple[str, Column, Column | None]) -> Column:
    """An array of the sheet's cells: column, value, and whether it is written at all."""
    each = [F.when(test, F.struct(F.lit(c).alias("col"), value.cast("string").alias("value"))) if test is not None else F.struct(F.lit(c).alias("col"), value.cast("string").alias("value")) for c, value, test in made]
    return F.array_compact(F.array(*each))


def _placed(rows: DataFrame, sheet: str, cells: Column) -> DataFrame:
    out = rows.withColumn("__c", F.explode(cells))
    return out.select("filing_id", F.lit(sheet).alias("sheet"), F.concat("__c.col", F.col("row_no").cast("string")).alias("cell"), F.col("__c.value").alias("value"))


def by_rule(flags: DataFrame) -> DataFrame:
    """filing_id, sheet (compliance), cell and value of flags whose rule has a fixed row; others give nothing.

    flags have filing_id, rule_id, particulars, user_value and reason; the columns of the previous report are cleared.
    """
    row = F.array_position(F.array(*map(F.lit, RULE_ORDER)), F.col("rule_id")) + FIRST_ROW - 1
    rows = flags.withColumn("row_no", row).filter(F.col("rule_id").isin(*RULE_ORDER))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _placed(rows, "compliance", _cells(("C", F.col("particulars"), None), ("D", text("user_value"), None), ("E", text("reason"), None), ("F", F.lit(""), None), ("G", F.lit(""), None)))


def _template(template: DataFrame) -> DataFrame:
    """key and row_no; of rows with equal labels the last counts, rows without a label do not."""
    return template.select(squash_key(F.col("particulars")).alias("key"), "row_no").filter("key <> ''").groupBy("key").agg(F.max("row_no").alias("row_no"))


def by_label(flags: DataFrame, template: DataFrame, sheet: str) -> DataFrame:
    """filing_id, sheet, cell and value of flags whose particulars are a row's of the template (row_no, particulars), spaces, marks and case aside.

    sheet errors: the answer (else No if Failed, Yes if not) and the reason. sheet loans: the amount
    unless it is 0, and the answer, in the column of applicability for the rules on loans.
    """
    rows = flags.withColumn("key", squash_key(F.col("particulars"))).join(_template(template), "key")
    if sheet == "errors":
        answer = F.coalesce(F.nullif("user_value", F.lit("")), F.when(F.col("status") == "Failed", "No").otherwise("Yes"))
        return _placed(rows, sheet, _cells(("C", answer, None), ("D", F.coalesce("reason", F.lit("")), None)))
    applies = F.coalesce(F.col("rule_id").rlike(APPLICABILITY), F.lit(False))
    return _placed(rows, sheet, _cells(("F", F.col("actual_value"), F.coalesce(F.col("actual_value") != 0, F.lit(False))), ("D", F.col("user_value"), applies), ("G", F.col("user_value"), ~applies)))


def unmatched(flags: DataFrame, template: DataFrame) -> DataFrame:
    """particulars and n: flags that no row of the template stands for (null particulars among them), by their label."""
    rows = flags.groupBy("particulars").agg(F.count("*").alias("n"))
    return rows.withColumn("key", squash_key(F.col("particulars"))).join(_template(template), "key", "left_anti").select("particulars", "n")


def report_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """report, filing_id and row (JSON) of all tables; a single row that says so if all are empty. The rows are written once, so looking for one of them does not compute the tables again."""
    each = [df.select(F.lit(name).alias("report"), F.col("filing_id").cast("string").alias("filing_id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")) for name, df in tables.items()]
    rows = saved(reduce(DataFrame.unionByName, each), "report")
    none = rows.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return rows.unionByName(none.select(F.lit("flags").alias("report"), F.lit(None).cast("string").alias("filing_id"), F.lit('{"message":"No flags generated"}').alias("row")))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as JSON lines in a folder for each report, written by all tasks."""
    report_tables(tables).write.mode("overwrite").partitionBy("report").json(path)


def validation_summary(checks: DataFrame) -> DataFrame:
    """filing_id and summary, such as 7 / 8 checks passed; a null result has not passed."""
    return checks.groupBy("filing_id").agg(F.concat(F.count_if("passed").cast("string"), F.lit(" / "), F.count("*").cast("string"), F.lit(" checks passed")).alias("summary"))

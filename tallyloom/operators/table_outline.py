"""Outlines in tables: headers that go on in the next row, and rows nested by their markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import outline_level

KEYS = ["doc_id", "block_no"]


def merge_header_rows(cells: DataFrame) -> DataFrame:
    """Cells whose header takes in row 1, where that row names a year and its first cell has no letters; row 1 then goes and later rows move up."""
    second = cells.filter("row_no = 1").groupBy(*KEYS).agg(
        F.max((F.col("col_no") == 0) & F.col("value").rlike("[A-Za-z]")).alias("labelled"), F.max(F.col("value").rlike(r"(19|20)\d\d")).alias("year")
    )
    goes = second.filter("year and not labelled").select(*KEYS, F.lit(True).alias("goes"))
    more = cells.filter("row_no = 1").join(goes, KEYS).select(*KEYS, "col_no", F.col("value").alias("more"))
    out = cells.join(goes, KEYS, "left").join(more, [*KEYS, "col_no"], "left").filter("goes is null or row_no <> 1")
    header = F.trim(F.concat_ws(" ", "header", F.nullif(F.col("more"), F.lit(""))))
    moved = F.when(F.col("goes") & (F.col("row_no") > 1), F.col("row_no") - 1).otherwise(F.col("row_no"))
    return out.select(*KEYS, moved.alias("row_no"), "col_no", header.alias("header"), F.when(F.col("row_no") == 0, header).otherwise(F.col("value")).alias("value"))


def outline(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, block_no, row_no, row_label) with level and parent_row: the nearest earlier row of a smaller level.

    Rows without a marker have level null and hang on the latest marked row.
    """
    by = Window.partitionBy(*KEYS).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("level", outline_level(F.col("row_label")))
    nearest = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("row_no")), ignorenulls=True).over(by)) for k in range(3)]
    latest = F.last(F.when(F.col("level").isNotNull(), F.col("row_no")), ignorenulls=True).over(by)
    return marked.withColumn("parent_row", F.when(F.col("level").isNull(), latest).otherwise(F.greatest(*nearest)))


def note_references(rows: DataFrame) -> DataFrame:
    """Rows whose note is a number, such as 12 or 12a, with note_ref."""
    return rows.withColumn("note_ref", F.when(F.trim("note").rlike(r"^\d+[a-z]?$"), F.trim("note"))).filter("note_ref is not null")

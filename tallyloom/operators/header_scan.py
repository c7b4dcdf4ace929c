"""Where the header of a sheet stands, which column has which role, and the rows below it.

Cells come in long form: filing_id, sheet_no, row_no and col_no (from 0) and value. Only the first rows
of a sheet are looked at for a header; what is kept of them is one row for each filing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.arrays import once

#: Rows of a sheet in which a header may stand, of registers and of templates.
SCANNED, TEMPLATE_SCANNED = 20, 10
#: Words of the number of securities.
SECURITIES = ("number of security", "number of shares", "no. of shares", "number of securit")
#: Role, the words of which a column's header has one, and which of several columns counts.
ROLES = [
    ("country", ["nationality", "country"], "last"), ("securities", list(SECURITIES), "last"), ("any_amount", ["amount"], "last"), ("sec_type", ["type of security"], "last"), ("sec_class", ["class of security"], "last"),
    ("amount", ["amount of securities held"], "first"), ("face_value", ["nominal value", "face value"], "first"), ("holder_type", ["type of sharehold"], "last"),
]
TEXTS = ("name", "country", "sec_type", "sec_class", "holder_type", "category")
NUMBERS = ("securities", "amount", "face_value")


def _any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def _matches(text: Column) -> Column:
    """Of how many a row's text speaks: a holder's name, their country and the number of securities."""
    tests = (text.contains("name") & text.contains("shareholder"), _any(text, ["nationality", "country"]), _any(text, SECURITIES))
    return reduce(Column.__add__, [t.cast("int") for t in tests])


def header_rows(cells: DataFrame) -> DataFrame:
    """filing_id, sheet_no, header_row and matches: of each filing the row that speaks of most of a holder's name, their country and the number of securities.

    Ties go to the first sheet and row. Where no row speaks of any, it is row 0 of the first sheet.
    """
    top = cells.filter((F.col("row_no") < SCANNED) & F.col("value").isNotNull())
    rows = top.groupBy("filing_id", "sheet_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.lower("value").alias("value")))).alias("cells"))
    text = F.array_join("cells.value", " ")
    matches = _matches(text)
    scored = rows.select("filing_id", "sheet_no", F.when(matches > 0, F.col("row_no")).otherwise(0).alias("header_row"), matches.alias("matches"))
    best = scored.groupBy("filing_id").agg(F.min(F.struct((-F.col("matches")).alias("less"), "sheet_no", "header_row")).alias("b"))
    return best.select("filing_id", "b.sheet_no", "b.header_row", (-F.col("b.less")).alias("matches"))


def column_roles(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """filing_id, sheet_no, header_row and the column of each role; payables and receivables are arrays of columns.

    Filings without a column for the holder's name, their country or the securities are left out.
    Where none tells the number of securities, the last column of an amount stands for it.
    """
    line = cells.join(headers, ["filing_id", "sheet_no"]).filter(F.col("row_no") == F.col("header_row"))
    text = F.trim(F.regexp_replace(F.lower("value"), r"\s+", " "))
    line = line.filter("value is not null").select("filing_id", "sheet_no", "header_row", "col_no", text.alias("text"))
    said = F.col("text")
    of = lambda test, pick: (F.max if pick == "last" else F.min)(F.when(test, F.col("col_no")))
    owed, claimed = _any(said, ["payable", "liabilit"]), _any(said, ["receivable", "claim"])
    every = lambda test: F.collect_set(F.when(test, F.col("col_no")))
    found = line.groupBy("filing_id", "sheet_no", "header_row").agg(
        of(said.contains("name") & said.contains("shareholder"), "last").alias("name"),
        *(of(_any(said, words), pick).alias(role) for role, words, pick in ROLES),
        of(said.contains("category of shareholder") & ~said.contains("type of sharehold"), "last").alias("category"),
        every(owed).alias("payables"), every(claimed & ~owed).alias("receivables"),
    )
    found = found.withColumn("securities", F.coalesce("securities", "any_amount")).drop("any_amount")
    return found.filter("name is not null and country is not null and securities is not null")


def _roles_of(cells: Column) -> Column:
    """What column_roles finds, in the cells (col_no, value) of a header's row."""
    said = F.transform(F.filter(cells, lambda c: c["value"].isNotNull()), lambda c: F.struct(c["col_no"].alias("col_no"), F.trim(F.regexp_replace(F.lower(c["value"]), r"\s+", " ")).alias("text")))

    def roles(said: Column) -> Column:
        of = lambda test: F.transform(F.filter(said, lambda c: test(c["text"])), lambda c: c["col_no"])
        pick = lambda test, which: (F.array_max if which == "last" else F.array_min)(of(test))
        each = {role: pick(lambda t, words=words: _any(t, words), which) for role, words, which in ROLES}
        each["securities"] = F.coalesce(each["securities"], each.pop("any_amount"))
        each["name"] = pick(lambda t: t.contains("name") & t.contains("shareholder"), "last")
        each["category"] = pick(lambda t: t.contains("category of shareholder") & ~t.contains("type of sharehold"), "last")
        owed = lambda t: _any(t, ["payable", "liabilit"])
        each |= {"payables": F.array_distinct(of(owed)), "receivables": F.array_distinct(of(lambda t: _any(t, ["receivable", "claim"]) & ~owed(t)))}
        return F.struct(*[c.alias(role) for role, c in each.items()])

    return once(said, roles)


def register_rows(cells: DataFrame) -> DataFrame:
    """Holders, as the jobs of register take them, of registers in any layout: filing_id, row_no, texts, numbers, payables and receivables.

    Where a column of the security's type is there, rows must say equity or preference. What is no
    number is null, and as payables, receivables or securities 0.

    Cells are gathered by row once, and where they lie by filing already they stay there: the header of
    header_rows, and its column_roles, are told to the rows of their filing, which read their own cells.
    """
    rows = cells.groupBy("filing_id", "sheet_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "value"))).alias("cells"))
    told = F.filter("cells", lambda c: c["value"].isNotNull())
    best = F.when((F.col("row_no") < SCANNED) & F.exists("cells", lambda c: c["value"].isNotNull()), once(_matches(F.array_join(F.transform(told, lambda c: F.lower(c["value"])), " ")), lambda m: F.when(m > 0, F.struct((-m).alias("less"), "sheet_no", "row_no", _roles_of(F.col("cells")).alias("roles")))))
    # a row that speaks of nothing has no column of a name, so that its filing would be left out anyhow
    rows = rows.withColumn("head", F.min(best).over(Window.partitionBy("filing_id"))).filter((F.col("sheet_no") == F.col("head.sheet_no")) & (F.col("row_no") > F.col("head.row_no")))

    rows = rows.select("filing_id", "row_no", "cells", F.col("head.roles").alias("r")).filter("r.name is not null and r.country is not null and r.securities is not null")
    pick = lambda role: F.array_max(F.transform(F.filter("cells", lambda x: x["col_no"] == F.col(f"r.{role}")), lambda x: x["value"]))
    number = lambda text: F.trim(text).try_cast("double")
    total = lambda role: F.aggregate(F.filter("cells", lambda x: F.array_contains(f"r.{role}", x["col_no"])), F.lit(0.0), lambda acc, x: acc + F.coalesce(number(x["value"]), F.lit(0.0)))
    said = [pick(t).alias(t) for t in TEXTS] + [number(pick(n)).alias(n) for n in NUMBERS] + [total(t).alias(t) for t in ("payables", "receivables")]
    # read once, by explode, however often what follows asks for a field
    made = rows.select("filing_id", "row_no", F.explode(F.array(F.struct(F.col("r.sec_type").isNotNull().alias("typed"), *said))).alias("h")).select("filing_id", "row_no", "h.*")
    kept = made.filter(~F.col("typed") | F.lower("sec_type").rlike("equity|preference"))
    return kept.withColumn("securities", F.coalesce("securities", F.lit(0.0))).drop("typed")


def template_columns(cells: DataFrame) -> DataFrame:
    """sheet, head_row and the columns field, particulars, source, py_share, py_amount, fy_share and fy_amount of each sheet of a template.

    cells: sheet, row_no, col_no, value. The first TEMPLATE_SCANNED rows are read up to the one that
    names the source. Of several columns of a year the first is of shares and the last of amounts.
    Where only the source is named, fields stand in column 1 from the first row on.
    """
    said = F.lower(F.trim("value"))
    is_source = said.isin("source of information", "source")
    top = cells.filter(F.col("row_no") < TEMPLATE_SCANNED).withColumn("said", said)
    ends = top.groupBy("sheet").agg(F.min(F.when(is_source, F.col("row_no"))).alias("source_row"), F.max("row_no").alias("last_row"))
    seen = top.join(ends, "sheet").filter(F.col("source_row").isNull() | (F.col("row_no") <= F.col("source_row")))
    at = F.struct("row_no", "col_no")
    last = lambda test: F.max(F.when(test, at))["col_no"]
    first = lambda test: F.min(F.when(test, at))["col_no"]
    again = lambda test: F.when(F.count(F.when(test, 1)) > 1, last(test))
    py, fy = F.col("said").contains("end march py"), F.col("said").contains("end march fy")
    found = seen.groupBy("sheet", "source_row", "last_row").agg(
        last(F.col("said") == "field name").alias("named"), last(F.col("said").isin("particulars", "value")).alias("particulars"), last(F.col("said").isin("source of information", "source")).alias("source"),
        first(py).alias("py_share"), again(py).alias("py_amount"), first(fy).alias("fy_share"), again(fy).alias("fy_amount"),
    )
    bare = F.col("named").isNull() & F.col("source").isNotNull()
    head = F.when(bare, 0).when(F.col("source").isNotNull(), F.col("source_row")).when(F.col("named").isNotNull(), F.col("last_row")).otherwise(0)
    return found.select("sheet", head.cast("int").alias("head_row"), F.when(bare, 1).otherwise(F.col("named")).alias("field"), "particulars", "source", "py_share", "py_amount", "fy_share", "fy_amount")

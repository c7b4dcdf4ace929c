"""Tables of OCR output: nested blocks with table markup, markup to cells, and two stricter readings of markdown tables.

All of it happens in the row of a document: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.arrays import once, places, runs
from tallyloom.functions.cleaning import statement_number

#: Named character references that tables use.
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")]
BLOCK = "array<struct<path:array<int>,node:variant>>"


def unescape(text: Column) -> Column:
    """Numbered character references and those of REFERENCES as the characters they stand for; others stay."""

    def numbered(part: Column, i: Column) -> Column:
        number = F.regexp_extract(part, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        code = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).try_cast("int")
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        # a code point as four bytes, most significant first
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(i == 0, part).when(good, F.concat(char, F.regexp_replace(part, r"^[0-9a-zA-Z]+;", ""))).otherwise(F.concat(F.lit("&#"), part))

    out = F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, "&#"), numbered), "")).otherwise(text)
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def markup_tables(markup: Column) -> Column:
    """An array of tables, each an array of rows, each an array of cell texts.

    White space in a cell is one space; inner tags go. Rows without cells and tables without rows are
    none. Upper and lower case tags are alike.
    """
    inner = lambda text, tags: F.regexp_extract_all(text, F.lit(rf"(?is)<(?:{tags})(?:\s[^>]*)?>(.*?)</(?:{tags})\s*>"), 1)
    cell = lambda c: F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "(?s)<[^>]*>", "")), r"[\s\x{00A0}]+", " "))
    row = lambda r: F.transform(inner(r, "td|th"), lambda c: cell(c))
    rows = lambda t: F.filter(F.transform(inner(t, "tr"), lambda r: row(r)), lambda r: F.size(r) > 0)
    return F.filter(F.transform(inner(markup, "table"), lambda t: rows(t)), lambda t: F.size(t) > 0)


def block_tables(raw: Column) -> Column:
    """The markup of all table blocks of a document's JSON, at any depth, in document order.

    The walk goes level by level through the blocks' children. It takes as many turns as the text
    names children at most, and the turns after the last level have nothing to do.
    """
    start = F.struct(F.array(F.struct(F.array(F.lit(0)).alias("path"), F.try_parse_json(raw).alias("node"))).alias("front"), F.array().cast("array<struct<path:array<int>,html:string>>").alias("found"))

    def level(acc: Column, _: Column) -> Column:
        html = lambda b: F.try_variant_get(b["node"], "$.html", "string")
        tables = F.filter(acc["front"], lambda b: (F.try_variant_get(b["node"], "$.block_type", "string") == "Table") & html(b).isNotNull())
        found = F.concat(acc["found"], F.transform(tables, lambda b: F.struct(b["path"].alias("path"), html(b).alias("html"))))
        below = lambda b: F.transform(F.try_variant_get(b["node"], "$.children", "array<variant>"), lambda c, i: F.struct(F.concat(b["path"], F.array(i)).alias("path"), c.alias("node")))
        front = F.flatten(F.filter(F.transform(acc["front"], below), lambda x: x.isNotNull())).cast(BLOCK)
        return F.struct(front.alias("front"), found.alias("found"))

    turns = F.sequence(F.lit(0), F.regexp_count(raw, F.lit('"children"')))
    walked = F.aggregate(turns, start, level, lambda acc: acc["found"])
    return F.transform(F.array_sort(walked), lambda t: t["html"])


def ocr_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, col_no and value of all tables in the JSON of OCR output (column raw), all from 0. What is no JSON has no table."""
    tables = F.flatten(F.transform(block_tables(F.col("raw")), lambda h: markup_tables(h)))
    each = docs.select("doc_id", F.posexplode(tables).alias("table_no", "rows")).select("doc_id", "table_no", F.posexplode("rows").alias("row_no", "cells"))
    return each.select("doc_id", "table_no", "row_no", F.posexplode("cells").alias("col_no", "value"))


def ocr_text(docs: DataFrame) -> DataFrame:
    """doc_id and text: the markdown that the JSON of OCR output carries, empty if none."""
    return docs.select("doc_id", F.coalesce(F.try_variant_get(F.try_parse_json("raw"), "$.markdown", "string"), F.lit("")).alias("text"))


def _line_runs(text: Column, inside: Callable[[Column], Column]) -> Column:
    """Runs of trimmed lines that pass the test, each with last: does nothing but such lines follow?"""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def cut(all_: Column) -> Column:
        good = lambda i: F.coalesce(inside(F.get(all_, i)), F.lit(False))
        starts = F.filter(places(all_), lambda i: (i == 0) | (good(i) != good(i - 1)))
        spans = once(starts, lambda s: F.filter(runs(F.size(all_), s), lambda r: good(r["first"])))
        return F.transform(spans, lambda r: F.struct(F.slice(all_, r["first"] + 1, r["size"]).alias("lines"), (r["first"] + r["size"] == F.size(all_)).alias("last")))

    return once(lines, cut)


def _cells(line: Column) -> Column:
    parts = F.split(line, r"\|", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.trim(x))


def strict_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no and rows (arrays of cells): runs of two or more lines with a bar at both ends.

    The second line must have a cell of dashes and colons only, but not in a table that ends the text.
    """
    separator = lambda line: F.exists(_cells(line), lambda c: c.rlike("^[-: ]+$"))
    found = _line_runs(F.col("text"), lambda x: x.rlike(r"^\|") & x.rlike(r"\|$"))
    good = F.filter(found, lambda r: (F.size(r["lines"]) > 1) & (r["last"] | separator(F.get(r["lines"], F.lit(1)))))
    each = docs.select("doc_id", F.posexplode(F.transform(good, lambda r: F.transform(r["lines"], lambda x: _cells(x)))).alias("table_no", "rows"))
    return each


def loose_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no, headers and rows: runs of two or more lines that begin with a bar, the first with another one; the second line is left out, whatever it says."""
    found = _line_runs(F.col("text"), lambda x: x.startswith("|"))
    # a line with one bar only opens no table; the run begins at the next
    opened = F.transform(found, lambda r: F.slice(r["lines"], F.coalesce(F.array_min(F.filter(F.transform(r["lines"], lambda x, i: F.when(F.substring(x, 2, 1_000_000).contains("|"), i + 1)), lambda i: i.isNotNull())), F.size(r["lines"]) + 1), F.size(r["lines"])))
    good = F.filter(opened, lambda lines: F.size(lines) > 1)
    each = docs.select("doc_id", F.posexplode(good).alias("table_no", "lines"))
    return each.select("doc_id", "table_no", _cells(F.get("lines", F.lit(0))).alias("headers"), F.transform(F.slice("lines", 3, F.size("lines")), lambda x: _cells(x)).alias("rows"))


def allocate_lines(rows: DataFrame, fields: list[tuple[str, list[str]]], amounts: dict[str, str]) -> DataFrame:
    """Adds field and, for each of amounts (new column to cell column), the number on the field's line of a merged cell.

    rows: doc_id, row_no, particulars and cell columns. A field is found by the first of its patterns
    that the particulars match; fields stand in the order of their matches. The nth of them takes the
    nth line of each cell (lines end at ``<br>`` or a line end, blank ones do not count), or its last.
    """
    low = F.lower("particulars")

    def place(patterns: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_instr(low, F.lit(p)), F.lit(0)) for p in patterns])

    met = F.array_sort(F.array_compact(F.array(*[F.when(place(ps).isNotNull(), F.struct(place(ps).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("field"))) for i, (name, ps) in enumerate(fields)])))
    each = rows.select("*", F.posexplode(met).alias("__n", "__f"))
    lines = lambda c: F.filter(F.split(F.col(c), r"(?i)<br\s*/?>|\n"), lambda x: F.trim(x) != "")
    pick = lambda ls: F.when(F.size(ls) > 0, statement_number(F.get(ls, F.least(F.col("__n"), F.size(ls) - 1)))).otherwise(F.lit(0.0))
    return each.select(*rows.columns, F.col("__f.field").alias("field"), *[F.coalesce(once(lines(c), pick), F.lit(0.0)).alias(new) for new, c in amounts.items()])


def merged_targets(coordinates: DataFrame, ranges: DataFrame, block: int = 16) -> DataFrame:
    """Adds target_row and target_col to cells (sheet, row_no, col_no): the top left of the merged range that a cell lies in, else the cell.

    ranges: sheet, min_row, max_row, min_col and max_col. Cells and ranges meet by sheet and block of
    ``block`` x ``block`` cells; a range stands in each block that it reaches into. Of ranges that
    overlap the one of the least corner counts.
    """
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor(F.col(hi) / block)))
    placed = ranges.select("*", spread("min_row", "max_row").alias("row_block")).select("*", spread("min_col", "max_col").alias("col_block"))
    cells = coordinates.withColumns({"row_block": F.floor(F.col("row_no") / block), "col_block": F.floor(F.col("col_no") / block)})
    inside = cells.select("sheet", "row_no", "col_no", "row_block", "col_block").distinct().join(placed, ["sheet", "row_block", "col_block"]).filter("row_no between min_row and max_row and col_no between min_col and max_col")
    corner = inside.groupBy("sheet", "row_no", "col_no").agg(F.min(F.struct("min_row", "min_col")).alias("corner"))
    out = coordinates.join(corner, ["sheet", "row_no", "col_no"], "left")
    return out.withColumns({"target_row": F.coalesce("corner.min_row", "row_no"), "target_col": F.coalesce("corner.min_col", "col_no")}).drop("corner")

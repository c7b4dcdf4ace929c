"""Tables of OCR output, header rows of sheets, merged cells and best rows: odd forms."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import document_tree, header_scan, navigation, table_markup, workbook_facts


def cells_of(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string")
    out = {}
    for r in table_markup.ocr_tables(df).orderBy("doc_id", "table_no", "row_no", "col_no").collect():
        out.setdefault((r.doc_id, r.table_no), {}).setdefault(r.row_no, []).append(r.value)
    return {k: list(v.values()) for k, v in out.items()}


def table_block(*rows):
    return {"block_type": "Table", "html": "<table>" + "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows) + "</table>"}


@pytest.mark.parametrize("depth", [0, 1, 3, 6, 40])
def test_blocks_of_any_depth(spark, depth):
    node = table_block("ab", "cd")
    for _ in range(depth):
        node = {"block_type": "Group", "children": [{"block_type": "Text", "children": []}, node]}
    assert cells_of(spark, [json.dumps(node)]) == {(0, 0): [["a", "b"], ["c", "d"]]}


def test_tables_stand_in_document_order(spark):
    inner = {"block_type": "Table", "html": table_block("1")["html"], "children": [table_block("2")]}
    doc = {"children": [{"children": [{"children": [inner]}]}, table_block("3"), "text", None, 7, {"children": {"not": "a list"}}, table_block("4") | {"html": table_block("4")["html"] * 2}]}
    assert [t for _, t in sorted(cells_of(spark, [json.dumps(doc)]).items())] == [[["1"]], [["2"]], [["3"]], [["4"]], [["4"]]]
    odd = [None, "", "no json", "[]", '{"children": "x"}', json.dumps({"block_type": "Table"}), json.dumps({"block_type": "Table", "html": "<p>none</p><table></table>"}), json.dumps({"block_type": "Text", "html": table_block("x")["html"]})]
    assert cells_of(spark, odd) == {}
    texts = table_markup.ocr_text(spark.createDataFrame([(1, '{"markdown": "# T"}'), (2, "x"), (3, None)], "doc_id long, raw string")).orderBy("doc_id").collect()
    assert [r.text for r in texts] == ["# T", "", ""]


def test_markup_of_cells(spark):
    html = "<TABLE class=x><thead><TR><Th colspan=2> A&amp;B <br/>\n C</Th></TR></thead><tbody><tr></tr><tr><td><b>&#8377;1</b>&nbsp;&#x41;</td><td></td><td>&lt;&unknown; &#0; &#xD800; &#55</td></tr></tbody></TABLE>"
    assert cells_of(spark, [json.dumps({"block_type": "Table", "html": html})]) == {(0, 0): [["A&B C"], ["₹1 A", "", "<&unknown; &#0; &#xD800; &#55"]]}


def test_stricter_tables_at_the_edges_of_texts(spark):
    texts = ["| a | b |\n|---|---|\n| 1 | 2 |\n", "| a |\n| b |", "| a |\n| b |\nend", "| a |\n| :-: |\nend", "| a |", None, "", "|a|b\n|c|d\n|e|f|\n|g|h|\n|-|-|"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    strict = {(r.doc_id, r.table_no): r.rows for r in table_markup.strict_tables(df).collect()}
    assert strict == {(0, 0): [["a", "b"], ["---", "---"], ["1", "2"]], (1, 0): [["a"], ["b"]], (3, 0): [["a"], [":-:"]], (7, 0): [["e", "f"], ["g", "h"], ["-", "-"]]}
    loose = {r.doc_id: (r.headers, r.rows) for r in table_markup.loose_tables(df).collect()}
    assert loose == {0: (["a", "b"], [["1", "2"]]), 1: (["a"], []), 2: (["a"], []), 3: (["a"], []), 7: (["a"], [["e", "f"], ["g", "h"], ["-", "-"]])}


def sheet(spark, rows):
    """Cells of (filing, sheet, list of rows)."""
    return spark.createDataFrame([(f, s, i, j, v) for f, s, lines in rows for i, line in enumerate(lines) for j, v in enumerate(line) if v is not None], "filing_id long, sheet_no int, row_no int, col_no int, value string")


def test_headers_of_odd_registers(spark):
    head = ["Name of shareholder", "Country", "No. of shares"]
    rows = [
        (1, 0, [["Country"], head, ["A", "Japan", "5"], head]), (1, 1, [head, ["B", "Peru", "6"]]),  # the first of equals
        (2, 0, [["Shareholder name", "Nationality", "Amount in Rs", "Amount of securities held", "Type of security"], ["A", "Japan", "7", "9", "Debenture"], ["B", "Japan", "8", "9", "EQUITY\nshares"], ["C", None, "x", "9", "preference"]]),
        (3, 0, [["nothing"], ["here"]]), (4, 0, [["x"]] * 20 + [head, ["A", "Japan", "5"]]), (5, 3, [["Country", "No. of shares"], ["Japan", "5"]]),
    ]
    cells = sheet(spark, rows)
    assert {r.filing_id: (r.sheet_no, r.header_row, r.matches) for r in header_scan.header_rows(cells).collect()} == {1: (0, 1, 3), 2: (0, 0, 2), 3: (0, 0, 0), 4: (0, 0, 0), 5: (3, 0, 2)}
    found = {(r.filing_id, r.name): (r.country, r.securities, r.amount) for r in header_scan.register_rows(cells).collect()}
    assert found == {(1, "A"): ("Japan", 5.0, None), (1, "Name of shareholder"): ("Country", 0.0, None), (2, "B"): ("Japan", 9.0, 9.0), (2, "C"): (None, 9.0, 9.0)}
    assert header_scan.register_rows(cells.limit(0)).count() == 0


def test_columns_of_templates(spark):
    sheets = {
        "I": [["x"], ["", "Field Name", "Particulars", "Source of Information"], ["", "Name", "", "Prefill"]],
        "II": [["", "Field name", "End March PY (shares)", "end march py", "End March FY", "End March FY amount"], ["a"], ["b"]],
        "IV": [["", "Rule"], ["", "", "", "Source"]], "V": [["no", "header"]],
    }
    cells = spark.createDataFrame([(s, i, j, v) for s, rows in sheets.items() for i, row in enumerate(rows) for j, v in enumerate(row)], "sheet string, row_no int, col_no int, value string")
    got = {r.sheet: tuple(r)[1:] for r in header_scan.template_columns(cells).collect()}
    assert got == {"I": (1, 1, 2, 3, None, None, None, None), "II": (2, 1, None, None, 2, 3, 4, 5), "IV": (0, 1, None, 3, None, None, None, None), "V": (0, None, None, None, None, None, None, None)}


def test_ranges_across_blocks(spark):
    ranges = spark.createDataFrame([("a", 1, 40, 2, 2), ("a", 1, 1, 1, 30), ("b", 5, 5, 5, 5)], "sheet string, min_row int, max_row int, min_col int, max_col int")
    coordinates = spark.createDataFrame([("a", 40, 2), ("a", 41, 2), ("a", 1, 2), ("a", 1, 30), ("b", 5, 5), ("b", 1, 1), ("c", 1, 1), ("a", 40, 2)], "sheet string, row_no int, col_no int")
    got = sorted((r.sheet, r.row_no, r.col_no, r.target_row, r.target_col) for r in table_markup.merged_targets(coordinates, ranges, block=8).collect())
    assert got == [("a", 1, 2, 1, 1), ("a", 1, 30, 1, 1), ("a", 40, 2, 1, 2), ("a", 40, 2, 1, 2), ("a", 41, 2, 41, 2), ("b", 1, 1, 1, 1), ("b", 5, 5, 5, 5), ("c", 1, 1, 1, 1)]


def test_best_rows_by_years_and_by_other_cells(spark):
    text = "# A\n\n| No | Item | 31.3.2025 | 31.3.2024 |\n|---|---|---|---|\n| (a) | Trade payables | 1,200 | (empty) |\n| (b) | Cash | 900 | 800 |\n| (c) | Cash (net) | 90 | 80 |\n| (d) | Total cash | 9 | 8 |\n"
    docs = spark.createDataFrame([(1, text), (2, "# none"), (3, None)], "doc_id long, text string")
    rows = navigation.best_rows(document_tree.nodes(docs, paths=True), ["Cash", "trade payables", "(a)", "reserves"]).collect()
    got = {r.variable: (r.doc_id, r.current, r.previous, r.score, r.status) for r in rows}
    # the words alone in a cell behind the first give 5, a total of them 8
    assert got == {"Cash": (1, "9", "8", 18, "FOUND"), "trade payables": (1, "1,200", "", 5, "FOUND"), "(a)": (1, "1,200", "", 0, "FOUND"), "reserves": (None, None, None, None, "NOT_FOUND")}


def test_small_amounts_with_decimals_are_no_notes(spark):
    amounts = ["12", "12.0", "12.00", "1.00", "49.00", "(12.00)", "0.00", "60"]
    cells = [(i, "Profit and Loss", 0, 1, c, v) for i, a in enumerate(amounts) for c, v in enumerate(("Profit before tax", "19", a))]
    heads = [(i, "Profit and Loss", 0, 0, c, v) for i in range(len(amounts)) for c, v in enumerate(("Particulars", "Note No", "Amount"))]
    df = spark.createDataFrame(heads + cells, "filing_id int, sheet string, sheet_no int, row_no int, col_no int, value string")
    got = {r.filing_id: r.value for r in workbook_facts.workbook_facts(df).filter("field = 'net_profit_before_tax'").collect()}
    assert got == {2: 12.0, 3: 1.0, 4: 49.0, 5: -12.0, 6: 0.0, 7: 60.0}

"""Jobs that no SQL of the tables can check: edge cases of trees, streams, roles and learned rules."""

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import comparison, document_tree, flag_report, learning, navigation, return_grid, rule_packs, text_facts, workbook_facts
from tallyloom.operators.disclosures import disclosure_flags
from tallyloom.operators.statement_facts import statement_facts, table_facts
from tallyloom.sources import corpus
from tallyloom.streaming.jobs import hourly_board, ingest_arrivals

MARKDOWN = """before
| a | b |
|---|---|
| x | y | z |
| only |
## Two
text **bold**
more

text
#### Four
### Three
"""


def test_blocks_sections_and_ragged_tables(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id long, text string")
    parts = document_tree.sections(document_tree.blocks(document_tree.line_kinds(document_tree.lines(docs))))
    kinds = [(r.kind, r.section_no) for r in parts.orderBy("block_no").collect()]
    assert kinds == [("paragraph", 0), ("table", 0), ("heading", 1), ("paragraph", 1), ("paragraph", 1), ("heading", 2), ("heading", 3)]
    tree = {r.section_no: (r.title, r.parent_no) for r in document_tree.section_tree(parts).collect()}
    assert tree == {0: ("Preamble", None), 1: ("Two", 0), 2: ("Four", 1), 3: ("Three", 1)}
    cells = [(r.row_no, r.col_no, r.value) for r in document_tree.table_cells(parts).orderBy("row_no", "col_no").collect()]
    assert cells == [(0, 0, "a"), (0, 1, "b"), (1, 0, "x"), (1, 1, "y"), (2, 0, "only"), (2, 1, "")]
    nodes = document_tree.nodes(docs)
    assert nodes.filter("node_type = 'document'").count() == 3
    assert document_tree.edges(nodes).filter("rel = 'BELONGS_TO'").count() == nodes.count() - 3


def test_parsed_documents_are_the_same_as_lines(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, ""), (4, "**Bold only**\nx\n|a|b|\n|1|\n\n# One\n### Deep\n## Two\n"), (5, "\n\n![i](x)\n")], "doc_id long, text string")
    lines = document_tree.sections(document_tree.blocks(document_tree.line_kinds(document_tree.lines(docs))))
    own = document_tree.parsed(docs).select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.section_no", F.explode("s.blocks").alias("b"))
    columns = ["doc_id", "block_no", "kind", "level", "line_no", "content", "lines", "section_no"]
    assert sorted(map(tuple, own.select("doc_id", "section_no", "b.*").select(columns).collect())) == sorted(map(tuple, lines.select(columns).collect()))
    tree = document_tree.section_tree(lines).select("doc_id", "section_no", "level", "title", "parent_no")
    assert sorted(map(str, document_tree.document_sections(docs).collect())) == sorted(map(str, tree.collect()))
    cells = document_tree.table_cells(lines)
    assert sorted(map(str, document_tree.document_cells(docs).select(cells.columns).collect())) == sorted(map(str, cells.collect()))
    bold = document_tree.parsed(docs, bold_headings=True).filter("doc_id = 4").select(F.explode("sections").alias("s")).select("s.level", "s.title").collect()
    assert [tuple(r) for r in bold] == [(6, "Bold only"), (1, "One"), (3, "Deep"), (2, "Two")]


def test_facts_of_whole_tables_are_the_same_as_of_cells(spark):
    texts = [
        "| Item | Current year | Previous year |\n|-|-|-|\n| a | 1,000.00 | (200) |\n\n| Item | x | y |\n|-|-|-|\n| b | 300 | 400 |",
        "| Item | Note | 2023 | 2024 | 2022 |\n|-|-|-|-|-|\n| a | 1 | 5 | 6 | 7 |\n| b |\n", "| Item | CY |\n| a | 9 |", "| Item | 31 March 2024 |\n| a | 9 |", "| only | words |\n| a | b |", "| head |", "no table", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = statement_facts(document_tree.document_cells(docs))
    got = table_facts(document_tree.parsed_tables(docs))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 5


def test_navigation_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id long, text string")
    nodes = document_tree.nodes(docs, paths=True)
    assert {(r.doc_id, r.node_type, r.n, r.depth) for r in navigation.summary(nodes).filter("node_type in ('document', 'cell')").collect()} == {(1, "document", 1, 0), (2, "document", 1, 0), (3, "document", 1, 0), (1, "cell", 6, 4)}
    assert [r.key for r in navigation.find_section(nodes, "two").collect()] == ["section/1"]
    assert navigation.find_rows(nodes, "nowhere").count() == navigation.find_cells(nodes, row="only", text="x").count() == 0
    assert {r.status for r in navigation.variable_search(nodes, ["zzz"]).collect()} == {"NOT_FOUND"}
    path = {r.key: r.structural_path for r in navigation.structural_path(nodes.filter("doc_id = 1")).collect()}
    assert path["section/3"] == "document > section[Preamble] > section[Two] > section[Three]" and path["document"] == "document"


def test_periods_by_words_and_by_place(spark):
    text = "| Item | Current year | Previous year |\n|-|-|-|\n| a | 1,000.00 | (200) |\n\n| Item | x | y |\n|-|-|-|\n| b | 300 | 400 |"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cells = document_tree.table_cells(document_tree.blocks(document_tree.line_kinds(document_tree.lines(docs))))
    assert {r.item: (r.fy, r.py) for r in statement_facts(cells).collect()} == {"a": (1000.0, -200.0), "b": (300.0, 400.0)}


def test_threshold_edges_and_missing_metrics(spark):
    crore = rule_packs.CRORE
    rows = [(1, "private limited company", 50 * crore, 500 * crore), (2, None, None, None), (3, "Public", 50 * crore + 1, 499 * crore)]
    df = spark.createDataFrame(rows, "filing_id int, company_type string, borrowings double, net_worth double")
    got = {(r.filing_id, r.rule_id): r.status for r in rule_packs.threshold_flags(df).collect()}
    assert len(got) == 75
    assert (got[1, "COMP_VIGIL"], got[3, "COMP_VIGIL"]) == ("Passed", "Failed")  # above, not at, the limit
    assert (got[1, "COMP_CSR"], got[3, "COMP_CSR"]) == ("Failed", "Passed")  # at the limit
    assert got[2, "COMP_SMALL_CO"] == "Passed" and got[2, "COMP_BEN_2"] == "Manual"
    pay = spark.createDataFrame([(1, 300_000.0)], "filing_id int, rpt_monthly_remun double")
    status = lambda strict: {r.rule_id: r.status for r in rule_packs.loan_flags(pay, strict_compat=strict).collect()}["COMP_SEC_188_8"]
    assert (status(False), status(True)) == ("Failed", "Passed")


def test_disclosure_proximity(spark):
    texts = ["EPS" + " " * 90 + "1", "EPS" + " " * 120 + "1", "keeps 5", None]
    df = spark.createDataFrame(list(enumerate(texts)), "filing_id int, full_text string")
    got = {r.filing_id: r.user_value for r in disclosure_flags(df).filter("check = 'eps'").collect()}
    assert got == {0: "Yes", 1: "No", 2: "No", 3: "No"}


def test_grid_without_cells(spark):
    grid = return_grid.formulas(spark.createDataFrame([(1,)], "filing_id int"))
    assert grid.select("ii_f24", "ii_g34", "iv_d39").first() == (0.0, 0.0, 0.0)
    assert return_grid.checks(grid).filter("not passed").count() == 0


def test_resolution_reasons(spark):
    rows = [("UNLESS", "a", ""), ("UNLESS", "a", "a"), ("UNLESS", "a", "b"), ("UNLESS", None, "b"), ("UNLESS", None, None), ("x", "a", "b"), ("x", "a", None)]
    df = spark.createDataFrame(rows, "rule string, prev string, curr string")
    value, reason = comparison.resolve(F.col("rule"), F.col("prev"), F.col("curr"))
    got = [tuple(r) for r in df.select(value, F.split(reason, " ->")[0]).collect()]
    assert [v for v, _ in got] == ["a", "a", "b", "b", "", "b", "a"]
    assert [r for _, r in got][:5] == ["Current Value Missing", "Current Value Same", "Current Value Different", "Previous Missing", "Both Missing"]


def test_aliases_and_best_paths(spark):
    rules = spark.createDataFrame([("t", "f", "old", 1), ("t", "g", "keep", 1)], "template string, field string, extracted_key string, at int")
    changes = spark.createDataFrame([("t", "f", "new", 2), ("t", "g", None, 2)], "template string, field string, extracted_key string, at int")
    assert [(r.field, r.extracted_key) for r in learning.upsert_aliases(rules, changes).collect()] == [("f", "new")]
    paths = spark.createDataFrame([("a", "v", 1), ("b", "v", 3), ("c", "v", 3)], "rule_id string, variable_name string, success_count int")
    assert [r.rule_id for r in learning.best_paths(paths).collect()] == ["b"]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "FS_Acme_FY2024.md").write_text("# One\ntwo")
    (tmp_path / "skip.txt").write_text("no")
    assert [(r.company, r.text) for r in corpus.read_markdown(spark, str(tmp_path)).collect()] == [("Acme", "# One\ntwo")]
    assert corpus.list_files(spark, str(tmp_path)).count() == 2


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 30)
    schema = "id long, status string, created_at timestamp"
    spark.createDataFrame([(1, "error", at), (2, "error", at), (3, "completed", at + datetime.timedelta(hours=1))], schema).write.parquet(str(tmp_path / "tasks"))
    board = hourly_board(spark.readStream.schema(schema).parquet(str(tmp_path / "tasks")))
    run = board.writeStream.format("memory").queryName("board").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.status, r.n) for r in spark.table("board").collect()) == [("completed", 1), ("error", 2)]
    docs = "doc_id long, text string, arrived_at timestamp"
    spark.createDataFrame([(1, "a\nb", at), (1, "a\nb", at), (2, "c", at)], docs).write.parquet(str(tmp_path / "docs"))
    arrivals = spark.readStream.schema(docs).parquet(str(tmp_path / "docs"))
    for _ in range(2):  # the second run finds nothing new
        ingest_arrivals(arrivals, document_tree.lines, str(tmp_path / "lines"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "lines")).count() == 3


def test_amounts_behind_a_keyword(spark):
    cases = [
        ("revenue 12 2024 5,000", 5000.0), ("revenue (1,234.50) 7", -1234.5), ("revenue 6.1 612.00", 612.0), ("revenue 6.1 7", 6.1), ("revenue | - | 800 |", 800.0), ("revenue | - | - |", 0.0),
        ("revenue 12", None), ("revenue", None), ("revenue 3.27.991", 327991.0), ("revenue 0 0", 0.0), ("revenue 5,00 0", 500.0), ("revenue nil", 0.0), ("revenue 49 50", 50.0), ("revenue -2025 77.5", 77.5), (None, None), ("", None),
    ]
    df = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "i int, t string")
    assert [r.v for r in df.select("i", text_facts.first_amount(F.col("t")).alias("v")).orderBy("i").collect()] == [v for _, v in cases]
    assert df.filter("t = 'revenue nil'").select(text_facts.first_amount(F.col("t"), strict_compat=True).alias("v")).first().v is None


def test_text_facts_of_odd_texts(spark):
    far = "\n".join(["Related party"] + ["x"] * 199 + ["Professional fees 900.00"] + ["x"] * 29 + ["Salary"])
    texts = [None, "", "Turnover\n\n700.00", "Turnover\n| 700.00", "Turnover\nnone\nx\n700.00", "Turnover 800.00\nTotal turnover 900.00\r\nturnover 1", "(a) Turnover", far, "x\n" + far.replace("Related party", "Related party\nx"), "Cash flow: borrowings 500.00\nBorrowings 600.00"]
    df = spark.createDataFrame(list(enumerate(texts)), "filing_id int, text string")
    got = sorted((r.filing_id, r.field, r.value) for r in text_facts.text_facts(df).collect())
    assert got == [(2, "turnover", 700.0), (5, "turnover", 900.0), (6, "turnover", 0.0), (7, "rpt_monthly_remun", 900.0), (9, "borrowings", 600.0)]
    assert text_facts.text_facts(df.limit(0)).count() == 0


def test_borrowings_add_up_without_a_total(spark):
    rows = [(1, "Long-term borrowings", "500"), (1, "Short-term borrowings", "700"), (2, "Total borrowings", "900"), (2, "Long-term borrowings", "500"), (2, "Short-term borrowings", "700"), (3, "Long-term borrowings", "500"), (4, None, "1")]
    cells = [(i, "BS", 0, n, c, v) for n, (i, label, amount) in enumerate(rows) for c, v in enumerate((label, amount))]
    df = spark.createDataFrame(cells, "filing_id int, sheet string, sheet_no int, row_no int, col_no int, value string")
    got = {r.filing_id: r.value for r in workbook_facts.workbook_facts(df).filter("field = 'borrowings'").collect()}
    assert got == {1: 1200.0, 2: 900.0, 3: 500.0}
    assert workbook_facts.workbook_facts(df.limit(0)).count() == 0


def test_report_tables_and_an_empty_report(spark, tmp_path):
    flags = spark.createDataFrame([(1, "a", None), (2, None, "x")], "filing_id long, rule_id string, particulars string")
    flag_report.write_report({"errors": flags, "consistency": flags.filter("filing_id = 2")}, str(tmp_path / "report"))
    got = spark.read.json(str(tmp_path / "report"))
    assert sorted((r.report, r.filing_id) for r in got.collect()) == [("consistency", "2"), ("errors", "1"), ("errors", "2")]
    empty = flag_report.report_tables({"errors": flags.limit(0)}).collect()
    assert [(r.report, r.filing_id, r.row) for r in empty] == [("flags", None, '{"message":"No flags generated"}')]
    template = spark.createDataFrame([("X!", 4), ("x", 7), (None, 9)], "particulars string, row_no int")
    assert [(r.particulars, r.n) for r in flag_report.unmatched(flags, template).collect()] == [(None, 1)]


def test_notes_and_variables_are_found_in_one_pass(spark):
    text = "# Report\n\n| Item | Note | 2024 |\n|-|-|-|\n| Cash | 2 | 10 |\n| Stock | 2 | 7 |\n| Debts | 9 | - |\n\n## Note 2: Money\nx\n## 2. Again\n"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    nodes = document_tree.nodes(docs, paths=True)
    notes, found = navigation.note_targets(nodes), navigation.variable_search(nodes, ["cash", "money", "zzz"])
    assert {(r.note, r.row, r.target) for r in notes.collect()} == {("2", "row/2/1", "section/2"), ("2", "row/2/2", "section/2"), ("9", "row/2/3", None)}
    assert {(r.doc_id, r.variable): r.status for r in found.collect()} == {(1, "cash"): "FOUND", (1, "money"): "PARTIAL", (1, "zzz"): "NOT_FOUND", (2, "cash"): "NOT_FOUND", (2, "money"): "NOT_FOUND", (2, "zzz"): "NOT_FOUND"}
    for df in (notes, found):  # each document is parsed once, and nothing is joined
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("LogicalRDD") == 1

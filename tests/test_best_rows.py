"""Best rows from whole tables."""

from tallyloom.operators import document_tree, navigation

TEXT = "# A\n| Item | Note | FY 2024 | FY 2023 |\n|---|---|---|---|\n| Total cash | 3 | 1,000 | 900 |\n| Cash | 4 | 5 | - |\n\n## B\n\n| x | cash flow | 7 |\n|---|---|---|\n| y | of cash | 8 |\n| debt | none | 1 |\n"


def test_as_from_nodes_without_a_second_pass(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no table"), (3, None), (4, TEXT.replace("Total ", ""))], "doc_id long, text string")
    words = ["cash", "of cash", "debt", "absent"]
    found = navigation.best_table_rows(document_tree.parsed_tables(docs), words)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # the documents are parsed once, into a table that is read twice
    rows = sorted(map(str, found.collect()))
    assert rows == sorted(map(str, navigation.best_rows(document_tree.nodes(docs, paths=True), words).collect()))
    assert len(rows) == 7


def test_tables_are_made_once(spark):
    plan = document_tree.parsed_tables(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan

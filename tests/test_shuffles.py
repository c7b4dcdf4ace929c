"""What the queries deal out between tasks, told by their plans."""

from tallyloom.operators import document_tree, learning
from tallyloom.plans import navigation, sheets

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_registers_stay_where_holders_were_dealt(spark):
    above, cells, _ = plan(sheets.found_holders(spark, SF)).partition("Generate inline(")
    assert cells and "Exchange" not in above


def test_rules_walk_in_the_row_of_a_document(spark):
    text = "# A\nTotal - none\n\n| Item | FY | PY |\n|---|---|---|\n| Cash | 1 | 2 |\n| Cash old | 3 | 4 |\n\n## Signed\nDirector: B"
    docs = spark.createDataFrame([(1, "t", text), (2, "t", "# A\nx\n"), (3, "u", text), (4, "t", None), (5, "t", text.replace("Cash", "Bank"))], "doc_id long, template string, text string")
    step = lambda kind, label=None, col=None: (kind, label, col)
    way = [step("section", "a"), step("table"), step("row", "cash")]
    rules = [("r1", "cash", [*way, step("cell", "x", 2)]), ("r2", "row", way), ("r3", "old", [step("section"), step("table"), step("row", "old")]), ("r4", "director", [step("section"), step("section", "signed"), step("paragraph", "director")]), ("r5", "section", [step("section", "A")]), ("r6", "nothing", [])]
    table = spark.createDataFrame([("t", *r) for r in rules], "template string, rule_id string, variable_name string, path array<struct<type:string,label:string,col_index:int>>")
    nodes = document_tree.nodes(docs, paths=True).join(docs.select("doc_id", "template"), "doc_id")
    for strict in (False, True):
        want, got = (sorted(map(str, f.collect())) for f in (learning.extract(nodes, table, strict_compat=strict), learning.extract_from(docs, table, strict_compat=strict)))
        assert got == want and len(got) == 24 and any("extracted" in r for r in got)
    assert plan(learning.extract_from(docs, table)).partition("Generate explode(transform(rules")[0].count("Exchange") == 0


def test_neighbours_of_rows_deal_out_texts_only(spark):
    above, made, _ = plan(navigation.d13_siblings(spark, SF)).partition("Generate posexplode(")
    assert made and "Exchange" not in above


def test_ways_are_found_in_one_pass(spark):
    made = plan(navigation.d7_find(spark, SF))
    assert made.count("Generate posexplode(") == 1 and "Exchange" not in made.partition("Generate explode(array_compact")[2].partition("Generate posexplode(")[0]


def test_nodes_are_made_once(spark):
    docs = spark.createDataFrame([(1, "# A\n\n| x | y |\n|-|-|\n| a | 1 |\n"), (2, None)], "doc_id long, text string")
    for paths in (False, True):
        nodes = document_tree.nodes(docs, paths)
        assert nodes.count() == 11
        assert nodes._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1


def test_replay_walks_in_the_row_of_a_document(spark):
    text = "Begin\n\n# A\nTotal - none\n\n| Item | Note | FY |\n|---|---|---|\n| Cash | 1 | see note 7b |\n| | Cash old | 4 |\n\n|\n\n| Other | X |\n| y | 2 |\n\n## Signed\nDirector: B\n# Empty\n## Signed again"
    docs = spark.createDataFrame([(1, text), (2, "# A\nx\n"), (3, None), (4, text.replace("Cash", "Bank")), (5, "| Note |\n| 3 |")], "doc_id long, text string")
    step = lambda kind, label=None, col=None: (kind, label, col)
    a, row = [step("section"), step("section", "a")], [step("section"), step("section", "A"), step("table"), step("row", "cash")]
    paths = [a, [*a, step("heading")], [*a, step("paragraph", "none")], [*a, step("table", "other")], [*a, step("table"), step("header")], [*a, step("table"), step("header"), step("cell", "fy")], row, [*row, step("cell", "see", 2)], [*row, step("cell", "x", 2)],
             [*row, step("cell", "see")], [*row, step("note")], [*row, step("note", "7b")], [*row, step("note", None, 1)], [*a, step("section", "signed"), step("paragraph", "director")], [step("section"), step("table", "note"), step("row"), step("note", "3")],
             [step("section", "empty")], [step("section"), step("section", "again")], [*row, step("row")], [step("table")], [*row, step("section")], []]
    table = spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)], "rule_id string, path array<struct<type:string,label:string,col_index:int>>")
    nodes = document_tree.nodes(docs, paths=True)
    for strict in (False, True):
        want, got = (sorted(map(str, f.collect())) for f in (learning.replay(nodes, table, 6, strict), learning.replay_from(docs, table, 6, strict)))
        assert got == want and len(got) > 20


def test_edges_sort_nodes_once_for_siblings_and_once_for_the_document(spark):
    text = "Begin\n\n# A\n\n| Item | | FY |\n|---|---|---|\n| Cash | 1 | see note 7b |\n| | | 4 |\n\nafter\n\n| x |\n\n## B\n# C"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "# A\nx")], "doc_id long, text string")
    nodes = document_tree.nodes(docs)
    made = document_tree.edges(nodes)
    assert plan(made).count("Sort [") == 2
    assert sorted(map(str, made.collect())) == sorted(map(str, document_tree.edges(document_tree.numbered(nodes)).collect()))

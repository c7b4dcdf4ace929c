"""Rules learned from examples: where their nodes are found, what they give elsewhere, and how they are kept."""

import datetime

from pyspark.sql import functions as F

from tallyloom.operators import document_tree, learning

AT = datetime.datetime(2024, 1, 1)
EXAMPLE = "doc_id long, template string, variable_name string, document_type string, key string, value string, at timestamp"
ROWS = ["# One", "Trade payables are due: soon", "", "| Item | Note | 2024 | 2023 |", "|---|---|---|---|", "| Trade payables | 3 | 1,200 | 900 |", "| Trade payables total | 4 | 2,200 | 1,900 |", "## Two", "Address - 12, Long Street", ""]


def nodes(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = document_tree.nodes(docs, paths=True)
    for k, v in more.items():
        out = out.withColumn(k, v if hasattr(v, "alias") else F.lit(v))
    return out


def learn(spark, texts, *rows):
    made = learning.learn_paths(nodes(spark, texts), spark.createDataFrame([(d, "t", v, None, k, x, AT + datetime.timedelta(days=i)) for i, (d, v, k, x) in enumerate(rows)], EXAMPLE))
    return made.withColumn("success_count", F.lit(0))


def shown(rules):
    return {r.variable_name: r.shown for r in rules.select("variable_name", learning.shown_steps(F.col("path")).alias("shown")).collect()}


def test_examples_find_rows_before_other_text(spark):
    text = "\n".join(ROWS)
    got = learn(spark, [text, ""], (0, "cell", "trade payables", "900"), (0, "row", "Trade Payables", None), (0, "odd", "trade payables", "7"), (0, "line", "are due", "soon"), (0, "none", "reserves", "1"), (0, "blank", "  ", "1"), (1, "lost", "trade", "1"), (9, "gone", "trade", "1"))
    table = "section[One] > table > row[Trade payables]"
    assert shown(got) == {"cell": f"{table} > cell#3", "row": table, "odd": table, "line": "section[One] > paragraph[Trade payables are due: soon]"}
    assert learn(spark, [""], (0, "a", "b", "c")).count() == 0


def test_the_latest_example_that_finds_a_node_counts(spark):
    text = "\n".join(ROWS)
    got = learn(spark, [text, text], (0, "v", "trade payables", "900"), (1, "v", "trade payables total", "2,200"), (1, "v", "nowhere", "1"))
    assert shown(got) == {"v": "section[One] > table > row[Trade payables total] > cell#2"}


def test_values_of_cells_rows_and_lines(spark):
    text = "\n".join(ROWS)
    other = text.replace("1,200", "77").replace("| 900", "| -").replace("soon", "later").replace("Long Street", "Other Road")
    rules = learn(spark, [text], (0, "cell", "trade payables", "900"), (0, "row", "Trade Payables", None), (0, "line", "are due", None), (0, "street", "address", None), (0, "total", "trade payables total", "1,900"))
    lost = other.replace("Trade payables total", "Something else").replace("| Trade payables |", "| Payables |")
    got = {(r.doc_id, r.variable_name): (r.value, r.status) for r in learning.extract(nodes(spark, [other, lost, None]), rules).collect()}
    assert got == {
        (0, "cell"): ("-", "extracted"), (0, "row"): ("3", "extracted"), (0, "line"): (None, "path lost"), (0, "street"): (None, "path lost"), (0, "total"): ("1,900", "extracted"),
        **{(1, v): (None, "path lost") for v in ("cell", "row", "line", "street", "total")}, **{(2, v): (None, "path lost") for v in ("cell", "row", "line", "street", "total")},
    }
    again = {r.variable_name: r.value for r in learning.extract(nodes(spark, [text]), rules).collect()}
    assert again == {"cell": "900", "row": "1,200", "line": "soon", "street": "12, Long Street", "total": "1,900"}


def test_rules_meet_documents_of_their_scope(spark):
    text = "\n".join(ROWS)
    rules = learn(spark, [text], (0, "cell", "trade payables", "900"))
    for template, n in (("t", 1), ("u", 0)):
        assert learning.extract(nodes(spark, [text], template=template), rules).count() == n
    assert learning.extract(nodes(spark, [text], document_type="generic"), rules).count() == 1
    # a cell that must also say what the example said
    moved = text.replace("900 |", "901 |")
    strict = [learning.extract(nodes(spark, [t]), rules, strict_compat=True).collect()[0].status for t in (text, moved)]
    assert strict == ["extracted", "path lost"]


def test_value_forms_and_guards(spark):
    rows = [
        ("paragraph", "PAN : AB : C", None, None, "C"), ("paragraph", "a - b - c d", None, None, "c d"), ("paragraph", "ends: ", None, None, ""), ("cell", " x ", None, 3, "x"),
        ("row", "", ["n", "1", "2,0", "3.5"], None, "2,0"), ("row", "", ["n", "1", "2"], 0, "n"), ("row", "", ["n", "1", "2"], 9, "1"), ("row", "", ["n", "7", "x"], None, "7"), ("row", "", ["n", "x"], None, "x"), ("row", "lone 5", ["n"], None, "5"),
        ("paragraph", "Net worth 12 34", None, None, "12"), ("paragraph", "Net worth 12 34", None, 2, "34"), ("paragraph", "Net worth 12", None, 0, "Net worth"), ("paragraph", "12 34 56", None, 0, "12"), ("paragraph", "no figure", None, None, ""), ("paragraph", None, None, None, ""),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "kind string, text string, cells array<string>, col int, want string, i int")
    got = df.select("i", "want", learning.value_of(F.col("kind"), F.col("text"), F.col("cells"), F.col("col")).alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]
    values = [("a b c d e f " * 4, "name", True), ("Name ", "name", True), ("www.x.org", "v", True), ("HTTPS://x", "v", True), ("12 Main Road", "office", False), ("one two three four five", "v", False)]
    df = spark.createDataFrame(values, "value string, variable string, want boolean")
    assert all(r.got == r.want for r in df.select("want", learning.rejected(F.col("value"), F.col("variable")).alias("got")).collect())


def test_rules_and_their_counts_survive_reruns(spark, tmp_path):
    text = "\n".join(ROWS)
    path = f"file://{tmp_path}/rules"
    table = learning.RuleTable(spark, path)
    assert table.rules().count() == 0
    rules = learn(spark, [text], (0, "cell", "trade payables", "900"), (0, "row", "trade payables total", None)).drop("success_count")
    table.upsert(rules)
    table.upsert(rules.limit(1).withColumn("template", F.lit("other")).withColumn("rule_id", F.lit("o")))
    for run, times in (("a", 1), ("a", 1), ("b", 2)):
        table.record(learning.extract(nodes(spark, [text, text, ""]), table.rules().filter("template = 't'")), run)
        assert {r.variable_name: r.success_count for r in table.rules().filter("template = 't'").collect()} == {"cell": 2 * times, "row": 2 * times}
    before = {p.name for p in (tmp_path / "rules/rules/template=other").iterdir()}
    changed = rules.filter("variable_name = 'row'").withColumn("at", F.lit(AT + datetime.timedelta(days=99))).withColumn("path", F.slice("path", 1, 1))
    learning.RuleTable(spark, path).upsert(changed)
    got = {(r.template, r.variable_name): (len(r.path), r.success_count) for r in learning.RuleTable(spark, path).rules().collect()}
    assert len(got) == 3 and got["t", "row"] == (1, 4) and got["t", "cell"] == (4, 4)
    assert before == {p.name for p in (tmp_path / "rules/rules/template=other").iterdir()}


def test_rules_are_learned_in_the_row_of_a_document(spark):
    text = "# A\nTotal cash - none\n\n| Item | FY | PY |\n|---|---|---|\n| Cash | 1 | 2 |\n| Cash old | 3 | 2 |\n| | Bank | 5 |\n\n## Signed\nDirector: B"
    docs = spark.createDataFrame([(1, text), (2, text.replace("| 2 |", "| 1 |")), (3, None), (4, "x"), (5, "# A\nx\n")], "doc_id long, text string")
    said = [("a", "cash", "2"), ("b", " Cash old ", "3"), ("c", "total", None), ("d", "Director", "B"), ("e", "nowhere", "1"), ("f", " ", "1"), ("g", "bank", "5"), ("h", "cash", ""), ("i", "cash", "9"), ("j", None, "1"), ("k", "FY", None)]
    rows = [(d, t, v, k, "report" if v < "d" else None, x, d) for d in (1, 2, 3, 4, 6) for t in ("s", "t") for v, k, x in said]
    examples = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, template string, variable_name string, key string, document_type string, value string, at int")
    want, got = (sorted(map(str, f.collect())) for f in (learning.learn_paths(document_tree.nodes(docs, paths=True), examples), learning.learn_from(docs, examples)))
    assert got == want and len(got) == 16
    plan = learning.learn_from(docs, examples)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "posexplode" not in plan

"""Reviewers' changes: what is evaluated again, and what stays as it was written."""

from pyspark.sql import functions as F

from tallyloom.operators import comparison, evidence, overrides, return_grid, scoped_batch, table_outline, text_fields, workbook_facts
from tallyloom.sources import corpus

FACTS, CHANGES = "filing_id long, field string, value string", "filing_id long, field string, value string, at int"


def total(facts):
    """Sum of a filing's values."""
    return facts.groupBy("filing_id").agg(F.sum(F.col("value").cast("double")).alias("total"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    facts = spark.createDataFrame([(i, f, str(i)) for i in range(40) for f in ("a", "b")], FACTS)
    store = overrides.Evaluations(spark, f"file://{tmp_path}/results", buckets=8)
    store.run(facts, total)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "results").glob("bucket=*/*.parquet")}
    before = files()
    assert {r.filing_id: r.total for r in store.results().collect()} == {i: 2.0 * i for i in range(40)}
    changes = spark.createDataFrame([(3, "a", "100", 1), (3, "a", "200", 2), (3, "c", "5", 1), (3, "b", None, 9)], CHANGES)
    store.rerun(facts, changes, total)
    after = files()
    assert {r.filing_id: r.total for r in store.results().collect()} == {i: 205.0 if i == 3 else 2.0 * i for i in range(40)}
    assert len(before) > 3 and sum(before[b] != after[b] for b in before) == 1
    store.rerun(facts, changes, total)
    assert store.results().count() == 40 and sum(after[b] != f for b, f in files().items()) == 1
    new = overrides.Evaluations(spark, f"file://{tmp_path}/new")
    new.rerun(facts, changes, total)
    assert [tuple(r) for r in new.results().collect()] == [(3, 205.0)]


def test_reviewed_facts_of_odd_changes(spark):
    facts = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], FACTS)
    none = spark.createDataFrame([], CHANGES)
    assert sorted(map(tuple, overrides.reviewed(facts, none).collect())) == [(1, "a", "x"), (1, "b", "y")]
    changes = spark.createDataFrame([(1, "a", "new", 1), (1, "a", None, 2), (2, "z", "only", 1)], CHANGES)
    assert sorted(map(tuple, overrides.reviewed(facts, changes).collect())) == [(1, "a", "new"), (1, "b", "y"), (2, "z", "only")] or sorted(map(tuple, overrides.reviewed(facts, changes).collect())) == [(1, "b", "y"), (2, "z", "only")]


def test_types_without_rules_of_their_own(spark):
    rules = spark.createDataFrame([("t", "a", "f1", "k1"), ("t", None, "f2", "k2"), ("u", "a", "f3", "k3"), ("u", "b", "f4", "k4")], "template string, document_type string, form_field string, extracted_key string")
    types = spark.createDataFrame([("t", "a"), ("t", "z"), ("t", None), ("u", "z"), ("u", "b"), ("none", "a")], "template string, document_type string")
    got = sorted((r.template, r.document_type, r.tier, r.form_field) for r in scoped_batch.scoped_rules(types, rules).collect())
    assert got == [("t", "a", 1, "f1"), ("t", "generic", 1, "f2"), ("t", "z", 2, "f2"), ("u", "b", 1, "f4"), ("u", "z", 3, "f3"), ("u", "z", 3, "f4")]
    fields = spark.createDataFrame([(1, "path"), (1, "pending"), (2, "prediction")], "doc_id long, source string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert sorted(map(tuple, scoped_batch.batch_status(docs, fields).collect())) == [(1, "review", 2), (2, "success", 1), (3, "success", 0)]


def test_windows_of_lines_at_the_ends_of_texts(spark):
    docs = spark.createDataFrame([(1, "s\nhit\n\nhit\ns"), (2, ""), (3, None), (4, "hit")], "doc_id long, text string")
    hit, support = (lambda x: x == "hit"), (lambda x: x == "s")
    got = sorted((r.doc_id, r.line_no, r.supported) for r in evidence.supported(docs, hit, support, 1, 0).collect())
    assert got == [(1, 2, True), (1, 4, False), (4, 1, False)]
    ahead = {(r.doc_id, r.line_no): r.ahead for r in evidence.look_ahead(docs, hit, 2).collect()}
    assert ahead == {(1, 1): "hit", (1, 2): "hit", (1, 3): "hit", (1, 4): None, (1, 5): None, (2, 1): None, (4, 1): None}
    inside = [r.context for r in evidence.in_context(docs, support, hit, 2).filter("doc_id = 1").orderBy("line_no").collect()]
    assert inside == [True, False, False, False, True]


def test_roles_of_filings_without_files(spark):
    files = spark.createDataFrame([(1, "x/a.md", 1), (2, "x/b.xlsx", 1), (3, "x/c.png", 1)], "filing_id long, path string, listing_no int")
    none = spark.createDataFrame([], "filing_id long, role string, path string")
    assert sorted(map(tuple, corpus.fill_roles(none, files).collect())) == [(1, "financials", "x/a.md"), (2, "financials", "x/b.xlsx")]
    given = spark.createDataFrame([(1, "financials_0", "y"), (9, "other", "z")], "filing_id long, role string, path string")
    assert sorted(map(tuple, corpus.fill_roles(given, files).collect())) == [(1, "fallback_md_0", "x/a.md"), (1, "financials_0", "y"), (2, "financials", "x/b.xlsx"), (9, "other", "z")]


def test_notes_formats_and_long_grids(spark):
    rows = spark.createDataFrame([(1, "12a"), (2, " 7 "), (3, "x1"), (4, None)], "row_no int, note string")
    assert {r.row_no: r.note_ref for r in table_outline.note_references(rows).collect()} == {1: "12a", 2: "7"}
    cells = spark.createDataFrame([(1, "Balance Sheet", "Share Capital"), (1, "balance sheet 2", "RESERVES"), (2, "Notes", "share capital"), (2, "Balance sheet", "share capital")], "filing_id long, sheet string, value string")
    got = {r.filing_id: (r.n_headings, r.in_format) for r in workbook_facts.statement_format(cells, ["share capital", "reserves"], 2).collect()}
    assert got == {1: (2, True), 2: (1, False)}
    balances = text_fields.related_balances(
        spark.createDataFrame([(1, "Acme Holdings Ltd"), (1, "Bo"), (2, "Acme Inc")], "filing_id long, name string"),
        spark.createDataFrame([(1, 1, "Related Party", None), (1, 2, "Payable", None), (1, 3, "to superacmeco", 5.0), (1, 4, "to acme", 7.0), (1, 5, "receivable from bo", 9.0), (2, 1, "payable to acme", 3.0)], "filing_id long, row_no int, text string, amount double"),
    )
    assert [tuple(r) for r in balances.collect()] == [(1, "Acme Holdings Ltd", 7.0, None)]
    assert comparison.cascade_match(spark.createDataFrame([("abc",), ("zz",)], "key string"), spark.createDataFrame([("ABC", 1), ("abcd", 0)], "field string, ord int")).collect()[0].tier in (2, 5)
    assert callable(return_grid.long_form)


def test_equal_rows_of_related_parties_are_kept_once(spark, monkeypatch):
    kept, saved = {}, text_fields.saved

    def counted(df, name):
        out = saved(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(text_fields, "saved", counted)
    rows = [(1, 1, "Related party; payable", None), *((1, 2 + i, "Due to acme1", float(i)) for i in range(50)), (1, 60, "due to superacme1x", 99.0), (1, 61, "receivable of bolt2", 3.0)]
    names = spark.createDataFrame([(1, "acme1 Ltd"), (1, "bolt2"), (1, "none at all")], "filing_id long, name string")
    got = text_fields.related_balances(names, spark.createDataFrame(rows, "filing_id long, row_no int, text string, amount double"))
    assert sorted(map(tuple, got.collect())) == [(1, "acme1 Ltd", 99.0, None), (1, "bolt2", None, 3.0)]
    assert max(kept.values()) < 10
